"""Near-duplicates: ProbMinHash signatures of weighted word shingles, banding, exact verification, classes.

A text's shingles, weighted by how often they occur, arrive as Poisson processes whose rates are the weights; each arrival
falls on a random component of the signature, which keeps its earliest one. A text is done when its next arrivals would all
be later than its latest component. Two signatures agree in a component with the probability Jaccard similarity.

A text that repeats shingles has a second signature, of weights 1, whose components agree with the plain Jaccard similarity,
so both similarities have candidates. Where nothing repeats, both signatures are the same, and their bands share buckets.

Exact copies are one node. Texts that agree in a whole band share a bucket. First, each bucket's nodes are compared with one
pivot, the node with most bucket mates: copies that differ from each other are all like their original, and that has most
mates. Then, in the buckets that still hold several classes, the nodes outside the largest class are compared with all mates
of other classes, block by block, and only links leave the blocks. So every two bucket mates are compared or already in one
class, no link between texts that share a band is lost, and a bucket of n near-copies costs about n comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _GOLD, materialise, mix, releasing, shingle_hashes, slices, spread, text_column

SHINGLE = 5
SIMILARITY = 0.8
#: Two texts of similarity 0.8 miss all bands with probability (1 - 0.8**ROWS)**BANDS, 5e-5.
BANDS, ROWS = 25, 5
#: Nodes of a block: those that are compared, and the mates that they are compared with. A bucket of n unlike nodes sends n * n / 512 sets.
PIVOTS, MATES = 1024, 1024
#: Numbers that a comparison of blocks works on at once; shingles of mates that it holds, and about those of a block's pivots.
CELLS, HELD = 4_000_000, 500_000
#: Characters of text whose signatures are made together; a text counts for ROW of them at least, for its signature is of a fixed size.
TOGETHER, ROW = 500_000, 2_000
#: Tasks that a band's rows are dealt to in joins, so that a bucket that holds much of the table isn't one task's.
SALTS = 16
#: Tables of nodes of up to so many rows (24 bytes each) are broadcast, larger ones joined by shuffling.
BROADCAST_ROWS = 500_000
_SEED = np.uint64(0xD1B54A32D192ED03)


# ---------------------------------------------------------------- signatures


def weighted(texts: list[str | None], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of all texts: hash, number of the text, and how often it has the shingle."""
    hashes, at = shingle_hashes(texts, k)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return hashes[first], owner[first], np.diff(np.append(first, len(hashes)))


def _earliest(e: np.ndarray, d: np.ndarray, w: np.ndarray, n: int, m: int) -> np.ndarray:
    """Signatures of n texts, a row of m shingle hashes each, from their shingles' hashes, texts and weights."""
    times, sig = np.full(n * m, np.inf), np.zeros(n * m, dtype=np.uint64)
    last = np.full(n, np.inf)
    h, rate, t = np.zeros(len(e)), w.astype(np.float64), 0
    while len(e):
        t += 1
        random = mix(e + np.uint64(t * int(_GOLD) % (1 << 64)))
        h = h - np.log(((random >> np.uint64(11)).astype(np.float64) + 1) / (1 << 53)) / rate
        early = h < last[d]
        e, d, h, rate, random = e[early], d[early], h[early], rate[early], random[early]
        slot = d * m + (mix(random ^ _SEED) % np.uint64(m)).astype(np.int64)
        better = np.flatnonzero(h < times[slot])
        better = better[np.argsort(-h[better], kind="stable")]  # of equal slots, the earliest is written last
        times[slot[better]], sig[slot[better]] = h[better], e[better]
        last = times.reshape(n, m).max(axis=1)
    return sig.reshape(n, m)


def signatures(texts: list[str | None], m: int = BANDS * ROWS, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The signatures (a row of m shingle hashes per text) and which texts have one (those with a word)."""
    e, d, w = weighted(texts, k)
    has = np.zeros(len(texts), dtype=bool)
    has[d] = True
    return _earliest(e, d, w, len(texts), m), has


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * _SEED, (len(sig), 1))
    for r in range(rows):
        keys = mix(keys * _GOLD + sig[:, r::rows][:, :bands])
    return keys.view(np.int64)


def both_keys(e: np.ndarray, d: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """Band keys of n texts from their weighted shingles: BANDS of the weighted signature, then BANDS of that of weights 1."""
    keys = band_keys(_earliest(e, d, w, n, BANDS * ROWS))
    plain = keys.copy()
    repeats = np.unique(d[w > 1])
    if len(repeats):
        inside = np.isin(d, repeats)
        e, d = e[inside], np.searchsorted(repeats, d[inside])
        plain[repeats] = band_keys(_earliest(e, d, np.ones(len(e)), len(repeats), BANDS * ROWS))
    return np.hstack([keys, plain])


def prob_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard similarity of two weighted sets (sorted hashes, weights): sum over common i of 1 / sum over j of max(a_j / a_i, b_j / b_i)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    x, y = a[1][i].astype(np.float64), b[1][j].astype(np.float64)
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    above = x[::-1].cumsum()[::-1]
    below = np.concatenate([[0], y.cumsum()[:-1]])
    only_a, only_b = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    return float((1 / ((only_a + above) / x + (only_b + below) / y)).sum())


def set_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    both = len(np.intersect1d(a[0], b[0], assume_unique=True))
    return both / max(1, len(a[0]) + len(b[0]) - both)


def similar(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], least: float = SIMILARITY) -> bool:
    """Whether the shingles' similarity reaches the threshold, as weighted or as plain sets."""
    return max(prob_jaccard(a, b), set_jaccard(a, b)) >= least - 1e-12


# ---------------------------------------------------------------- tables


def node_of(text: Column) -> Column:
    return F.unhex(F.md5(text))


def with_bands(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, node (MD5 of the text), bands (none for a text without words): the keys of both_keys, null where the second repeats the first; shingles: how many distinct ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, 2, TOGETHER, ROW):
            e, d, w = weighted(texts)
            keys = both_keys(e, d, w, len(texts))
            has, new = np.bincount(d, minlength=len(texts)) > 0, keys[:, :BANDS] != keys[:, BANDS:]
            wanted = np.repeat(np.stack([has, has & new.any(axis=1)], axis=1), BANDS, axis=1)
            same = np.hstack([np.zeros_like(new), ~new])
            offsets = np.concatenate([[0], np.cumsum(wanted.sum(axis=1))])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys[wanted], mask=same[wanted])), pa.array(np.bincount(d, minlength=len(texts)), pa.int64())], names=["id", "node", "bands", "shingles"])

    t = text_column(docs, text)
    return spread(docs.select(docs[key].cast("long").alias("id"), node_of(t).alias("node"), t.alias("text"))).mapInArrow(releasing(run), "id long, node binary, bands array<long>, shingles long")


SETS = "node binary, hashes binary, weights binary, keys binary"


def shingle_sets(texts: DataFrame) -> DataFrame:
    """SETS of (node, text): sorted distinct shingle hashes, how often each occurs, and the band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in slices(batches, 1, TOGETHER, ROW):
            h, d, w = weighted(words)
            at = np.searchsorted(d, np.arange(len(words) + 1))
            keys = both_keys(h, d, w, len(words))
            cut = list(zip(at[:-1], at[1:], strict=True))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.binary()) for x in ([h[i:j].tobytes() for i, j in cut], [w[i:j].astype(np.int32).tobytes() for i, j in cut], [k.tobytes() for k in keys]))], names=["node", "hashes", "weights", "keys"])

    return texts.select("node", "text").mapInArrow(releasing(run), SETS)


def _set(hashes: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(hashes, dtype=np.uint64), np.frombuffer(weights, dtype=np.int32)


def _links(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*found, strict=True)], names=["a", "b"])


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those pairs (a, b) of nodes whose shingles are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            good = [(a, b) for a, b, ha, wa, hb, wb in rows if similar(_set(ha, wa), _set(hb, wb), least)]
            if good:
                yield _links(good)

    one, two = (sets.select(F.col("node").alias(x), F.col("hashes").alias(f"h{x}"), F.col("weights").alias(f"w{x}")) for x in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ha", "wa", "hb", "wb").mapInArrow(releasing(run), "a binary, b binary")


def shared_before(a: np.ndarray, b: np.ndarray, band: int) -> bool:
    """Whether two texts with the keys of both_keys share a bucket of an earlier band."""
    (a1, a2), (b1, b2) = a.reshape(2, -1)[:, :band], b.reshape(2, -1)[:, :band]
    return bool(((a1 == b1) | (a2 == b2) | (a1 == b2) | (a2 == b1)).any())


class _Block:
    """Pivots of one bucket that a stream of mates is compared with."""

    def __init__(self, least: float):
        self.least, self.nodes, self.classes, self.sets, self.keys = least, [], [], [], []
        self.tables: list[tuple[int, int, np.ndarray, np.ndarray]] = []

    def add(self, node: bytes, comp: bytes, pair: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> None:
        self.nodes.append(node)
        self.classes.append(comp)
        self.sets.append(pair)
        self.keys.append(keys)

    def _tables(self) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """The pivots in runs: first, end, the shingles of all of them, and which pivot has which (a byte each; the last row: none). Made once."""
        at = self.tables[-1][1] if self.tables else 0
        while at < len(self.nodes):
            end, total = at, 0
            while end < len(self.nodes) and (end == at or (total + len(self.sets[end][0])) * (end + 1 - at) <= CELLS):
                total += len(self.sets[end][0])
                end += 1
            union = np.unique(np.concatenate([h for h, _ in self.sets[at:end]]))
            has = np.zeros((len(union) + 1, end - at), dtype=np.int8)
            for i, (h, _) in enumerate(self.sets[at:end]):
                has[np.searchsorted(union, h), i] = 1
            self.tables.append((at, end, union, has))
            at = end
        return self.tables

    def compare(self, band: int, mates: list[tuple]) -> list[tuple[bytes, bytes]]:
        """Links between pivots and mates (node, comp, set, keys) of other classes that share no earlier band.

        A link needs ``least`` of the mate's shingles, by number or by weight, in the pivot: that is counted for all pairs at
        once (shares of probability Jaccard and of Jaccard similarity are no larger), the similarity itself for the rest.
        """
        out = []
        names = np.array([n.hex() for n in self.classes])
        others = np.array([m[1].hex() for m in mates])
        keys = np.array([m[3] for m in mates])
        sizes = np.array([len(m[2][0]) for m in mates])
        hashes, weights = np.concatenate([m[2][0] for m in mates]), np.concatenate([m[2][1] for m in mates])
        starts, owner, repeats = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(mates)), sizes), (weights > 1).any()
        for at, end, union, has in self._tables():
            place = np.minimum(np.searchsorted(union, hashes), len(union) - 1)
            place[union[place] != hashes] = len(union)
            found, heavy = np.zeros((len(mates), end - at)), np.zeros((len(mates), end - at))
            step = max(1, CELLS // (end - at))
            for a in range(0, len(hashes), step):  # a mate of many shingles adds up over several steps
                inside, whose = has[place[a : a + step]].astype(np.int32), owner[a : a + step]
                first = np.flatnonzero(np.concatenate([[True], whose[1:] != whose[:-1]]))
                found[whose[first]] += np.add.reduceat(inside, first, axis=0)
                if repeats:
                    inside *= weights[a : a + step, None]
                    heavy[whose[first]] += np.add.reduceat(inside, first, axis=0)
            share = found / sizes[:, None]
            if repeats:
                share = np.maximum(share, heavy / np.add.reduceat(weights, starts, dtype=np.int64)[:, None])
            for m, i in np.argwhere(share >= self.least - 1e-9):
                p = at + i
                if names[p] != others[m] and not shared_before(keys[m], self.keys[p], band) and similar(self.sets[p], mates[m][2], self.least):
                    out.append((self.nodes[p], mates[m][0]))
        return out


def compared(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between nodes of different classes in buckets (band, number, node, shingles, comp) that hold several classes.

    The nodes outside a bucket's largest class, in blocks of about PIVOTS and of about HELD shingles, meet all its nodes, in
    blocks of about MATES. A task streams the sorted blocks and holds one block's pivots; a bucket of any size is many blocks.
    """
    sizes = members.groupBy("band", "comp").agg(F.count("*").alias("k"), F.sum("shingles").alias("s"))
    largest = F.max_by(F.struct("comp", "k", "s"), F.struct("k", "comp"))
    buckets = sizes.groupBy("band").agg(F.sum("k").alias("n"), F.sum("s").alias("s"), largest.alias("top"), F.count("*").alias("classes")).where("classes > 1").withColumn("largest", F.col("top.comp"))
    blocks = F.ceil(F.greatest((F.col("n") - F.col("top.k")) / PIVOTS, (F.col("s") - F.col("top.s")) / HELD)).cast("int")
    shares = F.ceil(F.col("n") / MATES).cast("int")
    rows = _with_band(members, buckets.select("band", "largest", blocks.alias("blocks"), shares.alias("shares")))
    dealt = F.pmod(F.xxhash64("node"), F.lit(1 << 30)).cast("int")
    mate = rows.select("band", "number", "node", "comp", (dealt % F.col("shares")).alias("share"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"))
    pivot = rows.where(F.col("comp") != F.col("largest")).select("band", "number", "node", "comp", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), (dealt % F.col("blocks")).alias("block"), F.lit(0).alias("kind"))
    placed = mate.unionByName(pivot).join(sets, "node")
    order = ["band", "block", "share"]
    stream = placed.repartition(*order).sortWithinPartitions(*order, "kind").select(*order, "kind", "number", "node", "comp", "hashes", "weights", "keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, block, mates, size, number = None, _Block(least), [], 0, 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != group or size > HELD:
                    if mates and block.nodes and (good := block.compare(number, mates)):
                        yield _links(good)
                    mates, size = [], 0
                    if row[:3] != group:
                        group, block, number = row[:3], _Block(least), row[4]
                pair, keys = _set(row[7], row[8]), np.frombuffer(row[9], dtype=np.int64)
                if row[3] == 0:
                    block.add(row[5], row[6], pair, keys)
                else:
                    mates.append((row[5], row[6], pair, keys))
                    size += len(pair[0])
        if mates and block.nodes and (good := block.compare(number, mates)):
            yield _links(good)

    return stream.mapInArrow(releasing(run), "a binary, b binary")


def _with_band(rows: DataFrame, bands: DataFrame) -> DataFrame:
    """rows (band, node, ...) with the columns of their band's one row in bands, if it has one: each band's rows are dealt to SALTS tasks."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(bands.withColumn("_salt", salts), ["band", "_salt"]).drop("_salt")


def _small(df: DataFrame) -> DataFrame:
    """df with a hint to broadcast it if it is small enough by count; larger tables are joined by shuffling."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def components(edges: DataFrame) -> DataFrame:
    """node and comp (the component's least node) of all nodes of the edges (a, b): least labels of neighbours, with pointer jumping."""
    ends = F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")), F.struct(F.col("a").alias("x"), F.col("a").alias("y")), F.struct(F.col("b").alias("x"), F.col("b").alias("y")))
    links = edges.select(F.explode(ends).alias("e")).select("e.x", "e.y")
    labels = materialise(links.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("comp")), "labels")
    while True:
        known = _small(labels)
        low = links.join(known.select(F.col("node").alias("y"), "comp"), "y").groupBy(F.col("x").alias("node")).agg(F.min("comp").alias("low"))
        jump = low.join(known.select(F.col("node").alias("low"), F.col("comp").alias("up")), "low").select("node", F.least("low", "up").alias("new"))
        new = materialise(jump.join(known, "node").select("node", F.col("comp").alias("was"), F.col("new").alias("comp")), "labels")
        labels = new.select("node", "comp")
        if new.where(F.col("was") != F.col("comp")).isEmpty():
            return labels


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row per document: id, class_id (the least id of its class), node and comp (MD5 of its text and of its class).

    A class is a connected component of the texts' similarity links; equal texts are always together, and so are texts
    without words of one kind (null counts as empty). Repeated rows and ids are rows of their own; an id that is null is the
    class's id only if all its ids are. An empty table gives an empty result.
    """
    rows = materialise(with_bands(docs, key, text), "signatures")
    nodes = materialise(rows.groupBy("node").agg(F.min("id").alias("rep"), F.any_value("bands").alias("bands"), F.any_value("shingles").alias("shingles")), "nodes")
    banded = nodes.select("node", "rep", "shingles", F.posexplode("bands").alias("number", "band")).where("band is not null").withColumn("number", F.col("number") % BANDS)
    buckets = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    mates = materialise(_with_band(banded, buckets), "mates")
    involved = materialise(mates.groupBy("node").agg(F.min("rep").alias("rep"), F.sum("n").alias("mates")), "involved")
    t = text_column(docs, text)
    texts = docs.select(node_of(t).alias("node"), docs[key].cast("long").alias("id"), t.alias("text"))
    wanted = _small(involved).select(F.col("node").alias("n"), "rep")
    texts = texts.join(wanted, (F.col("node") == F.col("n")) & F.col("id").eqNullSafe(F.col("rep")))
    if not rows.groupBy("id", "node").agg(F.count("*").alias("n")).where("n > 1").isEmpty():  # repeated rows
        texts = texts.dropDuplicates(["node"])
    sets = materialise(shingle_sets(texts), "sets")

    centre = mates.join(_small(involved).select("node", "mates"), "node").groupBy("band").agg(F.max_by("node", F.struct("mates", "node")).alias("a"))
    pairs = _with_band(mates, centre).where(F.col("a") != F.col("node")).select("a", F.col("node").alias("b")).distinct()
    links = materialise(verified(pairs, sets, least), "links")
    found = components(links)
    members = mates.select("band", "number", "node", "shingles").join(_small(found), "node", "left").select("band", "number", "node", "shingles", F.coalesce("comp", "node").alias("comp"))
    more = materialise(compared(members, sets, least), "links")
    if not more.isEmpty():
        found = components(links.unionByName(more))
    named = nodes.select("node", "rep").join(_small(found), "node", "left").select("node", "rep", F.coalesce("comp", "node").alias("comp"))
    ids = named.groupBy("comp").agg(F.min("rep").alias("class_id"))
    of_node = named.select("node", "comp").join(ids, "comp")
    return rows.select("id", "node").join(of_node, "node").select("id", "class_id", "node", "comp")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """key and class_id of every document: see classes."""
    return classes(docs, key, text, least).select(F.col("id").alias(key), "class_id")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One document of each class: that of the least id (null last), of equal ids the least MD5; of equal rows, one."""
    found = materialise(classes(docs, key, text, least), "classes")
    kept = found.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "node")).alias("k")).select(F.col("k.id").alias("_id"), F.col("k.node").alias("_node"))
    t = text_column(docs, text)
    out = docs.join(kept, docs[key].cast("long").eqNullSafe(kept["_id"]) & (node_of(t) == kept["_node"]), "left_semi")
    repeated = found.groupBy("id", "node").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    return out.dropDuplicates([key, text]) if repeated else out

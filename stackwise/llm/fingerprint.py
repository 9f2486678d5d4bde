"""Document fingerprints: sketches of all word-shingle hashes below a fixed fraction of their range.

A sketch of a union of texts is the union of their sketches, and the share of one sketch inside another estimates how much
of a text another contains, however unequal their lengths.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shingle_hashes, text_column

SHINGLE = 5
#: One in SCALE shingle hashes is retained: those below a fixed fraction of their range, so a short text may have none.
SCALE = 4
#: Characters of text that a task works on in pairing documents.
TASK_CHARS = 4_000_000
#: Ranges of keys at most, for their bounds travel with the plan; beyond that, ranges are larger. They're sorted (on disk if need be) and read as streams.
MAX_RANGES = 1 << 16


def sketches(texts: list[str | None], scale: int = SCALE, k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted retained hashes of each text."""
    hashes, at = shingle_hashes(texts, k)
    below = np.uint64((1 << 64) // scale - 1)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        own = hashes[a:b]
        out.append(np.unique(own[own <= below]))
    return out


def written(sketch: np.ndarray) -> str:
    """Retained hashes in hexadecimal, 16 digits each, end to end in ascending order."""
    return sketch.astype(">u8").tobytes().hex()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), dtype=">u8").astype(np.uint64)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of both texts together."""
    return np.union1d(a, b)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The share of a's hashes that b has too; 1 if a has none."""
    return float(np.isin(a, b, assume_unique=True).mean()) if len(a) else 1.0


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sets of hashes; 1 if both are empty."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def edited(text: str, following: str) -> str:
    """text with its last third (floor) replaced by as many of the following text's first characters, or all of them."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _above(x: Column, bounds: list[int]) -> Column:
    """How many of the descending bounds are above x, by a binary search."""
    table = F.from_json(F.lit(json.dumps(bounds)), "array<long>")
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & (F.try_element_at(table, at + step) > x), at + step).otherwise(at))


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double, contained_next double"


def fingerprint_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", scale: int = SCALE, k: int = SHINGLE) -> DataFrame:
    """Each document's sketch beside that of its edited text and of the next document, by descending key (after the last, the first).

    Equal keys follow each other by their texts; a null key comes last, and null texts count as empty. A single document is
    its own next one. near_* and contained_* compare sketches; where one of two sketches is empty, all the texts' shingles (two
    texts without words are alike, and contain each other). Texts move once: documents are dealt by ranges of keys that hold about TASK_CHARS each, and the first
    document of a range goes along with the range before it, too.
    """
    rows = docs.select(docs[key].cast("long").alias("id"), text_column(docs, text).alias("text"))
    n, chars = rows.agg(F.count("*"), F.sum(F.length("text"))).first()
    ranges = max(1, min(n or 1, MAX_RANGES, -(-(chars or 0) // TASK_CHARS)))
    bounds = rows.where("id is not null").agg(F.expr(f"percentile_approx(id, array({', '.join(f'{i / ranges!r}D' for i in range(1, ranges)) or '0.5D'}), {10 * ranges})").alias("b")).first()["b"] or []
    bounds = sorted(set(bounds), reverse=True) if ranges > 1 else []
    # range 0 has the largest keys; a key's range is the number of bounds above it
    place = F.when(F.col("id").isNull(), F.lit(len(bounds))).otherwise(_above(F.col("id"), bounds)) if bounds else F.lit(0)
    firsts = rows.select(place.alias("range"), "id").groupBy("range").agg(F.max(F.struct(F.col("id").isNotNull(), "id")).alias("first")).select("range", F.col("first.id").alias("id")).orderBy("range").collect()
    if not firsts:
        return docs.sparkSession.createDataFrame([], OUT)
    # a row per range, and there is one range for every TASK_CHARS characters
    goes = {r["range"]: firsts[i - 1]["range"] for i, r in enumerate(firsts)}
    heads = docs.sparkSession.createDataFrame([(r["range"], r["id"], goes[r["range"]]) for r in firsts], "range int, head long, goes int")
    rows = rows.withColumn("range", place).join(F.broadcast(heads), "range")
    own = F.struct(F.col("range").alias("to"), F.lit(0).alias("guest"))
    guest = F.struct(F.col("goes").alias("to"), F.lit(1).alias("guest"))
    dealt = rows.select("id", "text", F.explode(F.when(F.col("id").eqNullSafe(F.col("head")), F.array(own, guest)).otherwise(F.array(own))).alias("at")).select("at.to", "at.guest", "id", "text")
    sort = dealt.repartition(len(firsts), "to").sortWithinPartitions("to", "guest", F.col("id").desc_nulls_last(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # documents whose next one isn't known yet: one at most, of a range
        pairs: list[tuple[int, str, str]] = []
        size = 0
        for batch in batches:
            for to, is_guest, i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] == to:
                    pairs.append((held[0][1], held[0][2], t))
                    size += len(t) + len(held[0][2])
                held = [] if is_guest and held and held[0][0] == to else held
                if not is_guest:
                    held = [(to, i, t)]
                if size > 2_000_000:
                    yield _compare(pairs, scale, k)
                    pairs, size = [], 0
        if pairs:
            yield _compare(pairs, scale, k)

    return sort.mapInArrow(run, OUT)


def _compare(pairs: list[tuple], scale: int, k: int) -> pa.RecordBatch:
    changed = [edited(t, f) for _, t, f in pairs]
    texts, following = [t for _, t, _ in pairs], [f for _, _, f in pairs]
    own, after, new = sketches(texts, scale, k), sketches(following, scale, k), sketches(changed, scale, k)

    def compared(measure, others: list[str], found: list[np.ndarray]) -> list[float]:
        out = [measure(a, b) for a, b in zip(own, found, strict=True)]
        for i, (a, b) in enumerate(zip(own, found, strict=True)):
            if not len(a) or not len(b):
                out[i] = measure(*sketches([texts[i], others[i]], 1, k))
        return out

    columns = {
        "doc_id": pa.array([i for i, _, _ in pairs], pa.int64()),
        "n_chars": pa.array([len(t) for _, t, _ in pairs], pa.int64()),
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
        "fingerprint": [written(s) for s in own],
        "edited_fingerprint": [written(s) for s in new],
        "near_edited": compared(likeness, changed, new),
        "near_next": compared(likeness, following, after),
        "contained_edited": compared(containment, changed, new),
        "contained_next": compared(containment, following, after),
    }
    return pa.RecordBatch.from_pydict({c: v if isinstance(v, pa.Array) else pa.array(v) for c, v in columns.items()})

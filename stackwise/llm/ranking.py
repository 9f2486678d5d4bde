"""Ranked lexical search: compressed postings per shard, merged document at a time through a heap of cursors.

The index has one row per shard. A task makes shards of the documents it reads, so building shuffles nothing: it sorts a
shard's documents by id, numbers them, and writes each term's postings, gaps of numbers and occurrences, as
variable-length integers. A search reads the shards once per block of queries. For each query, cursors over its terms'
postings meet in a heap keyed by their next document; the heap gives the next window of documents, all cursors in it pay in
their scores, and only then are the window's documents complete and compared with the bounded result heap. A task keeps
its result heaps over all its shards, so later shards skip windows that can't reach them; Spark merges the tasks' results.
"""

from __future__ import annotations

import heapq
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, text_column

K = 50
#: A shard ends at so many postings or documents; a larger document is a shard of its own.
SHARD_POSTINGS, SHARD_DOCS = 1 << 21, 1 << 15
#: Documents of a window: those whose scores are complete before the next ones are looked at.
WINDOW = 4096
#: Queries, and characters of their texts, that are searched at once.
BLOCK_QUERIES, BLOCK_CHARS = 1024, 1 << 22
#: Characters of a text whose terms are found at once; longer texts are cut between terms.
PART_BYTES = 1 << 20
#: Scores are w * ((TF_SCALE * tf) div (TF_UNIT * tf + LENGTH_UNIT * m)), m = 100 - LENGTH_SHARE + ((LENGTH_SHARE * n * N) div L).
TF_SCALE, TF_UNIT, LENGTH_UNIT, LENGTH_SHARE, WEIGHT_SCALE = 1_000_000_000, 1000, 20, 50, 1000
_TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_BREAK = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def count_terms(text: str | None) -> Counter:
    """Occurrences of each term: maximal runs of ASCII letters, digits and all other characters beyond ASCII; A-Z count as a-z."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes: A-Z only
    found: Counter = Counter()
    at = 0
    while len(data) - at > PART_BYTES:
        cut = _BREAK.search(data, at + PART_BYTES)
        end = cut.start() if cut else len(data)
        found.update(_TERM.findall(data, at, end))
        at = end
    found.update(_TERM.findall(data, at))
    return found


# ---------------------------------------------------------------- integers of variable length


def pack_integers(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Seven bits a byte, low ones first, the top bit set on all but the last byte; and each value's number of bytes."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), dtype=np.int64)
    for bits in range(7, 64, 7):
        more = values >= np.uint64(1 << bits)
        if not more.any():
            break
        sizes += more
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    starts = ends - sizes
    for j in range(int(sizes.max(initial=0))):
        has = np.flatnonzero(sizes > j)
        low = (values[has] >> np.uint64(7 * j)) & np.uint64(127)
        out[starts[has] + j] = low.astype(np.uint8) | np.where(sizes[has] > j + 1, 128, 0).astype(np.uint8)
    return out.tobytes(), sizes


def unpack_integers(data: bytes | memoryview) -> np.ndarray:
    """The values that pack_integers wrote."""
    raw = np.frombuffer(data, dtype=np.uint8)
    last = raw < 128
    if last.all():
        return raw.astype(np.int64)
    ends = np.flatnonzero(last)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), starts)


# ---------------------------------------------------------------- index


class _Numbers(dict):
    """Numbers for keys, in the order of their first lookup."""

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


INDEX = "shard string, docs long, terms long, doc_ids array<long>, sizes binary, names binary, dfs binary, gap_bytes binary, tf_bytes binary, gaps binary, tfs binary"


class _Shard:
    """Documents of one shard while they are gathered."""

    def __init__(self):
        self.numbers = _Numbers()
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.terms: list[np.ndarray] = []
        self.tfs: list[np.ndarray] = []
        self.postings = 0

    def add(self, doc: int | None, terms: Counter) -> None:
        n = len(terms)
        self.ids.append(doc)
        self.sizes.append(sum(terms.values()))
        self.terms.append(np.fromiter(map(self.numbers.__getitem__, terms), np.int32, n))
        self.tfs.append(np.fromiter(terms.values(), np.int32, n))
        self.postings += n

    def row(self, name: str) -> pa.RecordBatch:
        """An INDEX row: documents by id (null ids last), terms by their bytes, postings by document."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        names = sorted(self.numbers)
        rank = np.empty(len(names), dtype=np.int64)
        rank[[self.numbers[t] for t in names]] = np.arange(len(names))
        counts = np.array([len(self.terms[i]) for i in order], dtype=np.int64)
        doc = np.repeat(np.arange(len(order)), counts)
        none = [np.zeros(0, dtype=np.int32)]
        term, tf = rank[np.concatenate([self.terms[i] for i in order] or none)], np.concatenate([self.tfs[i] for i in order] or none)
        by = np.argsort(term, kind="stable")  # documents stay in order
        term, doc, tf = term[by], doc[by], tf[by]
        dfs = np.bincount(term, minlength=len(names))
        firsts = (np.cumsum(dfs) - dfs)[dfs > 0]
        gaps = np.diff(doc, prepend=-1)  # at least 1 within a term
        gaps[firsts] = doc[firsts] + 1
        gap_data, gap_sizes = pack_integers(gaps - 1)
        tf_data, tf_sizes = pack_integers(tf - 1)
        each = lambda sizes: pack_integers(np.add.reduceat(sizes, firsts) if len(firsts) else sizes)[0]
        sizes = [self.sizes[i] for i in order]
        row = [name, sum(n > 0 for n in sizes), sum(sizes), [self.ids[i] for i in order], pack_integers(np.array(sizes, dtype=np.int64))[0], b" ".join(names), pack_integers(dfs)[0], each(gap_sizes), each(tf_sizes), gap_data, tf_data]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 7]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in INDEX.split(", ")])


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """An index of all terms of all documents, one row per shard of the documents that a task read.

    Null texts have no terms. Documents without terms are in the index, but not among its ``docs``. An empty table has an
    empty index. Repeated rows and ids are documents of their own; null ids come after all others.
    """
    most_postings, most_docs = SHARD_POSTINGS, SHARD_DOCS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        part, made, shard = task.partitionId() if task else 0, 0, _Shard()
        for batch in batches:
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                terms = count_terms(t.as_py())
                if shard.ids and (shard.postings + len(terms) > most_postings or len(shard.ids) >= most_docs):
                    yield shard.row(f"{part}-{made}")
                    made, shard = made + 1, _Shard()
                shard.add(doc, terms)
        if shard.ids:
            yield shard.row(f"{part}-{made}")

    return docs.select(docs[key].cast("long").alias("doc_id"), text_column(docs, text).alias("text")).mapInArrow(run, INDEX)


# ---------------------------------------------------------------- search


class _Postings:
    """A shard's postings, unpacked as they are asked for."""

    def __init__(self, row: dict):
        self.ids = row["doc_ids"]
        self.sizes = unpack_integers(row["sizes"])
        self.names = {t: i for i, t in enumerate(row["names"].split(b" "))} if row["names"] else {}
        self.dfs = unpack_integers(row["dfs"])
        self.gap_ends, self.tf_ends = (np.concatenate([[0], np.cumsum(unpack_integers(row[c]))]) for c in ("gap_bytes", "tf_bytes"))
        self.gaps, self.tfs = memoryview(row["gaps"]), memoryview(row["tfs"])

    def get(self, term: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        """Numbers of the documents that hold the term, ascending, and its occurrences in them."""
        i = self.names.get(term)
        if i is None:
            return None
        docs = np.cumsum(unpack_integers(self.gaps[self.gap_ends[i] : self.gap_ends[i + 1]]) + 1) - 1
        return docs, unpack_integers(self.tfs[self.tf_ends[i] : self.tf_ends[i + 1]]) + 1


def length_factors(sizes: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """m of each document; terms > 0."""
    if int(sizes.max(initial=0)) * docs * LENGTH_SHARE >= 1 << 63:
        return np.array([100 - LENGTH_SHARE + LENGTH_SHARE * int(n) * docs // terms for n in sizes], dtype=np.int64)
    return 100 - LENGTH_SHARE + LENGTH_SHARE * sizes * docs // terms


class _Best:
    """The k best documents so far: a bounded heap keyed by score, then by descending id; null ids come last."""

    def __init__(self, k: int):
        self.k = k
        self.heap: list[tuple[int, float]] = []

    def least(self) -> int:
        """A score below which nothing gets in."""
        return self.heap[0][0] if len(self.heap) == self.k else 1

    def offer(self, scores: np.ndarray, ids: list[int | None]) -> None:
        for score, doc in zip(scores.tolist(), ids, strict=True):
            entry = (score, -math.inf if doc is None else -doc)
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, entry)
            elif entry > self.heap[0]:
                heapq.heapreplace(self.heap, entry)


def _merge(cursors: list[tuple[np.ndarray, np.ndarray, int]], ids: list[int | None], best: _Best) -> None:
    """One query over one shard. Cursors: (documents, what the term adds to each one's score, the most it adds)."""
    heap = [(int(docs[0]), i, 0) for i, (docs, _, _) in enumerate(cursors)]
    heapq.heapify(heap)
    while heap:
        first = heap[0][0]
        end = first + WINDOW
        taken, reach = [], 0
        while heap and heap[0][0] < end:
            _, i, at = heapq.heappop(heap)
            docs, adds, most = cursors[i]
            to = int(np.searchsorted(docs, end))
            taken.append((docs[at:to], adds[at:to]))
            reach += most
            if to < len(docs):
                heapq.heappush(heap, (int(docs[to]), i, to))
        least = best.least()
        if reach < least:
            continue
        scores = np.zeros(min(WINDOW, len(ids) - first), dtype=np.int64)
        for docs, adds in taken:
            scores[docs - first] += adds  # a cursor has a document once
        found = np.flatnonzero(scores >= least)
        if len(found) > best.k:
            kth = np.partition(scores[found], len(found) - best.k)[len(found) - best.k]
            found = found[scores[found] >= kth]
        best.offer(scores[found], [ids[first + j] for j in found.tolist()])


def _dfs(index: DataFrame, terms: frozenset[bytes]) -> dict[bytes, int]:
    """The number of documents that hold each of the terms; one row per term reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for names, dfs in zip(batch.column(0), batch.column(1), strict=True):
                for t, n in zip(names.as_py().split(b" "), unpack_integers(dfs.as_py()).tolist(), strict=False):
                    if t in terms:
                        counts[t] += n
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["term", "df"])

    rows = index.select("names", "dfs").mapInArrow(run, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    return {bytes(r["term"]): r["df"] for r in rows}


def weight(df: int, docs: int) -> int:
    return math.floor(WEIGHT_SCALE * math.log((2 * docs + 2) / (2 * df + 1)))


def blocks(queries: DataFrame, key: str, text: str) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Queries as (id, distinct terms), in blocks of bounded size; the driver holds one block at a time."""
    found, size = [], 0
    for row in queries.select(queries[key].cast("long"), text_column(queries, text)).toLocalIterator():
        terms = sorted(count_terms(row[1]))
        if not terms:
            continue
        if found and (len(found) >= BLOCK_QUERIES or size + len(row[1]) > BLOCK_CHARS):
            yield found
            found, size = [], 0
        found.append((row[0], terms))
        size += len(row[1])
    if found:
        yield found


RESULT = "query int, item_id long, doc_id long, score long"


def _search_block(index: DataFrame, queries: list[tuple[int | None, list[bytes]]], docs: int, terms: int, k: int) -> DataFrame:
    dfs = _dfs(index, frozenset(t for _, ts in queries for t in ts))
    weights = {t: w for t, df in dfs.items() if (w := weight(df, docs))}  # a term of weight 0 adds nothing
    wanted = [(item, [t for t in ts if t in weights]) for item, ts in queries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(k) for _ in wanted]
        for row in itertools.chain.from_iterable(b.slice(i, 1).to_pylist() for b in batches for i in range(b.num_rows)):
            shard = _Postings(row)
            units = LENGTH_UNIT * length_factors(shard.sizes, docs, terms)
            cursors = {}
            for t, w in weights.items():
                if found := shard.get(t):
                    adds = w * ((TF_SCALE * found[1]) // (TF_UNIT * found[1] + units[found[0]]))
                    cursors[t] = (found[0], adds, int(adds.max()))
            for (_, ts), heap in zip(wanted, best, strict=True):
                _merge([cursors[t] for t in ts if t in cursors], shard.ids, heap)
        rows = [(q, wanted[q][0], None if e[1] == -math.inf else -e[1], e[0]) for q, heap in enumerate(best) for e in heap.heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["query", "item_id", "doc_id", "score"])

    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return index.mapInArrow(run, RESULT).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(index: DataFrame, queries: DataFrame, k: int = K, key: str = "item_id", text: str = "text") -> DataFrame:
    """Each query's k documents of the highest scores above 0: item_id, rank (from 1), doc_id, score.

    ``index`` is a written table of build_index. Equal scores go by ascending doc_id, null ids last. Queries without terms
    (null, empty) and queries that no document shares a term with have no rows; repeated queries have rows each. A query's terms count once.
    """
    total = index.agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    found = [_search_block(index, block, total["docs"], total["terms"], k) for block in blocks(queries, key, text)] if total["docs"] else []
    if not found:
        return index.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """search over an index of docs, which is written to the shared folder."""
    return search(materialise(build_index(docs), "postings"), queries, k)

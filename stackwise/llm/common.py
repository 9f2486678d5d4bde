"""Shared helpers: the scratch folder, and vectorised hashing of words and word shingles.

Words are maximal runs of characters other than ASCII white space; A-Z count as a-z. Hashing works on the UTF-8
bytes of many texts at once, so no Python object is made per word.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes hashed at once; longer texts are cut at white space, and their parts joined again.
CHUNK_BYTES = 1 << 19
#: Bytes of a batch of rows that a task sends to Python; a task holds a few such batches on either side. A larger row is a batch of its own.
BATCH_BYTES = 8 << 20


# ---------------------------------------------------------------- scratch tables


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``); where none is set, a folder of our own if all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="stackwise-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str, batch: int | None = BATCH_BYTES, group: int | None = None) -> DataFrame:
    """Writes df once to the shared folder and reads it back: cuts lineage, survives lost executors.

    Rows go to Python in batches of ``batch`` bytes meanwhile (null: the session's own bound); that bound is put back.
    ``group``: bytes of a row group, for rows of megabytes: a task writes, and a reader decodes, a group at a time. By itself
    Parquet looks at the size only after 100 rows.
    """
    spark, bound = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    path = f"{scratch_dir(spark)}/stackwise/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(bound)
    spark.conf.set(bound, str(batch or before))
    groups = {"parquet.block.size": str(group), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"} if group else {}
    try:
        df.write.options(compression="zstd", **groups).parquet(path)
    finally:
        spark.conf.set(bound, before)
    return spark.read.schema(df.schema).parquet(path)


def spread(docs: DataFrame) -> DataFrame:
    """docs dealt evenly to all cores if it has fewer splits than there are; larger tables stay as they are read.

    Work on texts costs far more than moving them once, and a file of one row group is one split.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():  # dealt by a shuffle, which counting splits would run
        return docs
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, whose task gives its free memory back to the system when it ends: Spark keeps Python workers for the stages that follow."""

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
                trim(0)

    return released


def text_column(docs: DataFrame, name: str = "text"):
    """The text; null counts as empty."""
    return F.coalesce(docs[name].cast("string"), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int, row: int, unit: int = 1) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches with their column as a list: of about ``most`` units (``unit`` values each), where a row counts ``row`` more.

    Only one slice's values are Python objects at a time, and rows of empty values are bounded, too.
    """
    for batch in batches:
        values = batch.column(column)
        at = 0
        while at < batch.num_rows:
            found, size = [], 0
            while at + len(found) < batch.num_rows and size <= most:
                found.append(values[at + len(found)].as_py())
                size += len(found[-1] or "") // unit + row
            yield batch.slice(at, len(found)), found
            at += len(found)


# ---------------------------------------------------------------- hashing

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads each bit over all 64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_P = 0x9DDFEA08EB382D69  # odd, so that it has an inverse modulo 2**64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)
_BYTE_LOWER = _BYTE[_LOWER]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, base in (("up", _P), ("down", pow(_P, -1, 1 << 64))):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["up"], _powers["down"]


_ONLY_SPACE = np.zeros(256, dtype=bool)
_ONLY_SPACE[32] = True


def hash_words(data: bytes, exact: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash, first byte and end byte of each word of data; exact: only spaces part words, and A-Z differ from a-z."""
    raw = np.frombuffer(data, dtype=np.uint8)
    n = len(raw)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none
    inside = np.zeros(n + 2, dtype=np.int8)
    inside[1:-1] = ~(_ONLY_SPACE if exact else _SPACE)[raw]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    up, down = _power_table(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((_BYTE if exact else _BYTE_LOWER)[raw] * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts, ends


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices starts[0], ..., starts[0] + counts[0] - 1, starts[1], ... of runs laid end to end."""
    total = int(counts.sum())
    shift = starts - (np.cumsum(counts) - counts)
    return np.repeat(shift, counts) + np.arange(total)


def split_at_space(data: bytes, space: bytes = b"\t\n\v\f\r ") -> Iterator[bytes]:
    """data in parts of about CHUNK_BYTES, cut at white space only."""
    at = 0
    while len(data) - at > CHUNK_BYTES:
        cut = at + CHUNK_BYTES
        while cut < len(data) and data[cut] not in space:
            cut += 1
        yield data[at:cut]
        at = cut
    yield data[at:]


def _endings(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The last two bytes of each word as one number (a word of one byte counts a zero before it)."""
    low = _LOWER[np.frombuffer(data, dtype=np.uint8)].astype(np.int64)
    return low[ends - 1] + 256 * np.where(ends - starts > 1, low[np.maximum(ends - 2, 0)], 0)


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, where each text begins among them (one more offset than texts), and the words' endings."""
    found, tails, counts = [], [], np.zeros(len(texts) + 1, dtype=np.int64)
    group: list[bytes] = []
    first, size = 0, 0

    def add(data: bytes) -> tuple[np.ndarray, int]:
        hashes, starts, ends = hash_words(data)
        found.append(hashes)
        tails.append(_endings(data, starts, ends) if len(starts) else np.zeros(0, dtype=np.int64))
        return starts, len(starts)

    def flush(last: int) -> None:
        if group:
            starts, _ = add(b"\n".join(group))
            counts[first + 1 : last + 1] = np.diff(np.searchsorted(starts, np.cumsum([0] + [len(b) + 1 for b in group])))

    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        if len(data) > CHUNK_BYTES:
            flush(i)
            counts[i + 1] = sum(add(p)[1] for p in split_at_space(data))
            group, first, size = [], i + 1, 0
            continue
        if size + len(data) > CHUNK_BYTES:
            flush(i)
            group, first, size = [], i, 0
        group.append(data)
        size += len(data) + 1
    flush(len(texts))
    if not found:
        found, tails = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    return np.concatenate(found), np.cumsum(counts), np.concatenate(tails)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The first two of words_of."""
    return words_of(texts)[:2]


def shingle_hashes(texts: list[str | None], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, repeats included, and offsets as above.

    A text of fewer words has one shingle of all its words; a text without words has none.
    """
    words, at = word_hashes(texts)
    n = np.diff(at)
    full = np.maximum(n - k + 1, 0)
    starts = np.repeat(at[:-1] - np.concatenate([[0], np.cumsum(full)[:-1]]), full) + np.arange(full.sum())
    hashes = np.zeros(len(starts), dtype=np.uint64)
    for j in range(k):
        hashes = hashes * _GOLD + words[starts + j]
    hashes = mix(hashes)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        ones = np.zeros(len(short), dtype=np.uint64)
        for j in range(k - 1):
            has = n[short] > j
            ones[has] = ones[has] * _GOLD + words[at[:-1][short[has]] + j]
        ones = mix(ones ^ _M2)
        before = np.concatenate([[0], np.cumsum(full)[:-1]])
        hashes = np.insert(hashes, before[short], ones)
        full[short] = 1
    return hashes, np.concatenate([[0], np.cumsum(full)])

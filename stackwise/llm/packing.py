"""Packing documents into sequences by shortest-pack-first over the length histogram.

Texts are tokenised once; each is cut into whole sequences and one rest. The rests' lengths are counted (at most
``length`` - 1 bins, whatever the number of documents), and the histogram is packed on the driver, longest lengths first,
each into the open pattern with the fewest tokens, if it has room. The result is a few patterns with counts; a rest finds
its pattern by its rank among the rests of its length.
"""

from __future__ import annotations

import bisect
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, text_column

LENGTH = 1024
END = 0
#: How byte-level BPE cuts a text before merging: a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Tokens of a batch that goes back to Spark.
BATCH_TOKENS = 1 << 20
#: Documents and tokens up to which neighbours are packed together by pack_in_order.
GROUP_DOCS, GROUP_TOKENS = 4096, 1 << 22
#: Ranks of parts up to so many numbers are broadcast, more are joined by shuffling.
BROADCAST_NUMBERS = 2_000_000


def _byte_of() -> dict[str, int]:
    """Byte-level BPE writes each byte as one printable character: itself if printable in Latin-1, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Byte-level BPE ids of texts, as the tokenizers library gives them for the same file.

    Where the file's vocabulary is ranked by its ids (each merge makes the next id), the merges run in tiktoken, which gives
    the same ids several times as fast; else in tokenizers itself. So are texts that hold an added token's string, which has
    an id of its own, and those that tiktoken gives up on (runs of about a million white-space characters).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        plain = pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre.get("use_regex", True) and spec["normalizer"] is None
        self.added = [a["content"] for a in spec["added_tokens"]]
        self.ranked = self._ranked(model) if plain and model["type"] == "BPE" else None

    @staticmethod
    def _ranked(model: dict):
        import tiktoken

        merges = [m if isinstance(m, str) else " ".join(m) for m in model.get("merges", [])]
        vocab, first = model["vocab"], 256
        if any(vocab.get(m.replace(" ", "", 1)) != first + i for i, m in enumerate(merges)):
            return None
        to = _byte_of()
        ranks = {bytes(to[c] for c in w): i for w, i in vocab.items() if i < first + len(merges)}
        return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        ids = None
        if self.ranked and not any(a in text for a in self.added):
            try:
                ids = self.ranked.encode_to_numpy(text, disallowed_special=())
            except ValueError:  # its regular expressions can't backtrack so far
                pass
        if ids is None:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, dtype="<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = Encoder(path)
    return _encoders[path]


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, part int, place long"


def cut_pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of documents with their ids; ``part`` is the task, ``place`` the piece's rank among the task's pieces of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, enc = TaskContext.get(), encoder(tokenizer)
        part = task.partitionId() if task else 0
        seen = np.zeros(length + 1, dtype=np.int64)
        tail = np.array([end], dtype="<u4").tobytes()

        out: dict[str, list] = {n: [] for n in ("doc_id", "start", "length", "ids", "doc_tokens", "place")}
        size = 0
        for batch in batches:
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.encode(t.as_py()) + tail
                n = len(ids) // 4
                for start in range(0, n, length):
                    m = min(length, n - start)
                    for name, x in zip(out, (doc, start, m, ids[4 * start : 4 * (start + m)], n, int(seen[m])), strict=True):
                        out[name].append(x)
                    seen[m] += 1
                    size += m
                    if size >= BATCH_TOKENS:
                        yield _batch(out, part)
                        out, size = {k: [] for k in out}, 0
        if size:
            yield _batch(out, part)

    return docs.select(docs[key].cast("long").alias("doc_id"), text_column(docs, text).alias("text")).mapInArrow(run, PIECES)


def _batch(out: dict[str, list], part: int) -> pa.RecordBatch:
    n = len(out["doc_id"])
    return pa.RecordBatch.from_arrays([*(pa.array(out[c], type=pa.binary() if c == "ids" else pa.int64()) for c in ("doc_id", "start", "length", "ids", "doc_tokens")), pa.array([part] * n, type=pa.int32()), pa.array(out["place"], type=pa.int64())], names=["doc_id", "start", "length", "ids", "doc_tokens", "part", "place"])


def pack_histogram(counts: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, longest first) with how many sequences follow each.

    Lengths are placed longest first. n pieces of length x go into the open patterns with the fewest tokens that have room,
    each taking as many of the pieces as it has sequences (a pattern with more sequences than pieces is split); what is
    left opens a new pattern.
    """
    open_: dict[int, list[list]] = {}  # tokens -> patterns [lengths, count]
    sizes: list[int] = []
    for x in sorted(counts, reverse=True):
        left = counts[x]
        while left:
            if not sizes or sizes[0] + x > length:
                tokens, lengths, n = 0, (), left
            else:
                tokens = sizes[0]
                lengths, n = open_[tokens].pop()
                if n > left:
                    open_[tokens].append([lengths, n - left])
                    n = left
                if not open_[tokens]:
                    del open_[tokens]
                    sizes.pop(0)
            left -= n
            if tokens + x not in open_:
                open_[tokens + x] = []
                bisect.insort(sizes, tokens + x)
            open_[tokens + x].append([(*lengths, x), n])
    return [(tuple(p), n) for tokens in sorted(open_, reverse=True) for p, n in open_[tokens]]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, end rank, first sequence, offset): pieces of a length, by rank, lie in consecutive sequences."""
    rows, taken, sequence = [], {}, 0
    for lengths, n in patterns:
        offset = 0
        for x in lengths:
            rank = taken.get(x, 0)
            rows.append((x, rank, rank + n, sequence, offset))
            taken[x] = rank + n
            offset += x
        sequence += n
    return rows


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents with their place in a sequence.

    Returns doc_id, start, length, ids (binary: little-endian unsigned 32-bit), doc_tokens, sequence_id, offset. Null texts
    count as empty: one piece, the end id alone. Repeated rows and ids are documents of their own. An empty table gives an
    empty result. Only counts are shuffled: tokens stay where they were written.
    """
    spark = docs.sparkSession
    pieces = materialise(cut_pieces(docs, tokenizer, length, end, key, text), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # length rows at most
    table = slots(pack_histogram(histogram, length))
    before = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    before = before.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("length", "before"))).alias("befores"))
    small = counts.count() <= BROADCAST_NUMBERS
    ranked = pieces.join(F.broadcast(before) if small else before, "part").withColumn("rank", F.col("place") + F.element_at("befores", F.col("length"))).drop("befores")
    by_length: dict[int, list[tuple[int, int, int, int]]] = {}
    for x, *row in table:
        by_length.setdefault(x, []).append(tuple(row))
    # one row per length; the slots are as many as the patterns' pieces, a bound of the histogram's size
    where = spark.createDataFrame(sorted(by_length.items()), "length long, slots array<struct<first: long, end: long, sequence: long, offset: long>>")
    at = F.element_at(F.filter("slots", lambda s: (s["first"] <= F.col("rank")) & (F.col("rank") < s["end"])), 1)
    placed = ranked.join(F.broadcast(where), "length").withColumn("at", at)
    return placed.select("doc_id", "start", "length", "ids", "doc_tokens", (F.col("at.sequence") + F.col("rank") - F.col("at.first")).alias("sequence_id"), F.col("at.offset").alias("offset"))


def digest(packed: DataFrame) -> DataFrame:
    """pack's result with the ids' CRC-32 in place of the ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


GROUPED = "doc_id long, start long, length long, ids binary, doc_tokens long, file string, first long, sequence long, offset long"


def _group(found: list[tuple[int | None, bytes]], length: int, file: str, first: int) -> pa.RecordBatch:
    """GROUPED rows of neighbours (document, ids), packed among themselves; sequences are numbered by their first document."""
    pieces = [(doc, at, min(length, n - at), ids[4 * at : 4 * (at + length)], n) for doc, ids in found for n in [len(ids) // 4] for at in range(0, n, length)]
    places: dict[int, list[tuple[int, int]]] = {}
    for x, rank, end, sequence, offset in slots(pack_histogram(Counter(p[2] for p in pieces), length)):
        places.setdefault(x, []).extend((sequence + i, offset) for i in range(end - rank))
    taken: Counter = Counter()
    numbers: dict[int, int] = {}
    sequences, offsets = [], []
    for piece in pieces:
        sequence, offset = places[piece[2]][taken[piece[2]]]
        taken[piece[2]] += 1
        sequences.append(numbers.setdefault(sequence, len(numbers)))
        offsets.append(offset)
    doc, start, size, ids, n = zip(*pieces, strict=True)
    longs = [pa.array(x, pa.int64()) for x in (doc, start, size, n, [first] * len(pieces), sequences, offsets)]
    return pa.RecordBatch.from_arrays([*longs[:3], pa.array(ids, pa.binary()), longs[3], pa.array([file] * len(pieces), pa.string()), *longs[4:]], names=["doc_id", "start", "length", "ids", "doc_tokens", "file", "first", "sequence", "offset"])


def _file_order(name: str) -> tuple[int, int, str]:
    """Files in the order in which Spark's writers made them from an ordered table."""
    part, more = re.match(r"part-(\d+)-", name), re.search(r"-c(\d+)\.", name)
    return int(part[1]) if part else -1, int(more[1]) if more else -1, name


def pack_in_order(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As pack, for ``docs`` as read from Parquet files that were written in an order: sequences follow it.

    Neighbours in a file, up to GROUP_DOCS documents or GROUP_TOKENS tokens, are packed among themselves by the task that reads
    them, and their sequences are numbered by their first documents; groups follow the files' order and the rows in them,
    however Spark deals the files to tasks. So the documents of the first sequences are the first documents, to one group. No
    row is shuffled; the driver gets one row per group.
    """
    most_docs, most_tokens = GROUP_DOCS, GROUP_TOKENS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail = encoder(tokenizer), np.array([end], dtype="<u4").tobytes()
        found, size, file, first = [], 0, None, 0
        for batch in batches:
            for doc, t, f, row in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if found and (f != file or row != first + len(found) or len(found) >= most_docs or size >= 4 * most_tokens):
                    yield _group(found, length, file, first)
                    found, size = [], 0
                if not found:
                    file, first = f, row
                found.append((doc, enc.encode(t.as_py()) + tail))
                size += len(found[-1][1])
        if found:
            yield _group(found, length, file, first)

    spark = docs.sparkSession
    rows = docs.select(docs[key].cast("long").alias("doc_id"), text_column(docs, text).alias("text"), docs["_metadata.file_name"].alias("file"), docs["_metadata.row_index"].alias("row"))
    pieces = materialise(rows.mapInArrow(run, GROUPED), "pieces")
    groups = sorted(pieces.groupBy("file", "first").agg((F.max("sequence") + 1).alias("n")).collect(), key=lambda r: (_file_order(r["file"]), r["first"]))
    before, total = [], 0
    for r in groups:
        before.append((r["file"], r["first"], total))
        total += r["n"]
    base = spark.createDataFrame(before, "file string, first long, before long")
    placed = pieces.join(F.broadcast(base) if len(before) <= BROADCAST_NUMBERS else base, ["file", "first"])
    return placed.select("doc_id", "start", "length", "ids", "doc_tokens", (F.col("before") + F.col("sequence")).alias("sequence_id"), "offset")

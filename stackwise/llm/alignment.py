"""Alignment of two tokenizers' tokens by the bytes they cover.

A text's bytes get one label each: ``.``, or that a token of A, of B or of both ends there. A regular expression takes the
spans up to each place where both end; the labels in a span count the tokens of its group. Every stretch between two ends is
covered by one token of A and one of B, so the labels other than ``.`` are the links, one each.

Both tokenizers cut a text at single spaces between other characters, so it is encoded as units, a space and what follows.
A task encodes each distinct unit once and writes chunks: the units of many documents with their links' id pairs, and the
documents as numbers of units. Spark sums the pairs of all chunks, hands each chunk the counts of its own pairs, and a
second pass adds them up by document. No table of all pairs is sent to any task or to the driver.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BATCH_BYTES, materialise, ragged, releasing, spread, text_column
from .packing import _byte_of

#: A chunk ends at so many units or documents: some 2 MB. Distinct units that a task remembers, and their characters; then it starts anew.
CHUNK_UNITS, CHUNK_DOCS, DISTINCT, DISTINCT_CHARS = 1 << 18, 1 << 14, 250_000, 1 << 24
#: Characters of texts that are encoded at once.
SLICE = 1 << 20
_CUT = re.compile(r"(?<=\S)(?= \S)")
_SPANS = re.compile(rb"[^*]*\*")
_MARK = "▁"


class Aligner:
    """Ids of units by both tokenizers, with their groups and links."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        from .packing import Encoder

        self.a = Encoder(path_a)
        self.a.tokenizer.encode_special_tokens = True
        self.a.added = []  # their strings in a text are plain text
        to = _byte_of()
        vocab = self.a.tokenizer.get_vocab(with_added_tokens=False)
        self.a_size = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        for token, i in vocab.items():
            self.a_size[i] = sum(c in to for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        n = self.b.get_piece_size()
        pieces = self.b.id_to_piece(list(range(n)))
        if any(_MARK in p.lstrip(_MARK) for p in pieces):
            raise ValueError(f"pieces of {path_b} span several words")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_MARK, " ").encode("utf-8") for i, p in enumerate(pieces)]
        self.b_size = np.fromiter(map(len, self.b_bytes), np.int64, n)

    def parts(self, text: str) -> Iterator[list[str]]:
        """A space and text, cut before single spaces between other characters: the units, part by part."""
        text, at = " " + text, 0
        while len(text) - at > SLICE and (cut := _CUT.search(text, at + SLICE)):
            yield _CUT.split(text[at : cut.start()])
            at = cut.start()
        yield _CUT.split(text[at:])

    def encode_a(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units, laid end to end, and how many each has. Units that begin or end in more white space are encoded alone."""
        alone = [u[-1].isspace() or u[1:2].isspace() for u in units]
        joined = "".join(u for u, x in zip(units, alone, strict=True) if not x)
        ids = np.frombuffer(self.a.encode(joined), "<u4").astype(np.int64)
        edges = np.cumsum(np.fromiter((len(u.encode("utf-8")) for u, x in zip(units, alone, strict=True) if not x), np.int64))
        counts = np.diff(np.searchsorted(np.cumsum(self.a_size[ids]), edges) + 1, prepend=0)
        if not any(alone):
            return ids, counts
        parts = iter(np.split(ids, np.cumsum(counts)[:-1])) if len(counts) else iter(())
        each = [np.frombuffer(self.a.encode(u), "<u4").astype(np.int64) if x else next(parts) for u, x in zip(units, alone, strict=True)]
        return np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))

    def encode(self, units: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Of each unit: its groups as text; rows of its tokens of A and of B, its groups and its links; all links, as a << 32 | b.

        A unit whose bytes B doesn't keep has -1 tokens of A, and nothing else.
        """
        ids_b = self.b.encode([u[1:] for u in units], num_threads=1)
        kept = [i for i, (u, ids) in enumerate(zip(units, ids_b, strict=True)) if b"".join(map(self.b_bytes.__getitem__, ids)) == u.encode("utf-8")]
        texts, sizes = [""] * len(units), np.zeros((4, len(units)), dtype=np.int64)
        sizes[0] = -1
        if not kept:
            return texts, sizes, np.zeros(0, dtype=np.int64)
        a, n_a = self.encode_a([units[i] for i in kept])
        b = np.fromiter(chain.from_iterable(ids_b[i] for i in kept), np.int64)
        raw = np.zeros(int(self.a_size[a].sum()), dtype=np.uint8)
        unit_ends = np.cumsum(self.a_size[a])[np.cumsum(n_a) - 1]
        raw[np.cumsum(self.a_size[a]) - 1] = 1
        raw[np.cumsum(self.b_size[b]) - 1] += 2
        spans = _SPANS.findall(np.frombuffer(b".AB*", dtype=np.uint8)[raw].tobytes())
        text_a, text_b = map(str, a.tolist()), map(str, b.tolist())
        groups = []
        for span in spans:
            x, y = span.count(b"A"), span.count(b"B")
            if x or y:
                groups.append(",".join([next(text_a) for _ in range(x + 1)]) + "|" + ",".join([next(text_b) for _ in range(y + 1)]))
            else:
                groups.append(next(text_a) + "|" + next(text_b))
        group_ends = np.searchsorted(np.flatnonzero(raw == 3), unit_ends)
        # a link at each label, of the tokens that it lies in
        at = np.flatnonzero(raw)
        in_a, in_b = raw[at] & 1, raw[at] >> 1
        links = a[np.cumsum(in_a) - in_a] << 32 | b[np.cumsum(in_b) - in_b]
        first = 0
        for i, end in zip(kept, group_ends.tolist(), strict=True):
            texts[i] = ";".join(groups[first:end])
            first = end
        sizes[:, kept] = n_a, [len(ids_b[i]) for i in kept], np.diff(group_ends, prepend=0), np.diff(np.searchsorted(at, unit_ends), prepend=0)
        return texts, sizes, links


class _Units:
    """Distinct units, numbered as they come, with what Aligner.encode gives for them."""

    def __init__(self, encode: Aligner):
        self.aligner = encode
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.texts: list[str] = []
        self.sizes = np.zeros((4, 1 << 16), dtype=np.int64)
        self.links: list[np.ndarray] = []
        self.chars = 0

    def full(self) -> bool:
        return len(self.texts) >= DISTINCT or self.chars >= DISTINCT_CHARS

    def number(self, lists: list[list[str]]) -> list[np.ndarray]:
        """Numbers of the units of each list."""
        known = self.numbers
        new = [u for u in dict.fromkeys(chain.from_iterable(lists)) if u not in known]
        if new:
            texts, sizes, links = self.aligner.encode(new)
            n = len(self.texts)
            while self.sizes.shape[1] < n + len(new):
                self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)], axis=1)
            self.sizes[:, n : n + len(new)] = sizes
            self.texts += texts
            self.links.append(links)
            known.update(zip(new, range(n, n + len(new)), strict=True))
            self.chars += sum(map(len, new))
        return [np.fromiter(map(known.__getitem__, units), np.int32, len(units)) for units in lists]


_units: dict[tuple[str, str], _Units] = {}


def units_of(path_a: str, path_b: str) -> _Units:
    if (path_a, path_b) not in _units:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _units[path_a, path_b] = _Units(Aligner(path_a, path_b))
    return _units[path_a, path_b]


CHUNK = "part long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, n_units array<long>, units binary, unit_links binary, links binary, pair array<long>, n array<long>"


class _Chunk:
    """Documents of one chunk while they are gathered, as numbers of units."""

    def __init__(self):
        self.docs: list[int | None] = []
        self.rows: list[tuple[int, int, int, int]] = []
        self.digests: list[str] = []
        self.units: list[np.ndarray] = []
        self.size = 0

    def full(self) -> bool:
        return self.size >= CHUNK_UNITS or len(self.docs) >= CHUNK_DOCS

    def add(self, doc: int | None, numbers: np.ndarray, known: _Units) -> None:
        sizes = known.sizes[:, numbers]
        if (sizes[0] < 0).any():  # bytes aren't kept
            numbers, sizes = numbers[:0], sizes[:, :0]
        self.docs.append(doc)
        self.rows.append(tuple(sizes.sum(axis=1).tolist()))
        self.units.append(numbers)
        self.size += len(numbers)
        digest = hashlib.sha256()
        for at in range(0, len(numbers), SLICE):
            digest.update((";" * (at > 0) + ";".join(map(known.texts.__getitem__, numbers[at : at + SLICE].tolist()))).encode("ascii"))
        self.digests.append(digest.hexdigest() if len(numbers) else "")

    def row(self, part: int, known: _Units) -> pa.RecordBatch:
        """A CHUNK row: only the units that occur, and the distinct pairs among their links with how often they are linked."""
        units = np.concatenate(self.units)
        times = np.bincount(units, minlength=len(known.texts))
        used = np.flatnonzero(times)
        renumbered = (np.cumsum(times > 0) - 1).astype("<i4")[units]
        counts = known.sizes[3, : len(known.texts)]
        unit_links = counts[used]
        all_links = np.concatenate(known.links) if known.links else np.zeros(0, dtype=np.int64)
        pair, links = np.unique(all_links[ragged((np.cumsum(counts) - counts)[used], unit_links)], return_inverse=True)
        n = np.bincount(links, weights=np.repeat(times[used], unit_links), minlength=len(pair)).astype(np.int64)
        longs = [self.docs, *(zip(*self.rows, strict=True))]
        row = [part, *map(list, longs), self.digests, [len(u) for u in self.units], renumbered.tobytes(), unit_links.astype("<i4").tobytes(), links.astype("<i4").tobytes(), pair, n]
        kinds = [pa.int64(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), pa.list_(pa.int64()), *[pa.binary()] * 3, *[pa.list_(pa.int64())] * 2]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in CHUNK.split(", ")])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int | None, str]]]:
    """Rows (document, text) of about SLICE characters; a longer text is alone."""
    found, size = [], 0
    for batch in batches:
        for doc, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = t.as_py()
            if found and size + len(text) > SLICE:
                yield found
                found, size = [], 0
            found.append((doc, text))
            size += len(text) + 64  # rows of empty texts are bounded, too
    if found:
        yield found


def cut_chunks(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """CHUNK rows of all documents; nothing is shuffled, but for tables of few splits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, known = TaskContext.get(), units_of(tokenizer_a, tokenizer_b)
        part, chunk = (task.partitionId() if task else 0) << 32, _Chunk()
        for rows in _slices(batches):
            if len(rows) == 1:
                parts = known.aligner.parts(rows[0][1]) if rows[0][1] else ()
                numbers = [np.concatenate([np.zeros(0, dtype=np.int32), *(known.number([units])[0] for units in parts)])]
            else:
                numbers = known.number([next(known.aligner.parts(t)) if t else [] for _, t in rows])
            for (doc, _), units in zip(rows, numbers, strict=True):
                chunk.add(doc, units, known)
            if chunk.full() or known.full():
                yield chunk.row(part, known)
                part, chunk = part + 1, _Chunk()
                if known.full():
                    known.clear()
        if chunk.docs:
            yield chunk.row(part, known)
        known.clear()  # the worker stays for later stages

    return spread(docs.select(docs[key].cast("long").alias("doc_id"), text_column(docs, text).alias("text"))).mapInArrow(releasing(run), CHUNK)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """Of each pair (a << 32 | b) that is linked: ``count``, how many links of all documents hold it, and ``best``, whether no pair of the same b has more.

    A window has the pairs of one b, at most as many as A has tokens.
    """
    counts = chunks.select(F.explode(F.arrays_zip("pair", "n")).alias("x")).groupBy(F.col("x.pair").alias("pair")).agg(F.sum("x.n").alias("count"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy(F.col("pair").bitwiseAND(0xFFFFFFFF))))


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the runs of values that end before ``ends``."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[ends], prepend=0)


def _with_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents, from chunks with the counts of their pairs."""
    names = [c.split()[0] for c in RESULT.split(", ")]
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in batch.schema.names}
            units, unit_links, links = (np.frombuffer(row[c].as_py(), "<i4").astype(np.int64) for c in ("units", "unit_links", "links"))
            doc_ends = np.cumsum(row["n_units"].values.to_numpy(zero_copy_only=False))
            sums = []
            for name in ("best", "count"):
                of_pair = np.zeros(0, dtype=np.int64)
                if row["found"].is_valid:
                    of_pair = row["found"].values.field(name).to_numpy(zero_copy_only=False).astype(np.int64)
                sums.append(pa.array(_sums(_sums(of_pair[links], np.cumsum(unit_links))[units], doc_ends), pa.int64()))
            lists = {c: row[c].values for c in names if c in row}
            yield pa.RecordBatch.from_arrays([*(lists[c] for c in names[:5]), *sums, lists["groups_sha256"]], names=names)


def align(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups and links of the tokens of each text (with a space before it) by two tokenizers: byte-level BPE (A) and pieces with byte fallback (B).

    Returns doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: as contracted, one row per document.
    Null and empty texts, and texts whose bytes B doesn't keep (those holding U+2581), have no tokens: zeros and an empty
    digest. Repeated rows and ids are documents of their own. An empty table gives an empty result.
    Memory is bounded by chunks and batches of them, however many chunks a task or partition has.
    """
    chunks = materialise(cut_chunks(docs, tokenizer_a, tokenizer_b, key, text), "alignment", group=BATCH_BYTES)
    own = chunks.select("part", F.posexplode("pair").alias("pos", "pair"))
    found = own.join(pair_counts(chunks), "pair").groupBy("part").agg(F.sort_array(F.collect_list(F.struct("pos", "count", "best"))).alias("found"))
    # written here, for Python gets a partition's chunks in batches of bounded size only while materialise holds that bound
    return materialise(chunks.drop("pair", "n").join(found, "part", "left").mapInArrow(releasing(_with_counts), RESULT), "aligned")


def groups(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the groups themselves, ``a1,a2|b1;a3|b2,b3``; empty for texts without tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = units_of(tokenizer_a, tokenizer_b)
        for batch in batches:
            for i in range(batch.num_rows):
                value = batch.column(1)[i].as_py()
                numbers = [n for units in (known.aligner.parts(value) if value else ()) for n in known.number([units])[0].tolist()]
                kept = all(known.sizes[0, n] >= 0 for n in numbers)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([";".join(known.texts[n] for n in numbers) if kept else ""], pa.string())], names=["doc_id", "groups"])
                if known.full():
                    known.clear()

    return docs.select(docs[key].cast("long").alias("doc_id"), text_column(docs, text).alias("text")).mapInArrow(run, "doc_id long, groups string")

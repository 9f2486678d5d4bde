"""Byte-pair encoding with word ends, and decoding, by dynamic programming over prefixes.

A word's encoding is found from left to right. Among the tokens that end at a prefix, exactly one is the last token of that
prefix's own encoding: the one that may follow the last token of the prefix before it. An automaton over all tokens gives
the tokens that end at each place, a test of the two tokens' merges tells whether they may be neighbours, and following the
stored tokens back from the word's end gives its ids. Time is linear in the word, whatever its length.

Two tokens may be neighbours if merging their joint text leaves the border between them alone. The pairs that ever meet at
the border consist of a token on the left one's right spine (itself, its second part, that one's second part, ...) and one
on the right one's left spine; the border falls if such a pair has a merge of a lower rank than those that use up its parts.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import spread, text_column
from .packing import _byte_of

#: Words up to this length are remembered, up to so many (about 200 bytes each); then the memory starts anew.
SHORT, REMEMBERED = 24, 1_000_000
#: Pairs of tokens whose test is remembered.
PAIRS = 500_000
#: Characters of a text whose words are found at once.
PART = 1 << 20
#: Last characters of words count as symbols of their own, this far above the others.
WORD_END = 256
#: The tokenizer's white space.
_SPACES = "".join(map(chr, [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_SPACE = re.compile(f"[{_SPACES}]+")
#: Below this character Python and the tokenizer agree on letters, numbers and lower case, no characters compose, and no letter's lower case is a letter beyond it.
_LATIN = 0x180
_BEYOND = re.compile(f"[^\\0-{chr(_LATIN - 1)}]")
_NEVER = 1 << 60


class _Words(dict):
    """Words' ids, made when they are first asked for; long words' aren't kept."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> bytes:
        ids = self.make(word)
        if len(word) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids


class _Pairs(dict):
    """Whether two tokens, left << 20 | right, may be neighbours; tested when first asked for."""

    def __init__(self, test: Callable[[int, int], bool]):
        super().__init__()
        self.test = test

    def __missing__(self, pair: int) -> bool:
        if len(self) >= PAIRS:
            self.clear()
        self[pair] = fits = self.test(pair >> 20, pair & 0xFFFFF)
        return fits


class WordBpe:
    """Ids of texts, as the tokenizers library gives them for the same file.

    Takes files of this form: BPE with a suffix at word ends, words found by a pattern, bytes written as characters, no
    decoder (tokens are joined by spaces). Latin texts are prepared here; other chunks are normalised and cut by the file's
    own normalizer and pre-tokenizer, whose tables of characters differ from Python's.
    """

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        steps = pre.get("pretokenizers", [])
        normal = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        fits = model["type"] == "BPE" and model["end_of_word_suffix"] and not (model["dropout"] or model["unk_token"] or model["continuing_subword_prefix"] or model.get("ignore_merges")) and spec["decoder"] is None and spec["post_processor"] is None
        fits = fits and [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
        fits = fits and normal == ["NFC", "Replace", "Lowercase"] and not any(a["normalized"] or a["single_word"] or a["lstrip"] or a["rstrip"] for a in spec["added_tokens"])
        if not fits:
            raise ValueError(f"not a tokenizer of the form that WordBpe takes: {path}")
        self.ascii, self.latin = (self._pattern(steps[0]["pattern"]["Regex"], end) for end in (128, _LATIN))
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.added_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.names = {i: t for t, i in (model["vocab"] | self.added).items()}
        self._byte = _byte_of()

        suffix, vocab = model["end_of_word_suffix"], model["vocab"]
        size = max(vocab.values()) + 1
        self.rank, self.first, self.second = [-1] * size, [0] * size, [0] * size
        self.merged: dict[int, int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            t, a, b = vocab[a + b], vocab[a], vocab[b]
            if self.rank[t] >= 0 or max(self.rank[a], self.rank[b]) >= r:
                raise ValueError(f"merges of {path} aren't in the order in which tokens are made")
            self.rank[t], self.first[t], self.second[t] = r, a, b
            self.merged[a << 20 | b] = r
        self._neighbours = _Pairs(self._border_stays)
        whole = [True] * size  # tokens that their own text is encoded as
        for t in sorted((i for i in vocab.values() if self.rank[i] >= 0), key=self.rank.__getitem__):
            a, b = self.first[t], self.second[t]
            whole[t] = whole[a] and whole[b] and self._border_stays(a, b, self.rank[t])
        self._size = [0] * size
        automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            if whole[i]:
                key = self._symbols(token.removesuffix(suffix), token.endswith(suffix))
                automaton.add_word(key, i)
                self._size[i] = len(key)
        automaton.make_automaton()
        self._tokens_ending = automaton.iter
        self._words = _Words(self._word)

    @staticmethod
    def _pattern(pattern: str, end: int) -> re.Pattern:
        """The file's pattern for texts of characters below ``end``, its classes spelt out."""
        classes = {kind: "".join(re.escape(chr(c)) for c in range(end) if unicodedata.category(chr(c))[0] == kind) for kind in "LN"}
        return re.compile(pattern.replace(r"\p{L}", classes["L"]).replace(r"\p{N}", classes["N"]).replace(r"\s", _SPACES))

    def _symbols(self, word: str, ends: bool = True) -> str:
        """A byte-level word as one character a byte, its last one marked."""
        raw = [self._byte[c] for c in word]
        if ends:
            raw[-1] += WORD_END
        return "".join(map(chr, raw))

    def _border_stays(self, a: int, b: int, end: int = _NEVER) -> bool:
        """Whether merges of ranks below ``end`` leave the border between tokens a and b alone."""
        rank, merged = self.rank, self.merged
        a_until = b_until = end  # the ranks of the merges that use a and b up
        while True:
            r = merged.get(a << 20 | b)
            if r is not None and r < a_until and (r < b_until or r == b_until < end):  # of equal ranks the left pair is merged first
                return False
            if rank[a] > rank[b]:
                a_until, a = rank[a], self.second[a]
            elif rank[b] >= 0:
                b_until, b = rank[b], self.first[b]
            else:
                return True

    def _word(self, word: str) -> bytes:
        """A word's ids."""
        raw = word if word.isascii() else word.encode("utf-8").decode("latin-1")
        symbols = raw[:-1] + chr(ord(raw[-1]) + WORD_END)
        last = [-1] * len(symbols) if len(symbols) <= SHORT else array("i", [-1]) * len(symbols)
        size, fits = self._size, self._neighbours
        for at, token in self._tokens_ending(symbols):  # longest first
            if last[at] < 0:
                n = size[token]
                if n > at or fits[last[at - n] << 20 | token]:
                    last[at] = token
        ids, at = array("I"), len(symbols) - 1
        while at >= 0:
            ids.append(last[at])
            at -= size[last[at]]
        ids.reverse()
        return np.asarray(ids, "<u4").tobytes() if sys.byteorder != "little" else ids.tobytes()

    def _split(self, text: str) -> list[str]:
        """The words of a text without added tokens."""
        if text.isascii():
            return self.ascii.findall(text.lower())
        if not _BEYOND.search(text):
            return self.latin.findall(text.lower())
        found = []
        for chunk in _SPACE.split(text):
            if _BEYOND.search(chunk):
                words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))
                found += [bytes(map(self._byte.__getitem__, w)).decode("utf-8") for w, _ in words]
            else:
                found += self.latin.findall(chunk.lower())
        return found

    def _plain(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        return b"".join(map(self._words.__getitem__, self._split(text)))

    def encode_parts(self, text: str) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of a text, part by part."""
        for i, piece in enumerate(self.added_pattern.split(text) if self.added_pattern and any(a in text for a in self.added) else [text]):
            if i % 2:
                yield np.array([self.added[piece]], "<u4").tobytes()
                continue
            at = 0
            while len(piece) - at > PART:
                cut = _SPACE.search(piece, at + PART)
                end = cut.start() if cut else len(piece)
                yield self._plain(piece[at:end])
                at = end
            yield self._plain(piece[at:])

    def encode(self, text: str) -> bytes:
        return b"".join(self.encode_parts(text))

    def decode(self, ids: bytes) -> str:
        """The tokens' strings, joined by spaces."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[str, WordBpe] = {}


def codec(path: str) -> WordBpe:
    if path not in _codecs:
        _codecs[path] = WordBpe(path)
    return _codecs[path]


def encode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit) of every document.

    Null texts count as empty and have no ids. Added tokens' strings in a text are those tokens. Repeated rows and ids are
    documents of their own; an empty table gives an empty result. No row is shuffled, but for tables of few splits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(tokenizer)
        for batch in batches:
            for i in range(batch.num_rows):
                ids = bpe.encode(batch.column(1)[i].as_py())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([len(ids) // 4], pa.int64()), pa.array([ids], pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return _rows(docs, key, text).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and text of encode's result; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(tokenizer)
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([bpe.decode(batch.column(1)[i].as_py() or b"")], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return spread(docs.select(docs[key].cast("long").alias("doc_id"), text_column(docs, text).alias("text")))


def digest(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of encode's ids and of decode's text, made in one pass; long texts part by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(tokenizer)
        for batch in batches:
            counts, of_ids, of_texts = [], [], []
            for value in batch.column(1):
                n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
                for ids in bpe.encode_parts(value.as_py()):
                    if ids:
                        ids_hash.update(ids)
                        text_hash.update((" " * (n > 0) + bpe.decode(ids)).encode("utf-8"))
                        n += len(ids) // 4
                counts.append(n)
                of_ids.append(ids_hash.hexdigest())
                of_texts.append(text_hash.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _rows(docs, key, text).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

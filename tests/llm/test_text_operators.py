"""Operators 11 to 13 against the tokenizer libraries and brute force."""

from __future__ import annotations

import hashlib
import itertools
import math
import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from stackwise.llm import alignment, common, queries, ranking, word_bpe

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
A, B, W = queries.tokenizer_path(), queries.tokenizer_path("piece_bpe_32k.model"), queries.tokenizer_path("word_bpe_49k.json")

ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a \n b", "\n\n x", "x y z", "one\x1ctwo three", "don't I'LL we'Ve 's", "<|endoftext|> and <|startoftext|>x<|endoftext|>",
    "<s> </s> <unk> <0x0A>", "a▁b c", "▁", "İstanbul ΣΟΣ é Å", "日本語 テキスト 中文", "\U0001f600\U0001f468‍\U0001f469 x", "tab\tand\x00nul", "1234 5 67,8.9", "!!! ... ??? ([{",
    "´ ́ x ́", "naïve café, über straße.", "﻿bom", "e" * 700, "ab" * 500 + " " + "x" * 900, " " * 300 + "z", "the " * 400, "ẞ ﬃ ǅ",
]


def garble(rnd: random.Random) -> str:
    kinds = (lambda: chr(rnd.choice([rnd.randint(1, 0x7F), rnd.randint(0x80, 0x3FF), rnd.randint(0x2000, 0x9FFF), rnd.randint(0xE000, 0x10FFFF)])), lambda: rnd.choice("aaabn ha'sll"), lambda: rnd.choice(["e", "́", " ", "\n", "I'LL", "??", "12", "▁", "<|endoftext|>", "\x1d"]), lambda: rnd.choice("ethanion "))
    kind = rnd.choice(kinds)
    return "".join(kind() for _ in range(rnd.randint(0, 60)))


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(7)
    return ODD + [garble(rnd) for _ in range(400)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = list(enumerate(texts)) + [(5, "a"), (5, "a"), (None, "the the"), (-3, "the cat")]
    return spark.createDataFrame(rows, DOCS).withColumns({"part": F.lit("x"), "n_a": F.lit(1), "ids": F.lit("y"), "extra": F.create_map(F.lit("k"), F.lit(1))}).repartition(3)


# ---------------------------------------------------------------- 11: alignment


@pytest.fixture(scope="module")
def pair_of_tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    return a, sentencepiece.SentencePieceProcessor(model_file=B), byte


def tokens(pair, text):
    """[(id, first byte, end byte)] of A and of B; None if the text has no tokens."""
    a, b, byte = pair
    if not text:
        return None
    ids = a.encode(" " + text, add_special_tokens=False).ids
    of_a = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in ids]
    of_b = [(i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) and b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
    whole = (" " + text).encode()
    if b"".join(x for _, x in of_a) != whole or b"".join(x for _, x in of_b) != whole:
        return None
    out = []
    for found in (of_a, of_b):
        ends = list(itertools.accumulate(len(x) for _, x in found))
        out.append([(i, e - len(x), e) for (i, x), e in zip(found, ends, strict=True)])
    return out


def brute_alignment(pair, rows):
    links, out = Counter(), []
    cut = [(doc, tokens(pair, t)) for doc, t in rows]
    overlaps = [[(x[0], y[0]) for x in found[0] for y in found[1] if x[1] < y[2] and y[1] < x[2]] if found else [] for _, found in cut]
    for linked in overlaps:
        links.update(linked)
    best = Counter()
    for (_, b), n in links.items():
        best[b] = max(best[b], n)
    for (doc, found), linked in zip(cut, overlaps, strict=True):
        if not found:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        groups = []
        at = [0, 0]
        for end in sorted({x[2] for x in found[0]} & {y[2] for y in found[1]}):
            sides = []
            for side in (0, 1):
                ids = []
                while at[side] < len(found[side]) and found[side][at[side]][2] <= end:
                    ids.append(str(found[side][at[side]][0]))
                    at[side] += 1
                sides.append(",".join(ids))
            groups.append("|".join(sides))
        out.append((doc, len(found[0]), len(found[1]), len(groups), len(linked), sum(links[p] == best[p[1]] for p in linked), sum(links[p] for p in linked), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def by_row(rows):
    return sorted(map(tuple, rows), key=repr)


def test_alignment_equals_brute_force(docs, pair_of_tokenizers):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert by_row(alignment.align(docs, A, B).collect()) == by_row(brute_alignment(pair_of_tokenizers, rows))


def test_alignment_of_small_chunks_and_parts(docs, pair_of_tokenizers, monkeypatch):
    """Chunks, remembered units and parts of texts end everywhere; counts are still the corpus's."""
    for name, value in (("CHUNK_UNITS", 20), ("DISTINCT", 30), ("SLICE", 16)):
        monkeypatch.setattr(alignment, name, value)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    known = alignment._Units(alignment.Aligner(A, B))
    monkeypatch.setitem(alignment._units, (A, B), known)
    made, part, chunk = [], 0, alignment._Chunk()
    for doc, t in rows:
        numbers = [known.number([u])[0] for u in (known.aligner.parts(t) if t else ())]
        chunk.add(doc, np.concatenate([np.zeros(0, np.int32), *numbers]), known)
        if chunk.full() or known.full():
            made.append(chunk.row(part, known))
            part, chunk = part + 1, alignment._Chunk()
            known.clear()
    made.append(chunk.row(part, known))
    assert len(made) > 10
    chunks = docs.sparkSession.createDataFrame([r for b in made for r in b.to_pylist()], alignment.CHUNK)
    links = Counter()
    for found in (tokens(pair_of_tokenizers, t) for _, t in rows):
        if found:
            links.update((x[0] << 32) | y[0] for x in found[0] for y in found[1] if x[1] < y[2] and y[1] < x[2])
    assert {r["pair"]: r["count"] for r in alignment.pair_counts(chunks).collect()} == links
    expected = {d: n for d, *n in brute_alignment(pair_of_tokenizers, rows)}
    for r in (r for b in made for r in b.to_pylist()):
        for i, doc in enumerate(r["doc_id"]):
            if [x for x, _ in rows].count(doc) == 1:
                assert [r[c][i] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")] == [expected[doc][j] for j in (0, 1, 2, 3, 6)]


def test_alignment_groups_are_what_is_hashed(docs):
    hashed = {r["doc_id"]: r["groups_sha256"] for r in alignment.align(docs, A, B).collect()}
    for r in alignment.groups(docs, A, B).collect():
        assert (hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "") == hashed[r["doc_id"]]


def test_alignment_of_no_rows(spark):
    none = spark.createDataFrame([], DOCS)
    assert alignment.align(none, A, B).count() == 0
    assert alignment.align(spark.createDataFrame([(1, None), (2, "")], DOCS), A, B).collect()[0][1:] == (0, 0, 0, 0, 0, 0, "")


def test_alignment_memory_is_bounded_by_chunks(spark, monkeypatch, tmp_path):
    """Chunks of one partition reach Python in several batches, and a table of few large rows has several row groups."""
    n, first = 1 << 20, alignment.CHUNK.split(", ")

    def made(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                row = [k, [k], [n], [n], [n], [n], ["x"], [n], bytes(4 * n), (1).to_bytes(4, "little"), bytes(4), [7], [n]]
                yield pa.RecordBatch.from_pylist([dict(zip((c.split()[0] for c in first), row, strict=True))], schema=batch_schema)

    def checked(batches, rows=alignment._with_counts):
        for batch in batches:
            assert batch.nbytes < 20 << 20, "a partition's chunks are one batch"
            yield from rows(iter([batch]))

    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    batch_schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in first])
    monkeypatch.setattr(alignment, "cut_chunks", lambda *_: spark.range(0, 8, 1, 1).mapInArrow(made, alignment.CHUNK))
    monkeypatch.setattr(alignment, "_with_counts", checked)
    rows = alignment.align(None, A, B).collect()
    assert sorted(map(tuple, rows)) == [(k, n, n, n, n, n, 8 * n * n, "x") for k in range(8)]
    large = common.materialise(spark.range(0, 12, 1, 1).selectExpr("id", "repeat(sha2(string(id), 256), 2000) as x"), "large", group=1 << 16)
    files = [f.removeprefix("file://") for f in large.inputFiles()]
    assert sum(pq.ParquetFile(f).num_row_groups for f in files) == 12 and large.count() == 12
    assert 4 * alignment.CHUNK_UNITS <= common.BATCH_BYTES // 4


def test_alignment_forgets_units_when_a_task_ends(spark, docs):
    alignment.cut_chunks(docs, A, B).count()
    left = spark.range(0, 64, 1, 8).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([sum(len(u.texts) for u in alignment._units.values())])], names=["n"]) for _ in batches), "n long")
    assert left.agg(F.sum("n")).first()[0] == 0


@tables
def test_alignment_of_the_test_table(spark, pair_of_tokenizers):
    docs = queries.table(spark, DIR, "documents").where(F.length("text") < 4000)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert by_row(alignment.align(docs, A, B).collect()) == by_row(brute_alignment(pair_of_tokenizers, rows))


# ---------------------------------------------------------------- 12: encoding and decoding


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(W)


def library_row(library, doc, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_word_bpe_equals_the_library(docs, library):
    expected = [library_row(library, r["doc_id"], r["text"]) for r in docs.collect()]
    assert by_row(word_bpe.digest(docs, W).collect()) == by_row(expected)


def test_word_bpe_ids_and_texts(docs, library):
    encoded = word_bpe.encode(docs, W)
    got = by_row((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in encoded.collect())
    ids = [(r["doc_id"], library.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect()]
    assert got == by_row(ids)
    assert by_row(word_bpe.decode(encoded, W).collect()) == by_row((d, library.decode(x, skip_special_tokens=False)) for d, x in ids)


def test_word_bpe_of_every_character(library):
    codec = word_bpe.codec(W)
    for block in range(0, 0x110000, 64):
        t = " ".join(f"a{chr(c)}1{chr(c)}{chr(c)}+{chr(c)} {chr(c)}b" for c in range(block, block + 64) if not 0xD800 <= c < 0xE000)
        assert np.frombuffer(codec.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, hex(block)


def test_word_bpe_of_long_texts(library, monkeypatch):
    codec = word_bpe.codec(W)
    long = ["a" * 30_000, "ha" * 20_000, "!?" * 20_000, " ".join("w%d" % (i % 977) for i in range(30_000)), "x" * 1000 + " <|endoftext|>" * 50]
    for t in long:
        assert np.frombuffer(codec.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
    monkeypatch.setattr(word_bpe, "PART", 100)
    monkeypatch.setattr(word_bpe, "REMEMBERED", 10)
    monkeypatch.setattr(word_bpe, "PAIRS", 10)
    for t in long:
        assert np.frombuffer(word_bpe.WordBpe(W).encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_word_bpe_refuses_other_files():
    with pytest.raises(ValueError, match="form"):
        word_bpe.WordBpe(A)


def test_word_bpe_of_no_rows(spark):
    none = spark.createDataFrame([], DOCS)
    assert word_bpe.digest(none, W).count() == word_bpe.encode(none, W).count() == 0


# ---------------------------------------------------------------- 13: ranked search


def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", lower)


def brute_search(rows, items, k):
    counted = [(doc, Counter(terms(t))) for doc, t in rows]
    n, total = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in counted:
            score = 0
            for t in set(terms(text)):
                if c[t]:
                    m = 100 - 50 + (50 * sum(c.values()) * n) // total
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, r + 1, None if null else doc, -s) for r, (s, null, doc) in enumerate(sorted(scores)[:k])]
    return out


@pytest.fixture(scope="module")
def library_rows():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["été", "日本", "Ab", "aB", "x1", "1"]
    rows = [(i * 7 % 997 - 100, " ".join(rnd.choices(words, [1 / (j + 1) for j in range(len(words))], k=rnd.randint(0, 40)))) for i in range(900)]
    return rows + [(None, "w1 w2"), (None, "rare-term"), (3, None), (4, ""), (5, "-- !"), (11, "w7 W7 w7"), (11, "w7 W7 w7"), (12, "w9 " * 5000), (13, "same"), (14, "same"), (15, "SAME")]


ITEMS = [(1, "w1 w2 w3"), (2, None), (3, ""), (4, "nowhere"), (5, "w7, w7; W7!"), (6, "same"), (6, "same"), (None, "rare w0"), (7, "été 日本 ab x1"), (8, " ".join(f"w{i}" for i in range(60)))]


@pytest.mark.parametrize(("k", "window", "postings"), [(50, 4096, 1 << 21), (5, 16, 500), (1, 1, 40), (2000, 64, 300)])
def test_ranking_equals_brute_force(spark, library_rows, monkeypatch, k, window, postings):
    monkeypatch.setattr(ranking, "SHARD_POSTINGS", postings)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("score", F.lit("x"))
    docs = spark.createDataFrame(library_rows, DOCS).withColumns({"shard": F.lit(1), "names": F.create_map(F.lit("k"), F.lit(1))}).repartition(3)
    assert by_row(ranking.rank_documents(docs, items, k).collect()) == by_row(brute_search(library_rows, ITEMS, k))
    shards = [ranking._Postings(r.asDict()) for r in ranking.build_index(docs).collect()]
    assert postings > 500 or len(shards) > 10
    monkeypatch.setattr(ranking, "WINDOW", window)  # of the driver's process
    rows = [(d, t) for s in shards for d, t in zip(s.ids, s.sizes, strict=True)]
    n, total = sum(t > 0 for _, t in rows), int(sum(t for _, t in rows))
    dfs = Counter(t for _, x in library_rows for t in set(terms(x)))
    for item, text in ITEMS:
        best = ranking._Best(k)
        for s in shards:
            units, cursors = 20 * ranking.length_factors(s.sizes, n, total), []
            for t in set(terms(text)):
                if found := s.get(t.encode()):
                    adds = ranking.weight(dfs[t], n) * ((10**9 * found[1]) // (1000 * found[1] + units[found[0]]))
                    cursors.append((found[0], adds, int(adds.max())))
            ranking._merge(cursors, s.ids, best)
        got = sorted(((-s, d == -math.inf, 0 if d == -math.inf else -d) for s, d in best.heap if s > 0))
        assert [(s, null, d) for s, null, d in got] == [(-s, d is None, d or 0) for _, _, d, s in brute_search(library_rows, [(item, text)], k)]


def test_ranking_in_blocks_of_queries(spark, library_rows, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK_QUERIES", 2)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = spark.createDataFrame(library_rows, DOCS).repartition(2)
    assert by_row(ranking.rank_documents(docs, items, 7).collect()) == by_row(brute_search(library_rows, ITEMS, 7))


def test_ranking_of_no_rows(spark):
    none, items = spark.createDataFrame([], DOCS), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranking.rank_documents(none, items).count() == 0
    assert ranking.rank_documents(spark.createDataFrame([(1, "w1"), (2, "w1")], DOCS), items.limit(0)).count() == 0
    assert ranking.rank_documents(spark.createDataFrame([(1, None), (2, "-")], DOCS), items).count() == 0


def test_terms_of_parts(monkeypatch):
    text = "Ab,c d1_É x" * 50 + "y" * 300
    whole = Counter(t.encode() for t in terms(text))
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(ranking, "PART_BYTES", size)
        assert ranking.count_terms(text) == whole


def test_integers_round_trip():
    rnd = random.Random(1)
    for n in (0, 1, 5, 3000):
        values = np.array([rnd.choice([0, 1, 127, 128, 16383, 16384, 1 << 31, 1 << 40, (1 << 62) + 3, rnd.randint(0, 300)]) for _ in range(n)], dtype=np.int64)
        data, sizes = ranking.pack_integers(values)
        assert ranking.unpack_integers(data).tolist() == values.tolist() and int(sizes.sum()) == len(data)


def test_lengths_beyond_64_bits():
    sizes = np.array([1, 10**9, 5 * 10**9], dtype=np.int64)
    assert ranking.length_factors(sizes, 10**11, 10**13).tolist() == [50 + 50 * n * 10**11 // 10**13 for n in sizes.tolist()]

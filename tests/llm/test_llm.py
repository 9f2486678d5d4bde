"""Operators of the llm subpackage against brute force, exact round trips or held-out accuracy, on small tables with odd rows."""

from __future__ import annotations

import collections
import glob
import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stackwise.llm import common, fingerprint, lm, mixing, neardup, packing, pii, quality, queries, sharding, topk, url_filter

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def prose(seed: int, n: int, words: int = 400) -> str:
    rnd = random.Random(seed)
    return " ".join("w%d" % rnd.randint(0, words) for _ in range(n))


def edited_copy(text: str, every: int, seed: int) -> str:
    w = text.split()
    for i in range(seed % every, len(w), every):
        w[i] = f"e{seed}x{i}"
    return " ".join(w)


@pytest.fixture(scope="module")
def odd_rows():
    """Nulls, empty, one word, very long, equal texts, repeated rows, near copies."""
    base = prose(1, 200)
    rows = [(1, base, "en", "a", 5), (2, base, "en", "a", 5), (3, edited_copy(base, 60, 7), "en", None, 5), (4, None, None, "b", None), (5, "", "en", "b", 0), (6, "word", "en", "b", 4), (7, "x" * 300_000, "en", "b", 1), (8, prose(2, 60_000), "de", "a", 1)]
    rows += [(9, prose(9, 30), "en", "a", 3)] * 3 + [(None, prose(10, 30), "en", "a", 3), (9, prose(11, 30), "en", "a", 3), (12, "a\tb c\x1f d  e\n", "en", "c", 1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS).withColumn("node", F.lit("clash")).withColumn("rank", F.lit(0)).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# ---------------------------------------------------------------- hashing


def test_word_hashes_follow_words():
    texts = ["A b  a\nB", "", None, "ünï ab", "a" * 5]
    hashes, at = common.word_hashes(texts)
    words = [re.findall(r"[^\x20\x09-\x0d]+", (t or "").lower()) for t in texts]
    assert np.diff(at).tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    assert len({(h, w) for h, w in zip(hashes.tolist(), flat, strict=True)}) == len(set(flat)) == len(set(hashes.tolist()))


def test_long_texts_are_cut_at_white_space(monkeypatch):
    text = prose(3, 3000)
    whole = common.word_hashes([text, "x y"])
    monkeypatch.setattr(common, "CHUNK_BYTES", 100)
    parts = common.word_hashes([text, "x y"])
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_shingles():
    hashes, at = common.shingle_hashes(["a b c d e f", "a b", "", "b c d e f", "A B"], 5)
    assert np.diff(at).tolist() == [2, 1, 0, 1, 1] and hashes[1] == hashes[3] and hashes[2] == hashes[4]


# ---------------------------------------------------------------- 1 top-k


def brute_topk(rows, k=topk.K):
    taken = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(taken):
        if i % 20 == 0:
            scores = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), j) for b, (j, v) in enumerate(taken) if b != a and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def test_topk(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(6)]) for i in range(150)] + [(20, [1.0] * 6), (20, [1.0] * 6), (40, None), (60, [1.0, None] * 3), (80, [math.nan] * 6), (100, [math.inf] * 6), (None, [1.0] * 6), (120, [1.0, 2.0]), (121, [0.5, 0.5]), (140, []), (200, [1e9] * 6), (201, [-1e9] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("clash")).repartition(4)
    want = brute_topk(rows)
    assert sorted(map(tuple, topk.search(df).collect())) == want
    monkeypatch.setattr(topk, "ROUND_BYTES", 600)  # several rounds of queries
    monkeypatch.setattr(topk, "BLOCK", 16)
    assert sorted(map(tuple, topk.search(df).collect())) == want
    assert topk.search(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 2 packing


def check_packing(rows, texts):
    """Every id in one piece; sequences of at most 1024, gapless; returns the share of padding."""
    tokenizer = packing.Encoder(queries.tokenizer_path()).tokenizer
    ids = collections.Counter(tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]) for t in texts)
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["start"], tuple(np.frombuffer(r["ids"], "<u4").tolist()), r["doc_tokens"]))
    got = collections.Counter()
    for ps in pieces.values():
        by_start = sorted(ps)
        while by_start:  # repeated ids: any chain of pieces that fits
            chain, at = (), 0
            total = by_start[0][2]
            while at < total:
                nxt = next(p for p in by_start if p[0] == at and p[2] == total)
                by_start.remove(nxt)
                chain, at = chain + nxt[1], at + len(nxt[1])
            got[chain] += 1
    assert sum(map(len, got)) == sum(map(len, ids)) and sum(got.values()) == sum(ids.values())
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    return 1 - sum(r["length"] for r in rows) / 1024 / len(sequences)


def test_packing_of_odd_rows(docs, odd_rows, none):
    distinct = [r for r in odd_rows if r[0] not in (None, 9)]
    rows = packing.pack(docs.where("doc_id <> 9"), queries.tokenizer_path()).collect()
    check_packing(rows, [r[1] for r in distinct])
    assert packing.digest(packing.pack(docs, queries.tokenizer_path())).where("ids_crc32 is null").count() == 0
    assert packing.pack(none, queries.tokenizer_path()).count() == 0


@tables
def test_packing_wastes_little(spark):
    rows = packing.pack(queries.table(spark, DIR, "documents"), queries.tokenizer_path()).collect()
    texts = [r["text"] for r in queries.table(spark, DIR, "documents").collect()]
    assert check_packing(rows, texts) < 0.02


def test_ids_are_those_of_the_unmodified_tokenizers_encoder():
    from tokenizers import Tokenizer

    enc, plain = packing.Encoder(queries.tokenizer_path()), Tokenizer.from_file(queries.tokenizer_path())
    for text in ("a<|endoftext|>b", "<|endoftext|>", "<|endoftext", "x" + " " * 1_000_000 + "y", "\n" * 1_000_000, "a  b\u00a0\u3000 c\t\n", ""):
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(enc.encode("a<|endoftext|>b"), "<u4").tolist() == [64, 50256, 65]


def test_histogram_packing():
    rnd = random.Random(5)
    for _ in range(20):
        counts = {rnd.randint(1, 100): rnd.randint(1, 50) for _ in range(rnd.randint(1, 40))}
        patterns = packing.pack_histogram(counts, 100)
        assert all(sum(p) <= 100 and n > 0 for p, n in patterns)
        assert collections.Counter({x: n for x, n in counts.items()}) == sum((collections.Counter({x: p.count(x) * n for x in p}) for p, n in patterns), collections.Counter())


# ---------------------------------------------------------------- 3 personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_on_random_texts():
    rnd = random.Random(6)
    for alphabet, n in (("a_@.1 2+-9(0)4é", 60), ("4 -159", 30), ("1.25 ", 40)):
        for _ in range(2000):
            text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, n)))
            assert [s[:3] for s in pii.find_spans(text) if s[0] in pii.BASE] == base_spans(text)


def test_checks_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112") and pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB83WEST12345698765432")
    assert [s[0] for s in pii.find_spans("IBAN GB82 WEST 1234 5698 7654 32 ok")] == ["iban"]
    assert pii.find_spans("number 123-45-6789") == [] and [s[0] for s in pii.find_spans("social security 123-45-6789")] == ["national_id"]
    assert pii.masked("write to a@b.co, +1 (555) 555-0199") == "write to [EMAIL], [PHONE]"
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "@" * 100_000, "+1" + " " * 100_000):
        pii.find_spans(text)  # linear, so this ends


def test_pii_query(spark, docs, none):
    extra = spark.createDataFrame([(50, "😀 a@b.co 10.0.0.1", "en", "a", 1)], DOCS).withColumn("node", F.lit("x")).withColumn("rank", F.lit(0))
    rows = {r["doc_id"]: r for r in pii.digest(pii.find_pii(docs.unionByName(extra))).collect()}
    r = rows[50]
    assert (r["n_email"], r["n_ip"], r["spans"]) == (1, 1, "email:2:8,ip:9:17") and r["base_sha256"] == hashlib.sha256(r["spans"].encode()).hexdigest()
    assert rows[4]["spans"] == rows[5]["spans"] == "" and pii.digest(pii.find_pii(none)).count() == 0
    red = pii.redact(docs.unionByName(extra)).where("doc_id = 50 or doc_id = 4").orderBy("doc_id").collect()
    assert red[0]["text"] is None and red[1]["text"] == "😀 [EMAIL] [IP]" and red[1]["n_chars"] == 14


# ---------------------------------------------------------------- 4 quality


def quality_tables(spark):
    rnd = random.Random(7)
    rows, labels = [], []
    for i in range(600):
        good = i % 3 > 0
        words = [w if good else w + rnd.choice(["***", "$$$", "!!"]) for w in prose(i, rnd.randint(20, 60), 50).split()]
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, int(good)))
    return spark.createDataFrame(rows, DOCS).repartition(2), spark.createDataFrame(labels, "doc_id long, quality int")


def test_quality_on_held_out_documents(spark):
    docs, labels = quality_tables(spark)
    rows = quality.score_quality(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.95 and all(0 <= r["score"] <= 1 for r in rows)
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, flipped).collect()}
    assert all(again[r["doc_id"]] == pytest.approx(r["score"], abs=1e-9) for r in rows)  # held-out labels don't matter
    kept = {r["doc_id"] for r in quality.keep_good(docs, labels).collect()}
    assert kept == {r["doc_id"] for r in rows if r["predicted"]}


def test_quality_of_odd_rows(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    assert quality.score_quality(docs, labels).count() == docs.count()
    assert quality.score_quality(docs, labels.limit(0)).where("score = 1").count() == docs.count()
    assert quality.score_quality(none, labels).count() == 0 and quality.keep_good(none, labels).count() == 0


# ---------------------------------------------------------------- 5 language model


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["<end>"]


@pytest.fixture(scope="module")
def two_languages(spark):
    rnd = random.Random(8)
    kinds = [[f"{c}{i}" for i in range(40)] for c in "ab"]
    rows = [(i, " ".join(rnd.choice(kinds[i % 2]) if rnd.random() < 0.9 else f"r{rnd.random():.6f}" for _ in range(80)), "en", "s", 1) for i in range(300)]
    return rows, spark.createDataFrame(rows, DOCS).repartition(2).cache()


def test_lm_base_and_model(two_languages):
    rows, df = two_languages
    got = {r["doc_id"]: r for r in lm.score_texts(df).collect()}
    training = collections.Counter(t for i, x, *_ in rows if zlib.crc32(str(i).encode()) % 5 != 1 for t in tokens(x))
    n, v = sum(training.values()), len(training)
    for i, x, *_ in rows:
        ts, r = tokens(x), got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ts), sum(training[t] > 0 for t in ts), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((training[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts))
    held = [r for r in got.values() if r["held_out"]]
    assert len(held) == sum(zlib.crc32(str(r[0]).encode()) % 5 == 1 for r in rows)
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # the language of a text is predictable


@pytest.fixture(scope="module")
def vocabulary(spark):
    """Counts of 1,500 tokens of four endings: some heads, classes of words, and rests."""
    rng = np.random.default_rng(3)
    tokens = np.unique(rng.integers(0, 1 << 62, 1500).astype(np.int64)) & ~127 | rng.integers(0, 4, 1500)
    return lm.Vocabulary(spark.createDataFrame([(int(t), int(3000 // (i + 1)) + 18) for i, t in enumerate(tokens)], "token long, n long"))


def test_lm_is_normalised(vocabulary):
    v, rng = vocabulary, np.random.default_rng(1)
    assert len(v.words) > 1000 and len(v.first) > 5 and (np.diff(v.first) <= lm.MEMBERS).all()
    context = [3, 1, v.symbols - 1]
    for scale in (0.5, 30):  # with and without scores that overflow
        p = [rng.normal(0, scale, s).astype(np.float32) for s in lm.shapes(v)]
        logs = [lm.log_probabilities(p, v, np.array([*context, s]), np.array([0, 4]))[3] for s in range(v.symbols)]
        assert np.exp(logs).sum() == pytest.approx(1, abs=1e-3)
    # brute force, one place at a time
    p = [rng.normal(0, 0.5, s).astype(np.float32) for s in lm.shapes(v)]
    symbols, at = rng.integers(0, v.symbols, 50), np.array([0, 7, 7, 50])
    got = lm.log_probabilities(p, v, symbols, at)
    for i, s in enumerate(symbols):
        begin = at[np.searchsorted(at, i, side="right") - 1]
        r = sum(p[1][j - 1] * p[0][symbols[i - j] if i - j >= begin else v.symbols] for j in range(1, lm.CONTEXT + 1))
        up = p[2] @ r + p[3]
        want = up[v.upper[s]] - np.log(np.exp(up).sum())
        if s >= lm.HEAD + lm.ENDINGS:
            c = v.upper[s] - lm.HEAD - lm.ENDINGS
            own = (p[4] @ r + p[5])[v.first[c] : v.first[c + 1]]
            want += own[s - lm.HEAD - lm.ENDINGS - v.first[c]] - np.log(np.exp(own).sum())
        assert got[i] == pytest.approx(want, abs=1e-3)


def test_scoring_normalises_a_level_at_once(spark, monkeypatch):
    """The upper level's weights are made once for all places, and no block is searched for large products that vectors' lengths exclude."""
    calls, real = [], lm.normalised
    monkeypatch.setattr(lm, "normalised", lambda r, *a: calls.append(len(r)) or real(r, *a))
    v = lm.Vocabulary(spark.createDataFrame([(i << 6, 100 - i) for i in range(60)], "token long, n long"))
    symbols = np.arange(9000, dtype=np.int64) % 60
    got = lm.log_probabilities(lm.start(v), v, symbols, np.array([0, 4000, 9000]))
    assert calls == [9000]
    rng = np.random.default_rng(5)
    for scale in (0.3, 30):
        r, q, bias = (rng.normal(0, scale, n).astype(np.float32) for n in ((700, 24), (90, 24), 90))
        scores = r.astype(np.float64) @ q.T.astype(np.float64) + bias
        want = scores[np.arange(700), np.arange(700) % 90] - np.logaddexp.reduce(scores, axis=1)
        assert np.allclose(real(r, q, bias, np.arange(700) % 90), want, rtol=1e-4, atol=1e-3)
    assert len(got) == 9000 and (got < 0).all()


def test_lm_tables(vocabulary):
    v, rng = vocabulary, np.random.default_rng(2)
    draws, share = v.draws()
    assert all(sorted(set(draws[c])) == list(range(a, b)) for c, (a, b) in enumerate(zip(v.first[:-1], v.first[1:], strict=True)))
    assert share == pytest.approx(np.bincount(draws.ravel(), minlength=len(v.words)) / lm.DRAWS)
    keys = np.unique(rng.integers(0, 1 << 63, 3000).astype(np.uint64) | (np.uint64(7) << np.uint64(58)))  # many in the same slots
    found = lm.Table(keys[::2]).find(keys)
    assert (found[::2] == np.arange(len(keys[::2]))).all() and (found[1::2] == -1).all()
    assert (lm.Table(keys[:0]).find(keys) == -1).all()


def test_lm_learns_words(spark):
    """Words beyond the heads are predicted from the words before them, by a margin over the unigram base."""
    rnd = random.Random(5)
    rows = [(i, " ".join(f"{w}{k:03d}{w}" for k in [rnd.randrange(300) for _ in range(40)] for w in ("a", "b")), "en", "s", 1) for i in range(1500)]
    got = lm.score_texts(spark.createDataFrame(rows, DOCS).repartition(2)).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert got["s"] / got["n"] > got["b"] / got["n"] + 0.25


def test_lm_of_odd_rows(docs, none, monkeypatch):
    monkeypatch.setattr(lm, "TABLE", 3)  # nearly all counts are joined
    rows = lm.score_texts(docs).collect()
    assert len(rows) == docs.count() and {r["n_tokens"] for r in rows if r["doc_id"] in (4, 5)} == {1} and all(math.isfinite(r["score"]) for r in rows)
    assert lm.score_texts(none).count() == 0


# ---------------------------------------------------------------- 6 fingerprints


def test_fingerprints(spark, docs, odd_rows, none, monkeypatch):
    monkeypatch.setattr(fingerprint, "TASK_CHARS", 1000)  # many ranges
    order = sorted(odd_rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    texts = [r[1] or "" for r in order]
    want = collections.Counter()
    for i, (r, t) in enumerate(zip(order, texts, strict=True)):
        cut = len(t) // 3
        want[r[0], len(t), hashlib.sha256((t[: len(t) - cut] + texts[(i + 1) % len(texts)][:cut]).encode()).hexdigest()] += 1
    rows = fingerprint.fingerprint_pairs(docs).collect()
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == want
    assert all(0 <= r[c] <= 1 for r in rows for c in ("near_edited", "near_next", "contained_edited", "contained_next"))
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] and by[4]["fingerprint"] == by[5]["fingerprint"] == "" and by[2]["near_next"] == 1
    for i, (r, t) in enumerate(zip(order, texts, strict=True)):  # brute force, of documents whose id is theirs alone
        if r[0] is not None and sum(x[0] == r[0] for x in order) == 1:
            f = texts[(i + 1) % len(texts)]
            full = [{int(h) for h in common.shingle_hashes([x])[0]} for x in (t, fingerprint.edited(t, f), f)]
            kept = [{h for h in s if h < (1 << 64) // fingerprint.SCALE} for s in full]
            assert by[r[0]]["fingerprint"] == "".join(f"{h:016x}" for h in sorted(kept[0])) and by[r[0]]["edited_fingerprint"] == "".join(f"{h:016x}" for h in sorted(kept[1]))
            for name, k in (("near_edited", 1), ("near_next", 2)):
                a, b = (kept if kept[0] and kept[k] else full)[0], (kept if kept[0] and kept[k] else full)[k]
                assert by[r[0]][name] == pytest.approx(len(a & b) / len(a | b) if a or b else 1)
    assert fingerprint.fingerprint_pairs(none).count() == 0
    one = fingerprint.fingerprint_pairs(spark.createDataFrame([(1, "abcdef", "en", "s", 6)], DOCS)).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()


def test_keys_without_a_pattern_fall_into_their_ranges(spark):
    bounds = [1 << 40, 977, 976, 5, -3]
    keys = [*bounds, 1 << 41, 978, 6, 4, -2, -4, -(1 << 50)]
    rows = spark.createDataFrame([(k,) for k in keys], "id long").select("id", fingerprint._above(F.col("id"), bounds).alias("n")).collect()
    assert {r["id"]: r["n"] for r in rows} == {k: sum(b > k for b in bounds) for k in keys}


def test_sketches_estimate_and_merge():
    a, b = prose(1, 3000), prose(2, 300)
    sa, sb, both = fingerprint.sketches([a, b, a + " " + b])
    assert (fingerprint.read(fingerprint.written(sa)) == sa).all()
    assert fingerprint.containment(sb, both) > 0.95 and fingerprint.containment(both, sa) == pytest.approx(3000 / 3300, abs=0.05)
    assert np.isin(fingerprint.merged(sa, sb), both).mean() > 0.99
    half = edited_copy(a, 11, 3)
    words = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    true = len(words(a) & words(half)) / len(words(a) | words(half))
    assert fingerprint.likeness(sa, fingerprint.sketches([half])[0]) == pytest.approx(true, abs=0.08)


# ---------------------------------------------------------------- 7 sharding


def test_shards_of_rows_with_maps(spark, tmp_path):
    rows = spark.range(50).select(F.col("id").alias("doc_id"), F.create_map(F.lit("k"), "id").alias("m"), F.array(F.create_map("id", F.lit(1))).alias("deep"))
    sharding.write_shards(rows, "doc_id", str(tmp_path / "out"), shards=4)
    assert spark.read.parquet(str(tmp_path / "out")).select("doc_id").distinct().count() == 50
    sharding.write_shards(rows.select(F.col("m").alias("doc")).withColumn("k", F.lit("x")).drop("k").withColumn("id", F.lit(1)), "id", str(tmp_path / "two"), shards=2)


def test_lookup_table():
    names = [f"n{i}" for i in range(7)]
    table = sharding.lookup_table(names, 1009)
    shares = collections.Counter(table)
    assert set(shares) == set(range(7)) and max(shares.values()) - min(shares.values()) <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    assert sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6) < 0.1 * 1009  # losing a shard moves few other slots
    for bad in ((names, 1000), (["a", "a"], 11), ([], 11)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_sharding_of_odd_rows(docs, none, tmp_path):
    rows = sharding.assign_shards(docs.withColumn("slot", F.lit("clash")), "doc_id").collect()
    table = sharding.lookup_table([f"shard-{i:05d}" for i in range(sharding.SHARDS)])
    for r in rows:
        slot = int(hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()[:8], 16) % sharding.SLOTS
        assert (r["slot"], r["shard"]) == (slot, table[slot])
    assert len(rows) == docs.count() and sharding.assign_shards(none, "doc_id").count() == 0
    spread = sharding.assign_shards(docs.withColumn("k", F.lit("hot")), "k", spread=F.col("doc_id"))
    assert spread.select("shard").distinct().count() > 3
    sharding.write_shards(docs.select("doc_id", "text"), "doc_id", str(tmp_path / "s"), 4, 101)
    assert docs.sparkSession.read.parquet(str(tmp_path / "s")).count() == docs.count()


# ---------------------------------------------------------------- 8 URLs


def test_rules(spark):
    urls = [("http://a.net/x", "block"), ("http://EXAMPLE.net/en/x?q", "allow"), ("http://m.example.net/de/", "block"), ("https://example.com/de/1", "block"), ("https://badexample.com/de/1", None), ("http://x.org/fr/", "allow"), ("http://x.org/fr", None), ("http://a.net", None), (None, None), ("nothing", None), ("://h/p#f", None), ("http://net/", "block"), ("", None)]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "page_id long, url string").withColumn("host", F.lit("clash"))
    outcomes = spark.createDataFrame([], "host string, good int, n long")
    rows = {r["page_id"]: r for r in url_filter.judge_pages(pages, outcomes).collect()}
    assert all(rows[i]["verdict"] == (v or "allow") and (rows[i]["rule"] is None) == (v is None) for i, (_, v) in enumerate(urls))
    assert (rows[1]["host"], rows[1]["path"]) == ("example.net", "/en/x") and rows[8]["host"] == rows[9]["path"] == "" and rows[10]["host"] == "h" and rows[10]["path"] == "/p"


def test_reputation_shrinks(spark):
    outcomes = spark.createDataFrame([("bad.x.com", 0, 60), ("bad.x.com", 1, 1), ("few.z.com", 0, 1), *((f"g{i}.y.com", 1, 40) for i in range(20)), *((f"g{i}.y.com", 0, 4) for i in range(20)), ("", 0, 1)], "host string, good int, n long")
    got = {r["host"]: r for r in url_filter.reputation(outcomes).collect()}
    assert got["bad.x.com"]["mean"] < 0.2 < got["few.z.com"]["mean"] < 0.91 and got["few.z.com"]["deviation"] > got["bad.x.com"]["deviation"]
    pages = spark.createDataFrame([(1, "http://bad.x.com/"), (2, "http://few.z.com/"), (3, "http://g1.y.com/"), (4, "http://new.com/")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge_pages(pages, outcomes).collect()} == {1: "block", 2: "allow", 3: "allow", 4: "allow"}


def test_hosts_without_labels_are_judged_by_domain_suffix_or_all(spark):
    rows = [(f"h{i}.bad.com", 0, 30) for i in range(10)] + [(f"h{i}.good.com", 1, 30) for i in range(90)] + [(f"h{i}.d{i}.zip", 0, 30) for i in range(40)]
    outcomes = spark.createDataFrame(rows, "host string, good int, n long")
    urls = ["http://new.bad.com/", "http://new.good.com/", "http://a.new.zip/", "http://a.new.com/", "http://a.new.info/", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judge_pages(pages, outcomes).collect()}
    assert [got[i]["verdict"] for i in range(6)] == ["block", "allow", "block", "allow", "allow", "allow"]
    assert all(r["labelled"] == 0 and 0 < r["reputation"] < 1 for r in got.values()) and got[4]["deviation"] > got[1]["deviation"]
    worse = spark.createDataFrame([(f"h{i}.d{i}.zip", i % 100 == 0, 30) for i in range(300)], "host string, good boolean, n long").selectExpr("host", "cast(good as int) as good", "n")
    assert {r["verdict"] for r in url_filter.judge_pages(pages, worse).where("page_id > 3").collect()} == {"block"}


def test_url_sql_on_hosts_without_labels(spark, tmp_path):
    """The registered query and its SQL on hosts with ports, users, and labelled pages only at their domain, suffix or nowhere."""
    rnd = random.Random(4)
    hosts = [f"h{i}.{d}.{s}" for i in range(12) for d in ("bad", "good", f"d{i}") for s in ("com", "zip")] + ["", "x", "u:p@h1.bad.com:8080", "H2.bad.com:", "new.bad.com", "new.bad.com:81", "new.good.com", "a.new.zip", "a.new.info"]
    urls = [f"http://{h}/p/{(200 if 'good' in h else 0) + rnd.randrange(200 if 'd' in h else 400) if k % 3 else 'none'}" for h in hosts for k in range(9)] + [None, "none", "://"]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string")
    labels = spark.createDataFrame([(i, None if i % 50 == 0 else int(i % 7 > 3 or i >= 200), int(i % 31 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    db = duckdb.connect()
    for t in ("pages", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    names = ["page_id", "host", "path", "rule", "verdict", "labelled"]
    want = db.execute(f"SELECT {', '.join(names)} FROM ({queries.oracle_sql()['op8_url_filter']}) ORDER BY page_id").fetchall()
    got = [tuple(r) for r in queries.op8_url_filter(spark, str(tmp_path)).select(names).orderBy("page_id").collect()]
    assert got == want and {r[4] for r in got} == {"allow", "block"}


# ---------------------------------------------------------------- 9 near duplicates


def brute_classes(rows, least=0.8):
    """Components over all pairs, by plain Jaccard similarity of five-word shingles; equal texts together."""
    sets = []
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if (rows[a][1] or "") == (rows[b][1] or "") or (x and y and len(x & y) >= least * len(x | y)):
                parent[find(a)] = find(b)
    least_id: dict[int, int | None] = {}
    for a, r in enumerate(rows):
        c = find(a)
        least_id[c] = min((x for x in (least_id.get(c), r[0]) if x is not None), default=None)
    return collections.Counter((r[0], least_id[find(a)]) for a, r in enumerate(rows))


def test_near_duplicates_of_odd_rows(docs, odd_rows, none):
    assert collections.Counter(map(tuple, neardup.near_duplicates(docs).collect())) == brute_classes(odd_rows)
    assert neardup.near_duplicates(none).count() == 0 and neardup.deduplicate(none).count() == 0
    kept = neardup.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len({k for _, k in brute_classes(odd_rows)} | {"second 9"})


def test_families_and_chains(spark, monkeypatch):
    base = prose(20, 300)
    rows = [(i, edited_copy(base, 40, i)) for i in range(100, 160)] + [(5, base)]  # like the original, not like each other
    text = prose(21, 300)
    for i in range(30):  # each like the one before
        rows.append((200 + i, text))
        w = text.split()
        w[i * 9 : i * 9 + 3] = ["n%d" % (i * 3 + j) for j in range(3)]
        text = " ".join(w)
    rows += [(300 + i, " ".join([*prose(22, 60).split(), *prose(400 + i, 240).split()])) for i in range(20)]  # a shared passage
    monkeypatch.setattr(neardup, "PIVOTS", 4)
    monkeypatch.setattr(neardup, "MATES", 8)
    monkeypatch.setattr(neardup, "CELLS", 5000)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_classes(rows)
    assert collections.Counter(map(tuple, neardup.near_duplicates(df).collect())) == want
    assert sorted(r[0] for r in neardup.deduplicate(df).select("doc_id").collect()) == sorted({c for _, c in want})


def test_probmin_hash_estimates_probability_jaccard():
    a = prose(30, 200)
    texts = [a, edited_copy(a, 50, 1), a + " " + a, "one two"]
    sig, has = neardup.signatures([*texts, "", None], m=3000)
    h, d, w = neardup.weighted(texts)
    sets = [(h[d == i], w[d == i]) for i in range(4)]
    assert has.tolist() == [True] * 4 + [False] * 2
    for i in range(4):
        for j in range(i):
            x, y = dict(zip(*map(list, sets[i]), strict=True)), dict(zip(*map(list, sets[j]), strict=True))
            true = sum(1 / sum(max(x.get(k, 0) / x[e], y.get(k, 0) / y[e]) for k in x.keys() | y.keys()) for e in x.keys() & y.keys())
            assert neardup.prob_jaccard(sets[i], sets[j]) == pytest.approx(true) and (sig[i] == sig[j]).mean() == pytest.approx(true, abs=0.04)


def test_texts_that_differ_in_repetition_only_are_found(spark):
    rows = []
    for i in range(6):  # 300 shingles, of which 15 occur 200 times in the second text: plain Jaccard 0.987, weighted 0.14
        words = [f"t{i}x{j}" for j in range(304)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words, *words[:19] * 200]))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, got.collect())) == [(i, i - i % 2) for i in range(12)]


# ---------------------------------------------------------------- 10 mixing


def test_period_is_fair():
    for parts in ({"a": 500, "b": 300, "c": 200}, {"a": 1, "b": 998, "c": 1}, {"x": 7}, {f"s{i}": i + 1 for i in range(12)}):
        total, seen = sum(parts.values()), collections.Counter()
        for n, s in enumerate(mixing.period(parts), start=1):
            seen[s] += 1
            assert all(abs(seen[k] - n * w / total) < 1 for k, w in parts.items())
        assert seen == parts


def test_mixing(spark, docs, none):
    rows = [(i, "abc"[min(2, i % 7 // 3)], i) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n int").repartition(3)
    weights = {"a": 5, "b": 3, "c": 2}
    out = sorted(mixing.mix_sources(df, weights, block=8).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in out] == list(range(3000)) and sorted(r["doc_id"] for r in out) == list(range(3000))
    blocks = collections.defaultdict(set)
    for r in out:
        blocks[r["slot"]].add((r["source"], r["block"]))
    assert all(len(b) == 1 for b in blocks.values()) and sorted(blocks) == list(range(len(blocks)))
    order = [next(iter(blocks[s]))[0] for s in sorted(blocks)]
    first = min(len(order) - order[::-1].index(s) for s in "abc")  # until a source is exhausted
    seen = collections.Counter()
    for n, s in enumerate(order[:first], start=1):
        seen[s] += 1
        assert all(abs(seen[k] - n * w / 10) < 1 for k, w in weights.items())
    assert [r["doc_id"] for r in mixing.in_mixed_order(df, weights, block=8).collect()] == [r["doc_id"] for r in out]
    odd = mixing.mix_sources(docs, block=2).collect()
    assert sorted(r["position"] for r in odd) == list(range(docs.count())) and mixing.mix_sources(none).count() == 0
    assert mixing.in_mixed_order(docs).columns == docs.columns and mixing.in_mixed_order(none).count() == 0


def test_empty_weights_are_none(docs):
    assert sorted(map(tuple, mixing.mix_sources(docs, {}).collect()), key=repr) == sorted(map(tuple, mixing.mix_sources(docs).collect()), key=repr)


def test_large_tables_have_larger_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCKS", 20)
    rows = mixing.mix_sources(spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("if(id % 3 = 0, 'a', 'b')").alias("source")), {"a": 1, "b": 1}).collect()
    assert sorted(r["position"] for r in rows) == list(range(3000)) and max(collections.Counter((r["source"], r["block"]) for r in rows).values()) == 150
    first = [r["source"] for r in sorted(rows, key=lambda r: r["position"])][:1800]
    for end in range(1, 1801):
        assert abs(first[:end].count("a") - end / 2) < 150  # while both have documents


def test_a_given_block_holds_at_any_size(spark, monkeypatch):
    """Neither the bound on blocks nor how many slots the driver holds changes a row."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("if(id % 10 = 0, 'a', if(id % 7 = 0, 'b', 'c'))").alias("source"))
    weights = {"a": 0.001, "b": 2, "c": 3.3}
    once = sorted(map(tuple, mixing.mix_sources(df, weights, block=2).collect()))
    for name, value in (("BLOCKS", 20), ("HELD_SLOTS", 150), ("CHUNK", 64)):
        monkeypatch.setattr(mixing, name, value, raising=False)
    assert sorted(map(tuple, mixing.mix_sources(df, weights, block=2).collect())) == once
    assert max(collections.Counter((s, b) for _, s, b, *_ in once).values()) == 2
    monkeypatch.setattr(queries, "table", lambda *_: df)
    rows = queries.op10_mixing(spark, DIR).collect()
    assert max(collections.Counter((r["source"], r["block"]) for r in rows).values()) == mixing.BLOCK


def test_schedule_keeps_exact_shares_for_any_weights():
    blocks = {"big": 30_000, "half": 9_000, "rare": 40, "one": 1} | {f"s{i:04d}": i % 3 + 1 for i in range(1500)}
    weights = {s: n**0.5 for s, n in blocks.items()} | {"big": 1.0 / 3, "half": 0.1234567, "rare": 0.00001}
    plan = mixing.schedule(blocks, weights)
    assert {s: len(x) for s, x in plan.items()} == blocks and sorted(x for slots in plan.values() for x in slots) == list(range(sum(blocks.values())))
    two = mixing.schedule({"a": 60_000, "b": 30_000}, {"a": 2**0.5, "b": 1})
    share = 1 / (1 + 2**0.5)
    end = two["a"][-1] // 2
    assert all(abs(i - share * slot) < 1 and abs(i + 1 - share * (slot + 1)) < 1 for i, slot in enumerate(two["b"]) if slot < end)
    small = {"a": 50, "b": 7, "c": 13, "d": 1}
    w = {"a": 0.7, "b": 0.001, "c": 2.5, "d": 0.3}
    got = mixing.schedule(small, w)
    for slot in range(1, 72):  # against the fluid mix, by bisection
        low, high = 0.0, 1e6
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(w[s] * mid, small[s]) for s in w) < slot else (low, mid)
        assert all(abs(sum(x < slot for x in got[s]) - min(w[s] * low, small[s])) < 1 + 1e-6 for s in w)


def test_mixing_of_many_sources(spark):
    df = spark.createDataFrame([(i, f"s{i % 1201}") for i in range(5000)], "doc_id long, source string").repartition(3)
    out = mixing.mix_sources(df, block=2).collect()
    assert sorted(r["position"] for r in out) == list(range(5000)) and len({r["source"] for r in out}) == 1201


# ---------------------------------------------------------------- queries and pipeline


@tables
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    cursor = c.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    df = queries.QUERIES[name](spark, DIR)
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr) == sorted(cursor.fetchall(), key=repr)


@tables
def test_pipeline(spark):
    docs = queries.table(spark, DIR, "documents")
    source = {r["doc_id"]: r for r in docs.collect()}
    frames, df = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        df = common.materialise(stage(spark, df, DIR), name)
        frames[name] = df
        assert name == "packing" or df.columns == docs.columns
    labels = {r["doc_id"]: r["quality"] for r in queries.table(spark, DIR, "labels").collect()}
    good = {r["doc_id"]: r["text"] for r in frames["quality"].collect()}
    assert all(source[i]["text"] == t for i, t in good.items())
    assert sum(i in good for i, q in labels.items() if q == 1) >= 0.97 * sum(q == 1 for q in labels.values()) and sum(i in good for i, q in labels.items() if q == 0) <= 0.1 * sum(q == 0 for q in labels.values())
    single = {r["doc_id"] for r in frames["near_duplicates"].collect()}
    assert single == {c for _, c in brute_classes(list(good.items()))}
    masked = {r["doc_id"]: r for r in frames["personal_data"].collect()}
    assert set(masked) == single and all(r["text"] == pii.masked(good[i]) and r["n_chars"] == len(r["text"]) and not base_spans(r["text"]) for i, r in masked.items())
    assert {r["doc_id"]: r["text"] for r in frames["mixing"].collect()} == {i: r["text"] for i, r in masked.items()}
    check_packing(frames["packing"].collect(), [r["text"] for r in masked.values()])


def test_sequences_follow_the_mix(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_DOCS", 256)
    rows = [(i, prose(i, 60 if i % 3 else 20), "en", "a" if i % 3 else "b", 1) for i in range(6000)]
    source = {r[0]: r[3] for r in rows}
    mixed = common.materialise(corpus_pipeline.mix(spark, spark.createDataFrame(rows, DOCS).repartition(3), DIR), "mixing")
    out = corpus_pipeline.pack(spark, mixed, DIR).collect()
    check_packing(out, [r[1] for r in rows])
    assert len({r["sequence_id"] for r in out}) == max(r["sequence_id"] for r in out) + 1
    share, seen = 2000**0.5 / (2000**0.5 + 4000**0.5), 0
    for k, r in enumerate(sorted(out, key=lambda r: (r["sequence_id"], r["offset"])), start=1):
        seen += source[r["doc_id"]] == "b"
        assert not 1000 < k < 4500 or abs(seen / k - share) < 0.06

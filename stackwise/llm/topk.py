"""Exact top-k search by inner product over a vector-approximation file.

The file holds, for each vector, the quantised cell of every component beside the exact vector. A first pass reads the cells
only: each block of the file gives, for each query, the k-th largest lower bound of its scores; the largest of those over all
blocks is a score that k vectors reach. A second pass drops what cannot reach it by its upper bound, and reads exact vectors
in the order of their bounds until the k-th result is certain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

K = 20
SCALE = 64
QUERY_MODULUS = 20
#: Cells of a component.
CELLS = 64
#: Vectors of a block of the file.
BLOCK = 4096
#: Queries whose bounds are worked out together.
TOGETHER = 256
#: Bytes of queries that are broadcast at once; more queries go in further rounds over the file.
ROUND_BYTES = 32 << 20
#: Components are scaled integers within these bounds; a vector with a larger one is compared in Python's integers.
EXACT = 1 << 53
_LONG = (-(1 << 63), (1 << 63) - 1)


def scaled(vectors: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """id, ``v``: floor(scale * x) of each component, and a number of the row. Vectors null or with a null or non-finite component are left out.

    The numbers differ from run to run: write the result down before using them.
    """
    x = F.col("v")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    got = vectors.select(vectors[key].cast("long").alias("id"), vectors[vector].cast("array<double>").alias("v")).where(x.isNotNull() & ~F.coalesce(bad, F.lit(False)))
    return got.select("id", F.transform(x, lambda e: F.floor(e * F.lit(float(scale))).cast("double")).alias("v"), F.monotonically_increasing_id().alias("row"))


def ranges(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Least and greatest value of each component, by the vectors' number of components: a row per component."""
    rows = vectors.select(F.size("v").alias("d"), F.posexplode("v").alias("i", "x")).groupBy("d", "i").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("d", "i").collect()
    out: dict[int, tuple[list, list]] = {}
    for r in rows:
        lo, hi = out.setdefault(r["d"], ([], []))
        lo.append(r["lo"])
        hi.append(r["hi"])
    return {d: (np.array(lo), np.array(hi)) for d, (lo, hi) in out.items()}


def _edges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole-number step of the cells of each component: cell c spans lo + c * step to lo + (c + 1) * step - 1."""
    return lo, np.ceil((hi - lo + 1) / CELLS)


FILE = "d int, n int, ids binary, numbers binary, cells binary, exact binary"


def write_file(vectors: DataFrame, bounds: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """The approximation file: a row per block of vectors with as many components; written once to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, list]] = {}

        def block(d: int) -> pa.RecordBatch:
            ids, rows, numbers = held.pop(d)
            exact = np.array(rows, dtype=np.float64).reshape(len(ids), d)
            lo, step = _edges(*bounds[d]) if d else (np.zeros(0), np.ones(0))
            cells = ((exact - lo) // step).astype(np.uint8)
            return pa.RecordBatch.from_pydict({"d": pa.array([d], pa.int32()), "n": pa.array([len(ids)], pa.int32()), "ids": [np.array(ids, dtype="<i8").tobytes()], "numbers": [np.array(numbers, dtype="<i8").tobytes()], "cells": [cells.tobytes()], "exact": [exact.tobytes()]})

        for batch in batches:
            for i, v, number in zip(*(batch.column(c).to_pylist() for c in ("id", "v", "row")), strict=True):
                ids, rows, numbers = held.setdefault(len(v), ([], [], []))
                ids.append(i)
                rows.append(v)
                numbers.append(number)
                if len(ids) == BLOCK:
                    yield block(len(v))
        for d in list(held):
            yield block(d)

    return materialise(vectors.where(F.col("id").isNotNull()).select("id", "v", "row").mapInArrow(run, FILE), "va-file")


def _limits(d: int, bounds: dict, cells: bytes, n: int, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of each query's score with each vector, from the cells alone."""
    lo, step = _edges(*bounds[d]) if d else (np.zeros(0), np.ones(0))
    half = (step - 1) / 2
    middle = np.frombuffer(cells, dtype=np.uint8).reshape(n, d) * step + lo + half
    at, slack = queries @ middle.T, np.abs(queries) @ half
    # the products' rounding error is far under this margin
    slack = slack + 1e-9 * (np.abs(queries) @ np.maximum(np.abs(lo), np.abs(lo + CELLS * step))) + 1e-9
    return at - slack[:, None], at + slack[:, None]


def _scores(queries: np.ndarray, exact: np.ndarray) -> np.ndarray:
    """Exact integer inner products; those beyond a long are the nearest long."""
    if not exact.size or np.abs(queries).sum() * np.abs(exact).max() < EXACT:
        return (exact @ queries).astype(np.int64)
    q = [int(x) for x in queries]
    return np.array([min(max(sum(a * int(b) for a, b in zip(q, row, strict=True)), _LONG[0]), _LONG[1]) for row in exact], dtype=np.int64)


FOUND = "query_id long, query_row long, vec_id long, score long"


def search(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, modulus: int = QUERY_MODULUS, scale: int = SCALE) -> DataFrame:
    """For every vector whose key is divisible by ``modulus``, its k best among all others: query_id, rank (from 1), vec_id, score.

    Components x count as floor(scale * x); the score is the integer inner product, ties go to the smaller vec_id. Fewer
    than k others: all of them. Only vectors with as many components are compared. A repeated key is a row of its own: each
    row queries, and is found by the rows of the same key but itself. Null keys, null vectors and vectors with null or
    non-finite components take no part; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = materialise(scaled(vectors, key, vector, scale), "vectors")
    bounds = ranges(rows)
    file = write_file(rows, bounds)
    asked = rows.where((F.col("id") % modulus == 0) & F.col("id").isNotNull())
    n, width = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    rounds = max(1, -(-(n or 0) * ((width or 0) * 8 + 64) // (ROUND_BYTES // 2)))
    queries = asked.withColumn("round", F.pmod(F.xxhash64("id"), F.lit(rounds)))
    found = [_round(spark, file, bounds, queries.where(F.col("round") == r), k) for r in range(rounds)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    best = Window.partitionBy("query_id", "query_row").orderBy(F.col("score").desc(), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _round(spark, file: DataFrame, bounds: dict, queries: DataFrame, k: int) -> DataFrame:
    """Candidates for a bounded number of queries: k a block at most, and only blocks that may hold one of the k best."""
    by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    taken = sorted((len(r["v"]), r["id"], r["row"], r["v"]) for r in queries.select("id", "row", "v").toLocalIterator())
    for d in {x[0] for x in taken}:
        _, ids, numbers, vectors = zip(*(x for x in taken if x[0] == d), strict=True)
        by_size[d] = np.array(ids), np.array(vectors, dtype=np.float64).reshape(len(ids), d), np.array(numbers)
    sent = spark.sparkContext.broadcast(by_size)

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each query, the k-th largest lower bound of a task's vectors (one more, as the query may be among them)."""
        best: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, n, cells in zip(*(batch.column(c).to_pylist() for c in ("d", "n", "cells")), strict=True):
                if d not in sent.value:
                    continue
                vectors, had = sent.value[d][1], best.get(d)
                parts = []
                for q in range(0, len(vectors), TOGETHER):
                    low, _ = _limits(d, bounds, cells, n, vectors[q : q + TOGETHER])
                    low = low if had is None else np.hstack([had[q : q + TOGETHER], low])
                    parts.append(-np.partition(-low, k, axis=1)[:, : k + 1] if low.shape[1] > k + 1 else low)
                best[d] = np.vstack(parts)
        for d, low in best.items():
            if low.shape[1] > k:
                at = low.min(axis=1)
                yield pa.RecordBatch.from_pydict({"d": pa.array([d] * len(at), pa.int32()), "i": pa.array(range(len(at)), pa.int32()), "reached": pa.array(at)})

    sure = {d: np.full(len(ids), -np.inf) for d, (ids, *_) in by_size.items()}
    for r in file.select("d", "n", "cells").mapInArrow(reach, "d int, i int, reached double").groupBy("d", "i").agg(F.max("reached").alias("reached")).collect():
        sure[r["d"]][r["i"]] = r["reached"]
    certain = spark.sparkContext.broadcast(sure)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, n, ids, numbers, cells, data in zip(*(batch.column(c).to_pylist() for c in ("d", "n", "ids", "numbers", "cells", "exact")), strict=True):
                if d not in sent.value:
                    continue
                names, vectors, own = sent.value[d]
                ids, numbers, rows = np.frombuffer(ids, dtype="<i8"), np.frombuffer(numbers, dtype="<i8"), np.frombuffer(data).reshape(n, d)
                out: list[tuple] = []
                for q in range(len(names)):
                    if q % TOGETHER == 0:
                        _, highs = _limits(d, bounds, cells, n, vectors[q : q + TOGETHER])
                    high = highs[q % TOGETHER]
                    able = np.flatnonzero((high >= certain.value[d][q]) & (numbers != own[q]))
                    if len(able):
                        out += _best(int(names[q]), int(own[q]), vectors[q], ids, rows, able[np.argsort(-high[able], kind="stable")], high, k)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["query_id", "query_row", "vec_id", "score"])

    return file.mapInArrow(exact, FOUND)


def _best(name: int, number: int, vector: np.ndarray, ids: np.ndarray, rows: np.ndarray, order: np.ndarray, high: np.ndarray, k: int) -> list[tuple]:
    """Reads exact vectors in the order of their upper bounds, a few at a time, until no further one can be among the k best."""
    got_ids, got = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    step = 2 * k
    for at in range(0, len(order), step):
        if len(got) >= k and np.partition(got, len(got) - k)[len(got) - k] > high[order[at]]:
            break
        part = order[at : at + step]
        got_ids, got = np.concatenate([got_ids, ids[part]]), np.concatenate([got, _scores(vector, rows[part])])
    best = np.lexsort((got_ids, -got))[:k]
    return [(name, number, int(i), int(s)) for i, s in zip(got_ids[best], got[best], strict=True)]

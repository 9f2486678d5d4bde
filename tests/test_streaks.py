"""Failure streaks of one log: those of a fold over all rows, from ranges of time."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stackwise.operators import enrich


def folded(log):
    out, n = [], 0
    for at, failed in sorted(log):
        n = n + 1 if failed else 0
        if failed:
            out.append((at, n))
    return out


@pytest.mark.parametrize(("share", "ranges"), [(0.5, 8), (0.9, 8), (0.999, 16), (1.0, 8), (0.0, 4), (0.97, 1)])
def test_streaks_equal_a_fold(spark, share, ranges):
    rnd = random.Random(int(share * 1000))
    log = [(float(at), rnd.random() < share) for at in rnd.sample(range(100_000), 3000)]
    rows = spark.createDataFrame(log, "at double, failed boolean").repartition(5)
    got = enrich.streaks_of_one(rows, ranges)
    assert sorted((r["at"], r["streak"]) for r in got.collect()) == folded(log)


def test_no_task_has_all_rows(spark):
    rows = spark.range(20_000).select(F.col("id").cast("double").alias("at"), (F.col("id") % 1000 != 7).alias("failed"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["n"] for r in enrich.streaks_of_one(rows).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 19_980 and max(sizes) < 15_000


def test_an_empty_log(spark):
    none = spark.createDataFrame([], "at double, failed boolean")
    assert enrich.failure_pauses(none).count() == 0

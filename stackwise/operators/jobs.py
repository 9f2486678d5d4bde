"""Background jobs from their update log: latest state, history, recovery after a restart, throttled persistence."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
ACTIVE, TERMINAL = ("queued", "running"), ("finished", "failed", "interrupted")
HISTORY, SHOWN = 100, 12
INTERVAL_SECONDS, PROGRESS = 10.0, 250
ERRORS, ERROR_LENGTH = 50, 500
INTERRUPTED = "服务重启时任务仍处于 queued/running，已标记为中断"
MESSAGES = {"metadata": "服务重启导致任务中断；未完成元数据将由启动恢复流程重新排队", "scan": "服务重启导致扫描中断；请确认扫描目录后重新开始"}
OTHER_MESSAGE = "服务重启导致任务中断"


def latest_state(log: DataFrame, key: str = "id", order: tuple[str, ...] = ("updated_at",)) -> DataFrame:
    """The last row of each key: an upsert log read as a table."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, *(F.col(f"r.{c}") for c in rest))


def history(jobs: DataFrame, limit: int = HISTORY) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def active(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status").isin(*ACTIVE)).orderBy(F.desc("created_at"), F.desc("id"))


def interrupted_message(kind: Column) -> Column:
    out = F
    for k, message in MESSAGES.items():
        out = out.when(kind == k, message)
    return out.otherwise(OTHER_MESSAGE)


def capped(errors: Column) -> Column:
    """The last ERRORS messages, each cut at ERROR_LENGTH."""
    cut = F.transform(errors, lambda e: F.substring(e, 1, ERROR_LENGTH))
    return F.slice(cut, F.greatest(F.lit(1), F.size(cut) - (ERRORS - 1)), ERRORS)


def recover(jobs: DataFrame, now: float) -> DataFrame:
    """The history and all active jobs, those now interrupted with message and error; ``interrupted`` marks them."""
    recent = history(jobs).select("id")
    wanted = recent.unionByName(jobs.where(F.col("status").isin(*ACTIVE)).select("id")).distinct()
    was = F.col("status").isin(*ACTIVE)
    out = jobs.join(wanted, "id", "left_semi").withColumn("interrupted", was)
    new = {"status": F.lit("interrupted"), "message": interrupted_message(F.col("kind")), "updated_at": F.lit(now)}
    if "errors" in jobs.columns:
        new["errors"] = capped(F.concat(F.coalesce("errors", F.expr("cast(array() as array<string>)")), F.array(F.lit(INTERRUPTED))))
    return out.select(*(F.when(was, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in jobs.columns), "interrupted")


def throttled(log: DataFrame, columns: str = "id string, seq long, at double, status string, processed long") -> DataFrame:
    """Updates that are persisted: of a job's log (id, seq, at, status, processed), the first, those of a new or final status,
    and those 10 s or 250 items after the last persisted one.

    What was persisted last decides on the next, so a job's updates are folded in order. They are dealt by job and sorted
    there, and the fold is a stream over the sorted rows: a job with very many updates needs no more memory than another.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        job, last_at, last_processed, status = None, 0.0, 0, ""
        for b in batches:
            keep = []
            for row in b.itertuples(index=False):
                first = row.id != job
                persisted = first or row.status != status or row.status in TERMINAL or row.at - last_at >= INTERVAL_SECONDS or row.processed - last_processed >= PROGRESS
                job, status = row.id, row.status
                if persisted:
                    last_at, last_processed = row.at, row.processed
                keep.append(persisted)
            yield b[keep]

    names = [c.split()[0] for c in columns.split(", ")]
    return log.select(*names).repartition("id").sortWithinPartitions("id", "seq").mapInPandas(fold, columns)

"""Streams give what the batch operators give."""

from __future__ import annotations

from pyspark.sql import functions as F

from stackwise.streaming import incremental


def test_files_arrive_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("a")
    (tmp_path / "in" / "b.bin").write_text("b")
    seen: list[str] = []

    def take(batch, _):
        seen.extend(r["filename"] for r in batch.select("filename").collect())

    for name in ("c.md", None):
        incremental.scan_stream(spark, str(tmp_path / "in"), take, str(tmp_path / "state")).awaitTermination(120)
        if name:
            (tmp_path / "in" / name).write_text("c")
    assert seen == ["a.txt", "c.md"]


def test_throttled_stream(spark, tmp_path):
    rows = [("j", i, i * 0.01, "running", i) for i in range(300)] + [("j", 300, 3.0, "finished", 300)]
    schema = "id string, seq long, at double, status string, processed long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "log"))
    stream = incremental.throttle_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "log")))
    q = stream.writeStream.format("memory").queryName("persisted").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r["seq"] for r in spark.table("persisted").orderBy(F.col("seq")).collect()] == [0, 250, 300]

"""Claims: one winner, an end, and no second time; in a folder and through Hadoop's file system."""

from __future__ import annotations

import multiprocessing
import threading

import pytest

from stackwise.operators import claims


def _race(folder: str, owner: str, start, out) -> None:
    start.wait()
    out.put((owner, claims.claim(claims.LocalMarks(folder), "job", owner, 10.0, 5.0)))


def test_one_of_many_processes_wins(tmp_path):
    context = multiprocessing.get_context("spawn")
    start, out = context.Event(), context.Queue()
    workers = [context.Process(target=_race, args=(str(tmp_path / "m"), f"p{i}", start, out)) for i in range(4)]
    for w in workers:
        w.start()
    start.set()
    got = dict(out.get(timeout=60) for _ in workers)
    for w in workers:
        w.join()
    assert sum(got.values()) == 1
    marks = claims.LocalMarks(str(tmp_path / "m"))
    assert got[claims.holder(marks, "job", 11.0)] and claims.holder(marks, "other", 11.0) == ""


@pytest.mark.parametrize("kind", ["local", "store"])
def test_leases_end_and_are_taken_over(spark, tmp_path, kind):
    marks = claims.LocalMarks(str(tmp_path / "m")) if kind == "local" else claims.StoreMarks(spark, f"file://{tmp_path}/m")
    assert marks.names() == [] and marks.read("x") is None
    assert claims.claim(marks, "a", "dead", 10.0, 5.0) and not claims.claim(marks, "a", "next", 14.9, 5.0) and claims.claim(marks, "ab", "next", 10.0, 5.0)
    assert claims.claim(marks, "a", "next", 15.0, 5.0) and claims.holder(marks, "a", 16.0) == "next"
    assert not claims.finish(marks, "a", "dead", 16.0) and claims.finish(marks, "a", "next", 16.0) and not claims.finish(marks, "a", "next", 16.0)
    assert not claims.claim(marks, "a", "third", 1e9) and claims.holder(marks, "a", 17.0) == ""
    assert not marks.create("a.claim-1", "x") and marks.create("b.claim-1", "")
    assert not claims.claim(marks, "b", "x", 1e9)  # a mark whose text isn't there yet holds


def test_threads_race_for_a_lease_that_has_ended(tmp_path):
    marks, got = claims.LocalMarks(str(tmp_path)), []
    assert claims.claim(marks, "a", "dead", 0.0, 1.0)
    gate = threading.Barrier(8)

    def run(i: int) -> None:
        gate.wait()
        got.append(claims.claim(marks, "a", f"t{i}", 2.0, 1.0))

    threads = [threading.Thread(target=run, args=(i,)) for i in range(8)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert sum(got) == 1


def test_ids_in_flight(spark):
    ids, none = spark.createDataFrame([(i,) for i in range(6)], "id long"), spark.createDataFrame([], claims.LEASES)
    granted, leases = claims.lease(ids, none, "a", 0.0, 10.0)
    assert granted.count() == 6
    assert claims.lease(ids, leases, "b", 5.0)[0].count() == 0 and claims.lease(ids, leases, "a", 5.0)[0].count() == 6
    left = claims.release(ids.where("id < 4"), leases, "a")
    assert {r["id"] for r in claims.lease(ids, left, "b", 5.0)[0].collect()} == {0, 1, 2, 3}
    assert {r["id"] for r in claims.lease(ids, left, "b", 10.0)[0].collect()} == set(range(6))
    assert claims.release(ids, left, "b").count() == 2


def test_marks_elsewhere_need_a_session():
    with pytest.raises(ValueError, match="session"):
        claims.marks_in("hdfs://somewhere/x")

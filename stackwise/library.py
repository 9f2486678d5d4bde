"""The engine's front: a catalog in a folder of snapshots, and the requests that it answers."""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import copies, enrich, facets, jobs, merge, operations, paging, postings, search
from .operators.backoff import Backoff
from .plans import repair, scan
from .schema import CATALOG
from .sources import files
from .streaming.incremental import Spaced

#: Environment switch that turns lookups off, and the values that do.
LOOKUPS_OFF, YES = "STACKWISE_NO_LOOKUPS", ("1", "true", "yes", "on")


def lookups_disabled() -> bool:
    return os.environ.get(LOOKUPS_OFF, "").strip().lower() in YES


def as_json(answer) -> str:
    """An answer to a request as JSON text. A frame in it is the list of its rows with all their fields, so it has to be
    a page, a facet or a preview, which are small; a table is written by Spark instead."""

    def rows(x) -> list:
        if not isinstance(x, DataFrame):
            raise TypeError(f"no JSON for {type(x).__name__}")
        text = x.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"))
        return [json.loads(r["row"]) for r in text.collect()]

    return json.dumps(answer, ensure_ascii=False, default=rows)


class Library:
    """A catalog whose snapshots lie below ``folder``, in any store that Spark reads and writes; ``backoff`` pauses lookups."""

    def __init__(self, spark: SparkSession, folder: str, backoff: Backoff | None = None):
        self.spark, self.folder, self.backoff = spark, folder.rstrip("/"), backoff

    def versions(self, below: str = "") -> list[int]:
        """Complete snapshots, oldest first; or those of a folder below."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.folder + below)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        paths = [s.getPath() for s in fs.listStatus(root)]
        return sorted(int(p.getName().removeprefix("version=")) for p in paths if p.getName().startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    @property
    def catalog(self) -> DataFrame:
        """The newest snapshot."""
        found = self.versions()
        return self.snapshot(found[-1]) if found else scan.empty_catalog(self.spark)

    def snapshot(self, version: int) -> DataFrame:
        return self.spark.read.schema(CATALOG).parquet(f"{self.folder}/version={version:012d}")

    def postings(self, version: int | None = None) -> DataFrame | None:
        """The search index of a version (the newest), if index() has made it."""
        version = version if version is not None else (self.versions() or [0])[-1]
        return self.spark.read.schema(postings.POSTINGS).parquet(f"{self.folder}/postings/version={version:012d}") if version in self.versions("/postings") else None

    def index(self) -> str | None:
        """Makes the newest version's search index, from that of an older one if there is one; its path, None if it is there."""
        newest, made = (self.versions() or [0])[-1], self.versions("/postings")
        if newest in made or not newest:
            return None
        catalog, older = self.catalog, [v for v in made if v in self.versions()]
        if older:
            changed = postings.changed_ids(self.snapshot(older[-1]), catalog)
            rows = postings.update(self.postings(older[-1]), catalog, changed)
        else:
            rows = postings.build(catalog)
        return scan.publish(rows.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block"), f"{self.folder}/postings", newest)

    @property
    def book_tags(self) -> DataFrame:
        return merge.bridge_of(self.catalog)

    def publish(self, snapshot: DataFrame) -> str:
        """The next snapshot. Two writers of one version: the second fails."""
        return scan.publish(snapshot.select(CATALOG.names), self.folder, (self.versions() or [0])[-1] + 1)

    # reading

    def search(self, spec: search.SearchSpec = search.SearchSpec(), page: int = 1, page_size: int = search.PAGE) -> tuple[int, DataFrame]:
        """(number of matches, a page as shown); the page's tags are joined for its rows only. The search index is used if there is one."""
        catalog, bridge, index = self.catalog, self.book_tags, self.postings()
        if index is not None:
            catalog = postings.narrowed(catalog, index, spec.query)
        rows = search.search(catalog, bridge, spec, page, page_size)
        mine = bridge.join(F.broadcast(rows.select(F.col("id").alias("book_id"))), "book_id", "left_semi")  # a page has 200 rows at most
        return search.total(catalog, bridge, spec), search.display(rows, mine).orderBy(*search.ordering(spec))

    def _order(self, spec: search.SearchSpec) -> str:
        """The folder of an order of the newest version."""
        name = hashlib.sha256(json.dumps([spec.query, search.wanted_tags(spec.tags), spec.format, spec.status, spec.sort, spec.order]).encode()).hexdigest()[:32]
        return f"{self.folder}/orders/version={(self.versions() or [0])[-1]:012d}/{name}"

    def _is_there(self, folder: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/ranges/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def keep_order(self, spec: search.SearchSpec) -> int | None:
        """Keeps the newest version's order for page(); returns its rows, None if it is kept."""
        folder = self._order(spec)
        return None if self._is_there(folder) else paging.build(paging.ordered(self.catalog, self.book_tags, spec), folder)

    def page(self, spec: search.SearchSpec, page: int = 1, page_size: int = paging.PAGE) -> DataFrame | None:
        """A page of a kept order, however far down, from the file or two that it lies in; None if the order isn't kept."""
        folder = self._order(spec)
        return paging.page_rows(self.catalog, folder, page, page_size) if self._is_there(folder) else None

    def tags(self) -> DataFrame:
        return facets.tag_facet(self.catalog, self.book_tags)

    def formats(self) -> DataFrame:
        return facets.format_facet(self.catalog)

    def stats(self, now: float | None = None) -> dict:
        """Rows by status, size of the active ones, and the state of their lookups."""
        catalog = self.catalog
        return {
            "status": {r["status"]: r["count"] for r in facets.status_histogram(catalog).collect()},
            "total_size": facets.active_size(catalog).first()["total_size"],
            "lookups": facets.lookup_stats(catalog, time.time() if now is None else now).first().asDict(),
        }

    def select(self, request: dict) -> DataFrame:
        return search.resolve_selection(self.catalog, self.book_tags, request)

    def due(self, now: float | None = None, limit: int | None = None) -> DataFrame:
        """Ids to look up; none if lookups are turned off or pause."""
        out = enrich.select_due(self.catalog, time.time() if now is None else now, limit)
        return out.limit(0) if lookups_disabled() or (self.backoff and self.backoff.status()["active"]) else out

    def invariants(self, root: str | None = None) -> DataFrame:
        return repair.invariants(self.catalog, self.book_tags, files.list_files(self.spark, root) if root else None)

    # writing

    def scan(self, root: str, with_text: bool = True, now: float | None = None, report: Callable[[int, str], None] | None = None) -> dict:
        """Scans a folder into the next snapshot; returns the counters, with the files and bytes that were read.

        ``report(files so far, "running" or "finished")`` is called as tasks end, every 100 files or 2 seconds, and at the end.
        """
        work = f"{self.folder}/_work/{uuid.uuid4().hex}"
        told = Spaced(report) if report else None
        try:
            snapshot, found = scan.scan(self.spark, root, self.catalog, time.time() if now is None else now, with_text, work, told and told.seen)
            self.publish(snapshot)
            read = self.spark.read.parquet(f"{work}/read")
            found = found.select("path", "action", "remote_due").join(read.select("path", "own.scan_error"), "path", "left")
            counters = facets.scan_counters(found).first().asDict() | read.agg(F.count("*").alias("files_read"), F.coalesce(F.sum("bytes_read"), F.lit(0)).alias("bytes_read")).first().asDict()
        finally:
            self._remove(work)
        if told:
            told.end()
        return counters

    def _remove(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def share_copies(self, now: float | None = None) -> int:
        """Copies what was looked up to identical files; returns how many rows changed."""
        out = copies.propagate(self.catalog, time.time() if now is None else now)
        changed = out.where("changed").count()
        if changed:
            self.publish(out)
        return changed

    def add_tags(self, ids: DataFrame, names: list[str], now: float | None = None) -> str:
        return self.publish(merge.add_tags(self.catalog, self.book_tags, ids, names, time.time() if now is None else now)[0])

    def apply_lookups(self, found: DataFrame, now: float | None = None) -> str:
        return self.publish(merge.apply_lookup(self.catalog, found, time.time() if now is None else now))

    def repair(self, root: str, options: repair.RepairOptions = repair.RepairOptions(), apply: bool = False, now: float | None = None) -> DataFrame:
        """The preview of a repair of bad rows; applied, it is the next snapshot."""
        catalog, listing = self.catalog, files.list_files(self.spark, root)
        bad = catalog.where("status = 'active'").where(repair.needs_repair()).select("path")
        preview = repair.repair_preview(catalog, scan.extract(listing.join(bad, "path", "left_semi"), listing), options)
        if apply:
            self.publish(repair.repair_apply(catalog, preview, time.time() if now is None else now))
        return preview

    def freeze(self, ids: list[int], root: str, now: float | None = None) -> tuple[dict, DataFrame]:
        return operations.freeze(self.catalog, ids, files.list_files(self.spark, root), time.time() if now is None else now)

    def execute(self, batch: dict, items: DataFrame, confirm: str, root: str, state_folder: str, quarantine: str, now: float | None = None) -> tuple[dict, DataFrame]:
        """Carries a frozen deletion out and marks the moved rows; the files go back if the catalog has changed meanwhile."""
        at, version = time.time() if now is None else now, (self.versions() or [0])[-1]
        catalog = self.catalog

        def commit(after: DataFrame) -> None:
            """The snapshot right after the one that was checked: fails if another writer was faster."""
            scan.publish(operations.quarantined(catalog, after, at).select(CATALOG.names), self.folder, version + 1)

        return operations.execute(batch, items, catalog, files.list_files(self.spark, root), confirm, state_folder, quarantine, at, commit)

    def copy_out(self, ids: list[int], folder: str) -> dict:
        return operations.copy_out(search.in_request_order(self.catalog, ids), folder)

    def backup(self, folder: str, day: str) -> str:
        return scan.daily_backup(self.catalog, folder, day)

    @staticmethod
    def jobs(table: DataFrame) -> DataFrame:
        return jobs.history(table)

"""Copying out and two-phase deletion: a selection is frozen, checked against catalog and files, claimed once, then carried out."""

from __future__ import annotations

import json
import os
import shutil
import socket
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t
from . import claims

TOLERANCE = 0.001
KIND = "safe_delete"
#: Whom this process's claims are of.
OWNER = f"{socket.gethostname()}-{os.getpid()}-{uuid.uuid4().hex[:8]}"
MISSING, NOT_FILE, SIZE, MTIME, RECORD, DRIFT = "文件不存在", "源路径不是文件", "文件大小变化", "文件修改时间变化", "记录不存在", "索引状态变化"
MOVED_BACK, STUCK = "数据库记录已变化，文件已回移，操作停止", "数据库状态变化且文件回移失败"


def phrase(count: int) -> str:
    """What a user has to confirm."""
    return f"安全删除 {count} 本书"


def unique_names(rows: DataFrame, path: str = "path", taken: DataFrame | None = None) -> DataFrame:
    """rows with ``target``: the file's name, for further files of that name "name (2).ext" and so on, by path.

    ``taken`` (column name) lists names that exist; a plan counts their files first.
    """
    name = F.substring_index(path, "/", -1)
    number = F.row_number().over(Window.partitionBy("_name").orderBy(path))
    out = rows.withColumn("_name", name)
    if taken is not None:
        out = out.join(taken.select(F.col("name").alias("_name"), F.lit(1).alias("_taken")).distinct(), "_name", "left")
        number = number + F.coalesce("_taken", F.lit(0))
    out = out.withColumn("_k", number)
    stem, suffix = F.regexp_replace("_name", r"(?<=.)\.[^.]+\z", ""), F.regexp_extract("_name", r"(?<=.)(\.[^.]+)\z", 1)
    target = F.when(F.col("_k") == 1, F.col("_name")).otherwise(F.concat(stem, F.lit(" ("), F.col("_k").cast("string"), F.lit(")"), suffix))
    return out.withColumn("target", target).drop("_name", "_k", "_taken")


def copy_out(rows: DataFrame, folder: str) -> dict:
    """Copies the files of rows (path) to a folder, one after the other, and reports: copied, requested, errors (50 at most)."""
    os.makedirs(folder, exist_ok=True)
    copied, requested, errors = 0, 0, []
    for r in unique_names(rows.select("path")).toLocalIterator():
        requested += 1
        try:
            shutil.copy2(r["path"], os.path.join(folder, r["target"]))
            copied += 1
        except FileNotFoundError:
            errors.append(f"{MISSING}：{r['path']}")
        except OSError as e:
            errors.append(f"{r['path']}: {e}")
    return {"copied": copied, "requested": requested, "target": folder, "errors": errors[:50]}


def state_error(path: Column, size: Column, mtime: Column, seen_size: Column, seen_mtime: Column, is_file: Column) -> Column:
    """Why a file is not as it was when frozen, '' if it is; seen_size null: it isn't there."""
    why = (
        F.when(seen_size.isNull(), MISSING)
        .when(~is_file, NOT_FILE)
        .when(seen_size != size, SIZE)
        .when(F.abs(seen_mtime - mtime) >= TOLERANCE, MTIME)
    )
    return F.coalesce(F.concat(why, F.lit("："), path), F.lit(""))


def check_items(items: DataFrame, catalog: DataFrame, listing: DataFrame) -> DataFrame:
    """Frozen items (book_id, position, path, size, mtime) with ``error``: against the catalog first, then against a fresh listing (path, size, mtime, is_file)."""
    c = catalog.select(F.col("id").alias("c_id"), F.col("path").alias("c_path"), F.col("size").alias("c_size"), F.col("mtime").alias("c_mtime"), F.col("status").alias("c_status"))
    f = listing.select(F.col("path").alias("f_path"), F.col("size").alias("f_size"), F.col("mtime").alias("f_mtime"), "is_file")
    both = items.join(c, F.col("book_id") == F.col("c_id"), "left").join(f, F.col("path") == F.col("f_path"), "left")
    drift = (F.col("c_path") != F.col("path")) | (F.col("c_size") != F.col("size")) | (F.abs(F.col("c_mtime") - F.col("mtime")) >= TOLERANCE) | (F.col("c_status") != "active")
    subject = F.concat(F.lit("：ID "), F.col("book_id").cast("string"))
    error = F.when(F.col("c_id").isNull(), F.concat(F.lit(RECORD), subject)).when(drift, F.concat(F.lit(DRIFT), subject)).otherwise(state_error(F.col("path"), F.col("size"), F.col("mtime"), F.col("f_size"), F.col("f_mtime"), F.col("is_file")))
    return both.select(*items.columns, error.alias("error"))


def freeze(catalog: DataFrame, ids: Sequence[int], listing: DataFrame, now: float) -> tuple[dict, DataFrame]:
    """A pending batch and its items with positions. Nothing is frozen if an id is unknown or a file isn't as recorded."""
    wanted = list(dict.fromkeys(int(i) for i in ids))
    asked = catalog.sparkSession.createDataFrame(list(enumerate(wanted)), "position int, book_id long")
    rows = asked.join(catalog, F.col("book_id") == F.col("id"))
    items = rows.select("position", "book_id", "path", "size", "mtime", F.coalesce(F.nullif("title", F.lit("")), F.col("filename")).alias("title"))
    n = items.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    if not n["n"]:
        raise ValueError("没有可执行安全删除的书籍")
    if n["n"] != len(wanted):
        missing = [r["book_id"] for r in asked.join(catalog, F.col("book_id") == F.col("id"), "left_anti").orderBy("position").limit(10).collect()]
        raise ValueError(f"部分书籍记录不存在，未创建操作：{missing}")
    if bad := check_items(items, catalog, listing).where("error <> ''").orderBy("position").first():
        raise ValueError(f"源文件状态与索引不一致，未创建操作：{bad['error']}")
    operation = uuid.uuid4().hex
    batch = {"id": operation, "kind": KIND, "status": "pending", "confirm_phrase": phrase(n["n"]), "item_count": n["n"], "total_size": n["size"], "created_at": now, "started_at": 0.0, "completed_at": 0.0, "output_path": "", "error": ""}
    return batch, items.select(F.lit(operation).alias("operation_id"), *items.columns, F.lit("planned").alias("status"), F.lit("").alias("quarantine_path"), F.lit("").alias("error"))


def claim(folder: str, operation: str, now: float = 0.0, spark: SparkSession | None = None) -> bool:
    """Whether this caller may carry the operation out: see claims.claim. A dead driver's claim ends; what it moved then rejects the batch."""
    return claims.claim(claims.marks_in(folder, spark), operation, OWNER, now)


def _move_back(moved: dict) -> str:
    """Moves a file back to where it was; why that failed, '' if it didn't."""
    try:
        if os.path.exists(moved["original_path"]):
            raise FileExistsError(moved["original_path"])
        os.makedirs(os.path.dirname(moved["original_path"]), exist_ok=True)
        shutil.move(moved["quarantine_path"], moved["original_path"])
        return ""
    except OSError as e:
        return f"{STUCK}：{e}"[:500]


def _with_outcome(items: DataFrame, outcome: list[tuple]) -> DataFrame:
    """items with what became of them (book_id, status, quarantine_path, error); the others as they are."""
    done = items.sparkSession.createDataFrame(outcome, "book_id long, new_status string, new_path string, new_error string")
    new = {"status": "new_status", "quarantine_path": "new_path", "error": "new_error"}
    return items.join(F.broadcast(done), "book_id", "left").select(*(F.coalesce(new[c], items[c]).alias(c) if c in new else items[c] for c in items.columns))


def execute(batch: dict, items: DataFrame, catalog: DataFrame, listing: DataFrame, confirm: str, state_folder: str, quarantine: str, now: float, commit: Callable[[DataFrame], object] | None = None) -> tuple[dict, DataFrame]:
    """Moves a pending batch's files below ``quarantine``; returns the batch as it is then, and the items with their outcome.

    Anything that has changed since the preview rejects the batch before a file is moved. The moves are made by the driver
    in order; the first that fails ends them. ``commit`` gets the items with their outcome and updates the catalog, whose
    snapshots are written whole: if it fails, all files of the batch go back. A manifest of the files that stay moved is
    written beside them.
    """
    if batch["kind"] != KIND or batch["status"] != "pending":
        raise ValueError(f"安全删除操作当前状态不可执行：{batch['status']}")
    if confirm != batch["confirm_phrase"]:
        raise ValueError("确认短语不匹配，未执行删除")
    bad = [r["error"] for r in check_items(items.drop("error"), catalog, listing).where("error <> ''").orderBy("position").limit(10).collect()]
    if bad:
        return batch | {"status": "rejected", "completed_at": now, "error": "；".join(bad)[:1000]}, items
    if not claim(state_folder, batch["id"], now, items.sparkSession):
        raise ValueError("安全删除操作已被其他请求领取或状态已变化")
    outcome, manifest, error = [], [], ""
    for r in items.orderBy("position").withColumn("relative", t.safe_relative_path(F.col("path"))).toLocalIterator():
        target = os.path.join(quarantine, r["relative"])
        try:
            seen = os.stat(r["path"])
            if seen.st_size != r["size"] or abs(seen.st_mtime - r["mtime"]) >= TOLERANCE:
                raise OSError(f"{SIZE if seen.st_size != r['size'] else MTIME}：{r['path']}")
            os.makedirs(os.path.dirname(target), exist_ok=True)
            k, (stem, suffix) = 2, os.path.splitext(target)
            while os.path.exists(target):
                target, k = f"{stem} ({k}){suffix}", k + 1
            shutil.move(r["path"], target)
        except OSError as e:
            error = str(e)[:500]
            outcome.append((r["book_id"], "failed", "", error))
            break
        outcome.append((r["book_id"], "moved", target, ""))
        manifest.append({"id": r["book_id"], "title": r["title"], "original_path": r["path"], "quarantine_path": target, "size": r["size"], "mtime": r["mtime"]})
    if commit and manifest:
        try:
            commit(_with_outcome(items, outcome))
        except Exception as e:  # noqa: BLE001  whatever kept the catalog from being written, files must not stay where it doesn't know them
            error = f"{MOVED_BACK}：{e}"[:500]
            stuck = {m["id"]: _move_back(m) for m in reversed(manifest)}
            manifest = [m for m in manifest if stuck[m["id"]]]
            left = {m["id"]: m["quarantine_path"] for m in manifest}
            outcome = [(i, "failed", left.get(i, ""), stuck.get(i, why) or error) for i, _, _, why in outcome]
    os.makedirs(quarantine, exist_ok=True)
    with open(os.path.join(quarantine, "manifest.json"), "w", encoding="utf-8") as f:
        json.dump(manifest, f, ensure_ascii=False, indent=2)
    claims.finish(claims.marks_in(state_folder, items.sparkSession), batch["id"], OWNER, now)
    return batch | {"status": "failed" if error else "completed", "started_at": now, "completed_at": now, "output_path": quarantine, "error": error}, _with_outcome(items, outcome)


def quarantined(catalog: DataFrame, items: DataFrame, now: float) -> DataFrame:
    """The next snapshot: rows of moved items are quarantined."""
    moved = items.where("status = 'moved'").select(F.col("book_id").alias("m_id"), F.col("quarantine_path").alias("m_path"))
    hit = F.col("m_id").isNotNull()
    new = {"status": F.lit("quarantined"), "quarantine_path": F.col("m_path"), "updated_at": F.lit(now)}
    return catalog.join(moved, catalog["id"] == F.col("m_id"), "left").select(*(F.when(hit, new[c]).otherwise(catalog[c]).alias(c) if c in new else catalog[c] for c in catalog.columns))

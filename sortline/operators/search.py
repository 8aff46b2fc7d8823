"""Filters, lookups, searches with pages, and box tracking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed as V
from ..sources.tables import LEGACY, in_months


@dataclass(frozen=True)
class TaskFilter:
    """What a task search asks for. chute matches target or actual chute; wave may be the text for tasks without one."""

    start: object
    end: object
    wave: str | None = None
    barcode: str | None = None
    dock: str | None = None
    chute: str | None = None
    only_exceptions: bool = False
    only_recirculated: bool = False


def find_tasks(tasks: DataFrame, f: TaskFilter) -> DataFrame:
    rows = in_months(tasks, f.start, f.end)
    if f.wave is not None:
        rows = rows.filter(C.normalized_wave().isNull() if f.wave == V.NO_WAVE else C.key_text(C.normalized_wave()) == f.wave.strip().upper())
    if f.barcode is not None:
        rows = rows.filter(C.blank_to_null("barcode") == f.barcode.strip())
    if f.dock is not None:
        rows = rows.filter(F.col("resolved_dock_code") == f.dock.strip())
    if f.chute is not None:
        rows = rows.filter((F.col("target_chute_code") == f.chute.strip()) | (F.col("actual_chute_code") == f.chute.strip()))
    if f.only_exceptions:
        rows = rows.filter(C.is_exceptional())
    if f.only_recirculated:
        rows = rows.filter(C.is_recirculated_dock_strict())
    return rows


def active_tasks(tasks: DataFrame) -> DataFrame:
    """Tasks that are neither dropped nor exceptional by status, to be found by barcode."""
    return tasks.filter(~F.col("status").isin(V.DROPPED, V.EXCEPTION) & C.blank_to_null("barcode").isNotNull())


def newest_by(tasks: DataFrame, *keys: str) -> DataFrame:
    """The newest created task of each key; null keys aren't found. Ids part equal times."""
    return C.first_of(tasks.dropna(subset=list(keys)), list(keys), F.desc("created_time"), F.desc("shard_month"), F.desc("id"))


def by_newest_month(tasks: DataFrame) -> DataFrame:
    """One task for each id: ids repeat over months, and the newest month wins, with legacy rows last."""
    month = F.when(F.col("shard_month") == LEGACY, "").otherwise(F.col("shard_month"))
    return C.first_of(tasks, ["id"], F.desc(month), F.desc("created_time"))


def with_pairs(tasks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Tasks whose (source_table_code, business_key) is among the pairs."""
    return tasks.join(pairs, ["source_table_code", "business_key"], "left_semi")


def wave_task_stats(tasks: DataFrame, start, end, wave: str) -> DataFrame:
    """The few columns of a wave's tasks that its statistics need."""
    rows = find_tasks(tasks, TaskFilter(start, end, wave=wave))
    return rows.select("task_code", "wave_code", "wave_remark", "source_type", "status", "working_area", "resolved_dock_code", "is_exception", "is_recirculated", "updated_time")


def task_items(tasks: DataFrame) -> DataFrame:
    """Tasks as a search shows them: the dock anew from the chutes, recirculation by the flag alone."""
    return tasks.select(
        "id",
        "task_code",
        "barcode",
        C.normalized_wave().alias("wave_code"),
        C.status_text("status").alias("status_text"),
        C.source_text("source_type").alias("source_text"),
        C.resolved_dock().alias("dock_code"),
        C.is_exceptional().alias("is_exception"),
        "is_recirculated",
        "created_time",
        "scanned_at",
    )


def newest_first(time: str) -> list[Column]:
    """The order of pages; legacy rows come last."""
    legacy = [F.expr(f"shard_month = '{LEGACY}'")]
    return [*legacy, F.desc(time), F.desc("id")] if time == "created_time" else [F.desc(time), F.desc("id")]


def page(rows: DataFrame, number: int, size: int, time: str = "created_time") -> DataFrame:
    """Page `number` (from 1), newest first; legacy rows come last."""
    return rows.orderBy(*newest_first(time)).offset((number - 1) * size).limit(size)


def has_more(total: int, number: int, size: int) -> bool:
    return number * size < total


def page_after(rows: DataFrame, created, id_: int, size: int) -> DataFrame:
    """The page after a (created_time, id): it costs the same however deep it is. One row more than `size` tells that there are more."""
    at = C.ntz(created)
    after = rows.filter((F.col("created_time") < at) | ((F.col("created_time") == at) & (F.col("id") < id_)))
    return after.orderBy(F.desc("created_time"), F.desc("id")).limit(size + 1)


def count_tasks(tasks: DataFrame, f: TaskFilter) -> DataFrame:
    return find_tasks(tasks, f).agg(F.count("*").cast("long").alias("tasks"))


def find_scans(logs: DataFrame, start, end, barcode: str | None = None, device: str | None = None) -> DataFrame:
    rows = logs.filter(C.in_range("scan_time", start, end))
    if barcode is not None:
        rows = rows.filter(F.col("barcode") == barcode.strip())
    return rows if device is None else rows.filter(F.col("device_code") == device.strip())


def oldest_feedback(tasks: DataFrame, status: int, n: int) -> DataFrame:
    """The n oldest tasks with a feedback status."""
    return tasks.filter(F.col("feedback_status") == status).orderBy("created_time", "id").limit(n)


def box_status() -> Column:
    return (
        F.when(~F.col("is_matched"), V.BOX_UNMATCHED)
        .when(F.col("task_id").isNull(), V.BOX_MATCHED)
        .when(C.is_exceptional(), V.BOX_EXCEPTION)
        .when(C.is_recirculated_any(), V.BOX_RECIRCULATED)
        .otherwise(V.BOX_SCANNED)
    )


def box_tracking(logs: DataFrame, tasks: DataFrame, order: str | None = None, store: str | None = None, chute: str | None = None) -> DataFrame:
    """Scans with the task that each found, if any. Filters on the task keep just scans that have one."""
    columns = ("order_id", "store_id", "store_name", "product_code", "pick_location", "actual_chute_code", "target_chute_code", "resolved_dock_code", "status", "is_exception", "is_recirculated", "task_code", "wave_code")
    found = by_newest_month(tasks).select(F.col("id").alias("task_id"), *columns)
    rows = logs.join(found, F.col("business_task_id") == F.col("task_id"), "left")
    where = F.when(F.col("task_id").isNotNull(), C.chute())
    for c, v in ((F.col("order_id"), order), (F.col("store_id"), store), (where, chute)):
        if v is not None:
            rows = rows.filter(F.lower(c) == v.strip().lower())
    return rows.select(
        "id",
        F.col("barcode").alias("box_id"),
        "task_code",
        "wave_code",
        "order_id",
        "store_id",
        "store_name",
        "product_code",
        "pick_location",
        F.col("device_code").alias("scanner"),
        "scan_time",
        where.alias("chute"),
        box_status().alias("box_status"),
        "is_matched",
        "failure_reason",
    )


def audit_page(audit: DataFrame, start, end, number: int, size: int, **equal) -> DataFrame:
    """Audit rows of [start, end], both ends counted, with equal columns; newest first."""
    rows = audit.filter(F.col("started_time").between(C.ntz(start), C.ntz(end)))
    for c, v in equal.items():
        rows = rows.filter(F.col(c) == v)
    return rows.orderBy(F.desc("started_time"), F.desc("id")).offset((number - 1) * size).limit(size)


def source_page(rows: DataFrame, order: list[str], number: int, size: int) -> DataFrame:
    """Page of a source window by row number, for sources that must be read by pages. Each task keeps the rows up to the page's end alone; the numbers are given to the page's rows."""
    before = (number - 1) * size
    page = rows.orderBy(*order).offset(before).limit(size)
    return page.withColumn("row_nr", F.row_number().over(Window.orderBy(*order)) + before)

"""Dashboards and reports composed of the aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed as V
from ..sources.tables import in_months
from . import aggregates as A


def progress(total: str = "total", unsorted: str = "unsorted") -> Column:
    return C.percent(F.col(total) - F.col(unsorted), total)


def wave_status() -> Column:
    return F.when(F.col("exceptions") > 0, V.WAVE_EXCEPTION).when(F.col("unsorted") > 0, V.WAVE_SORTING).otherwise(V.WAVE_DONE)


def global_dashboard(tasks: DataFrame, logs: DataFrame, batches: DataFrame, definitions: DataFrame, start, end) -> DataFrame:
    """One row of totals, progress, recognition, feedback and sync freshness."""
    names = [n for n in A.measures() if n != "earliest_created"]
    totals = in_months(tasks, start, end).agg(
        *(c.alias(n) for n, c in A.measures().items() if n in names),
        A.count_if(F.col("feedback_status") != V.NOT_REQUIRED).alias("required"),
        A.count_if(F.col("feedback_status") == V.COMPLETED).alias("completed"),
    )
    seen = A.recognition_totals(logs, start, end)
    last = latest_batches(batches).join(definitions.select("table_code"), "table_code", "left_semi")
    done = last.agg(F.max(batch_time()).alias("latest_sync"), A.count_if(F.col("status") == V.BATCH_COMPLETED).alias("done"))
    wanted = definitions.agg(F.count("*").alias("wanted"))
    return (
        totals.crossJoin(seen)
        .crossJoin(done)
        .crossJoin(wanted)  # four tables of one row each
        .select(
            *names,
            progress().alias("progress_percent"),
            progress("full_case_total", "full_case_unsorted").alias("full_case_progress_percent"),
            progress("split_total", "split_unsorted").alias("split_progress_percent"),
            C.percent("matched", "scans").alias("recognition_percent"),
            "latest_sync",
            C.percent("done", "wanted").alias("download_percent"),
            C.percent("completed", "required").alias("writeback_percent"),
        )
    )


def global_wave_list(tasks: DataFrame, start, end) -> DataFrame:
    return A.wave_dashboard(tasks, start, end).select("wave_code", "total", "unsorted", progress().alias("progress_percent"))


def _of_wave(tasks: DataFrame, start, end, wave: str) -> DataFrame:
    return in_months(tasks, start, end).filter(C.key_text(A.wave_or_none()) == wave.strip().upper())


def wave_summary(tasks: DataFrame, start, end, wave: str) -> DataFrame:
    """One row for a wave, none if it has no tasks."""
    rows = _of_wave(tasks, start, end, wave).agg(
        F.min(A.wave_or_none()).alias("wave_code"),
        *(A.measures()[n].alias(n) for n in ("total", "unsorted", "recirculated", "exceptions")),
        A.newest_remark().alias("wave_remark"),
    )
    return rows.filter("total > 0").withColumn("progress_percent", progress())


def zone() -> Column:
    """Zone of a task: full cases have their own, splits go by their working area; null if it is unknown."""
    area = F.coalesce(C.alphanumeric_key("working_area"), F.lit(""))
    by_area = F.coalesce(*(F.when(area.isin(*areas), code) for code, _, areas in V.ZONES if areas))
    return F.when(F.col("source_type") == V.FULL_CASE, "FullCase").when(F.col("source_type") == V.SPLIT, by_area)


def wave_zones(tasks: DataFrame, start, end, wave: str) -> DataFrame:
    """All five zones of a wave in order, with zeros where it has none; no rows if the wave has no tasks."""
    rows = _of_wave(tasks, start, end, wave).withColumn("zone_code", zone())
    names = ("total", "unsorted", "recirculated", "exceptions")
    found = rows.groupBy("zone_code").agg(*(A.measures()[n].alias(n) for n in names))
    any_task = found.agg(F.count("*").alias("groups")).filter("groups > 0")
    zones = tasks.sparkSession.createDataFrame([(k + 1, code, name) for k, (code, name, _) in enumerate(V.ZONES)], "zone_order int, zone_code string, zone_name string")
    out = F.broadcast(zones).crossJoin(any_task).join(found, "zone_code", "left")  # five zones and one row
    counts = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names]
    return out.select("zone_order", "zone_code", "zone_name", *counts).withColumn("progress_percent", progress())


def wave_list(tasks: DataFrame, start, end) -> DataFrame:
    """Waves with counts, newest remark and status text."""
    exprs = {n: c for n, c in A.measures().items() if n not in ("recognised", "volume_mm3", "weight_gram")}
    out = A.by_code(in_months(tasks, start, end), {"wave_code": A.wave_or_none()}, exprs, remark=True)
    return out.withColumn("wave_status", wave_status())


def shown_exceptions() -> Column:
    """Exceptions are hidden for all docks but seven."""
    return F.when(C.is_exception_dock("dock_code"), F.col("exceptions")).otherwise(0).cast("long")


def dock_view(tasks: DataFrame, start, end, wave: str | None = None) -> DataFrame:
    """Docks of the given or the current wave; the latter only if it is one of the range's waves."""
    if wave is None:
        now = current_wave(tasks, start, end).select(C.key_text("wave_code").alias("k"))
        rows = in_months(tasks, start, end).join(F.broadcast(now), C.key_text(A.wave_or_none()) == F.col("k"), "left_semi")  # one row
        docks = A.dock_dashboard(rows, start, end)
    else:
        docks = A.dock_dashboard(tasks, start, end, wave=wave)
    return docks.withColumns({"progress_percent": C.percent("sorted", "total"), "exceptions": shown_exceptions()})


def sorting_report(tasks: DataFrame, start, end, dock: str | None = None) -> DataFrame:
    out = A.dock_dashboard(tasks, start, end, dock=dock)
    return out.select("dock_code", "split_total", "full_case_total", "split_sorted", "full_case_sorted", "recirculated", shown_exceptions().alias("exceptions")).orderBy("dock_code")


def recirculation_view(tasks: DataFrame, start, end, most_first: bool = True, limit: int | None = None) -> DataFrame:
    order = F.desc("recirculated") if most_first else F.asc("recirculated")
    out = A.recirculation_summary(tasks, start, end).orderBy(order, "chute_code", "wave_code")
    return out if limit is None else out.limit(limit)


def cleanup_preview(tasks: DataFrame, wave: str) -> DataFrame:
    """What a cleanup of a wave would meet; recirculation counts by flag or dock here."""
    rows = tasks.filter(C.key_text(C.normalized_wave()) == wave.strip().upper())
    exprs = {n: A.measures()[n] for n in ("total", "unsorted", "split_total", "full_case_total", "exceptions", "earliest_created")}
    exprs |= {"recirculated": A.count_if(C.is_recirculated_any()), "cleanable": A.count_if(C.is_cleanable()), "wave_remark": A.newest_remark()}
    return rows.agg(*(c.alias(n) for n, c in exprs.items())).filter("total > 0")


def current_wave(tasks: DataFrame, start, end) -> DataFrame:
    """Wave of the task scanned last, by (scanned, updated, id)."""
    rows = in_months(tasks, start, end).filter(F.col("scanned_at").isNotNull() & C.normalized_wave().isNotNull())
    top = rows.select("scanned_at", "updated_time", "id", C.normalized_wave().alias("wave_code"), C.blank_to_null("wave_remark").alias("wave_remark"), "barcode")
    return top.orderBy(F.desc("scanned_at"), F.desc("updated_time"), F.desc("id")).limit(1)


def wave_details(tasks: DataFrame, start, end, wave: str) -> DataFrame:
    """Tasks of a wave as shown to people."""
    rows = _of_wave(tasks, start, end, wave)
    return rows.select(
        "task_code",
        A.wave_or_none().alias("wave_code"),
        "wave_remark",
        C.source_text("source_type").alias("source_text"),
        "working_area",
        "barcode",
        "order_id",
        "store_id",
        "store_name",
        "product_code",
        "pick_location",
        C.chute().alias("chute_code"),
        C.status_text("status").alias("status_text"),
        C.is_recirculated_any().alias("is_recirculated"),
        C.is_exceptional().alias("is_exception"),
        "scanned_at",
        "created_time",
        "updated_time",
        "id",
    ).orderBy(F.desc(F.coalesce("scanned_at", "created_time")), F.desc("updated_time"), F.desc("id"))


def latest_batches(batches: DataFrame) -> DataFrame:
    """The latest batch of each table."""
    return C.first_of(batches, ["table_code"], F.desc(batch_time()), F.desc("batch_id"))


def batch_time() -> Column:
    return F.coalesce("completed_time", "started_time", "window_end")


def latest_failed_batch(batches: DataFrame) -> DataFrame:
    """The last failed batch of each table by its end."""
    failed = batches.filter(F.col("status") == V.BATCH_FAILED)
    return failed.groupBy("table_code").agg(F.max_by("batch_id", F.struct(F.coalesce("completed_time", F.lit("0001-01-01").cast("timestamp_ntz")), F.col("batch_id"))).alias("batch_id"))


def report(df: DataFrame, columns: tuple[str, ...], headers: tuple[str, ...]) -> DataFrame:
    """df as it stands in a CSV report: text columns under the report's headers, times to the second, flags 是 or 否, nulls empty, percents without trailing zeros."""
    kinds = dict(df.dtypes)

    def shown(c: str) -> Column:
        if kinds[c].startswith("timestamp"):
            v = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kinds[c] == "boolean":
            v = C.yes_no(c)
        elif kinds[c].startswith("decimal"):
            v = F.regexp_replace(F.round(c, 2).cast("string"), r"\.?0+$", "")
        else:
            v = F.col(c).cast("string")
        return F.coalesce(v, F.lit(""))

    return df.select(*(shown(c).alias(h) for c, h in zip(columns, headers, strict=True)))


WAVE_LIST_COLUMNS = ("wave_code", "wave_remark", "total", "unsorted", "split_total", "full_case_total", "split_unsorted", "full_case_unsorted", "recirculated", "exceptions", "earliest_created", "wave_status")
ZONE_COLUMNS = ("zone_name", "total", "unsorted", "progress_percent", "recirculated", "exceptions")
SORTING_COLUMNS = ("dock_code", "split_total", "full_case_total", "split_sorted", "full_case_sorted", "recirculated", "exceptions")
RECIRCULATION_COLUMNS = ("chute_code", "wave_code", "recirculated")
DETAIL_COLUMNS = ("task_code", "wave_code", "wave_remark", "source_text", "working_area", "barcode", "order_id", "store_id", "store_name", "product_code", "pick_location", "chute_code", "status_text", "is_recirculated", "is_exception", "scanned_at", "created_time", "updated_time")


DOCK_COLUMNS = ("dock_code", "split_unsorted", "full_case_unsorted", "recirculated", "exceptions", "sorted", "progress_percent")
BOX_COLUMNS = ("order_id", "box_id", "store_id", "store_name", "product_code", "pick_location", "scanner", "scan_time", "chute", "box_status")
GLOBAL_COLUMNS = (
    "total", "unsorted", "progress_percent", "full_case_total", "full_case_unsorted", "full_case_progress_percent", "split_total", "split_unsorted", "split_progress_percent",
    "recognition_percent", "recirculated", "exceptions", "volume_mm3", "weight_gram", "latest_sync", "download_percent", "writeback_percent",
)


def vertical_report(df: DataFrame, columns: tuple[str, ...], labels: tuple[str, ...], headers: tuple[str, ...]) -> DataFrame:
    """A table of one row as a report with a row for each of its columns, in order: label and value."""
    one = report(df, columns, labels)
    pairs = F.array(*(F.struct(F.lit(label).alias(headers[0]), F.col(f"`{label}`").alias(headers[1])) for label in labels))
    return one.select(F.posexplode(pairs).alias("nth", "pair")).orderBy("nth").select("pair.*")


def write_csv(df: DataFrame, path: str) -> None:
    """RFC 4180 files with a header; the first header starts with a byte order mark, by which spreadsheets know UTF-8."""
    first = df.columns[0]
    df.withColumnRenamed(first, "﻿" + first).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)

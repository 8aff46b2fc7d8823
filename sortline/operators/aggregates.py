"""Aggregates over tasks and scan logs. Every range is [start, end) on the creation or scan time; months outside it are pruned.

Codes are compared ignoring case; the shown value is the least of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed as V
from ..sources.tables import in_months


def count_if(c: Column) -> Column:
    return F.count_if(c).cast("long")


def wave_or_none() -> Column:
    return F.coalesce(C.normalized_wave(), F.lit(V.NO_WAVE))


def _total(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("decimal(28,3)")


def measures() -> dict[str, Column]:
    """Counts and sums that dashboards of waves share."""
    full, split, unsorted = F.col("source_type") == V.FULL_CASE, F.col("source_type") == V.SPLIT, ~C.is_sorted()
    return {
        "total": F.count("*").cast("long"),
        "unsorted": count_if(unsorted),
        "full_case_total": count_if(full),
        "full_case_unsorted": count_if(full & unsorted),
        "split_total": count_if(split),
        "split_unsorted": count_if(split & unsorted),
        "recognised": count_if(F.col("scanned_at").isNotNull()),
        "recirculated": count_if(C.is_recirculated_dock()),
        "exceptions": count_if(C.is_exceptional()),
        "volume_mm3": _total("volume_mm3"),
        "weight_gram": _total("weight_gram"),
        "earliest_created": F.min("created_time"),
    }


def newest_remark() -> Column:
    """The newest remark that isn't blank; of equal times the greatest."""
    remark = C.blank_to_null("wave_remark")
    return F.max_by(remark, F.when(remark.isNotNull(), F.struct("updated_time", remark)))


def _merged(name: str) -> Column:
    if name == "earliest_created":
        return F.min(name).alias(name)
    return F.sum(name).cast("decimal(28,3)" if name in ("volume_mm3", "weight_gram") else "long").alias(name)


def by_code(rows: DataFrame, codes: dict[str, Column], exprs: dict[str, Column], remark: bool = False) -> DataFrame:
    """exprs for each group of codes that are equal ignoring case, shown by the least of each; with wave_remark, the newest, if asked for.

    Rows are first grouped by the codes as they are (and the remark), which keeps texts out of the aggregates' values: Spark then hashes and needn't sort all rows. The few
    groups that are left are put together by upper case."""
    keys = [c.alias(n) for n, c in codes.items()]
    newest = [F.max("updated_time").alias("__newest")] if remark else []
    first = rows.groupBy(*keys, *([C.blank_to_null("wave_remark").alias("__remark")] if remark else [])).agg(F.count("*").alias("__rows"), *(c.alias(n) for n, c in exprs.items()), *newest)
    latest = [F.max_by("__remark", F.when(F.col("__remark").isNotNull(), F.struct("__newest", "__remark"))).alias("wave_remark")] if remark else []
    out = first.groupBy(*(C.key_text(n).alias(f"__{n}") for n in codes)).agg(*(F.min(n).alias(n) for n in codes), *map(_merged, exprs), *latest)
    return out.drop(*(f"__{n}" for n in codes))


def wave_dashboard(tasks: DataFrame, start, end) -> DataFrame:
    """A row for each wave, tasks without one under 未分波次."""
    return by_code(in_months(tasks, start, end), {"wave_code": wave_or_none()}, measures())


def dock_dashboard(tasks: DataFrame, start, end, wave: str | None = None, dock: str | None = None) -> DataFrame:
    """A row for each dock, of one wave or dock if given."""
    rows = in_months(tasks, start, end)
    if wave is not None:
        rows = rows.filter(C.key_text(wave_or_none()) == wave.upper())
    if dock is not None:
        rows = rows.filter(C.key_text("resolved_dock_code") == dock.upper())
    full, split = F.col("source_type") == V.FULL_CASE, F.col("source_type") == V.SPLIT
    exprs = {
        "total": F.count("*").cast("long"),
        "sorted": count_if(C.is_sorted()),
        "split_total": count_if(split),
        "split_unsorted": count_if(split & ~C.is_sorted()),
        "split_sorted": count_if(split & C.is_sorted()),
        "full_case_total": count_if(full),
        "full_case_unsorted": count_if(full & ~C.is_sorted()),
        "full_case_sorted": count_if(full & C.is_sorted()),
        "recirculated": count_if(C.is_recirculated_dock()),
        "exceptions": count_if(C.is_exceptional()),
    }
    return by_code(rows, {"dock_code": F.col("resolved_dock_code")}, exprs)


def recirculation_summary(tasks: DataFrame, start, end, chute: str | None = None) -> DataFrame:
    """Recirculated tasks for each chute and wave."""
    rows = in_months(tasks, start, end).filter(C.is_recirculated_dock())
    if chute is not None:
        rows = rows.filter(C.key_text(C.chute()) == chute.upper())
    return by_code(rows, {"chute_code": C.chute(), "wave_code": wave_or_none()}, {"recirculated": F.count("*").cast("long")})


def cleanable_waves(tasks: DataFrame) -> DataFrame:
    """Waves of any time with tasks that can be cleaned up; tasks without a wave don't count."""
    rows = tasks.filter(C.normalized_wave().isNotNull())
    return by_code(rows, {"wave_code": C.normalized_wave()}, measures() | {"cleanable": count_if(C.is_cleanable())}, remark=True).filter("cleanable > 0")


def feedback_totals(tasks: DataFrame, start, end) -> DataFrame:
    required = F.col("feedback_status") != V.NOT_REQUIRED
    return in_months(tasks, start, end).agg(count_if(required).alias("required"), count_if(F.col("feedback_status") == V.COMPLETED).alias("completed"))


def recognition_totals(logs: DataFrame, start, end) -> DataFrame:
    return logs.filter(C.in_range("scan_time", start, end)).agg(F.count("*").cast("long").alias("scans"), count_if(F.col("is_matched")).alias("matched"))


def wave_codes(tasks: DataFrame, start, end) -> DataFrame:
    """Waves in the range."""
    return by_code(in_months(tasks, start, end), {"wave_code": wave_or_none()}, {})


def wave_options(tasks: DataFrame, start, end) -> DataFrame:
    """Waves in the range with their newest remark."""
    return by_code(in_months(tasks, start, end), {"wave_code": wave_or_none()}, {}, remark=True)


def sync_rollup(batches: DataFrame) -> DataFrame:
    """One row over a run's batch metrics."""
    failed = count_if(F.col("status") == V.BATCH_FAILED)
    return batches.agg(
        F.count("*").cast("long").alias("tables"),
        failed.alias("failed"),
        *(F.sum(f"{n}_count").cast("long").alias(f"{n}_rows") for n in ("read", "insert", "update", "delete")),
        F.max("lag_minutes").alias("max_lag_minutes"),
        F.max("backlog_minutes").alias("max_backlog_minutes"),
        C.percent(failed, F.count("*")).alias("failure_percent"),
    )


def _thousandths(n: Column, d: Column) -> Column:
    """n / d with three decimals, halves up, of whole numbers; 0 where either isn't positive."""
    whole = F.call_function("div", n * 2000 + d, F.nullif(2 * d, F.lit(0)))
    return (F.coalesce(F.when((n > 0) & (d > 0), whole), F.lit(0)).cast("decimal(18,0)") / 1000).cast("decimal(18,3)")


def _micros(end: Column, start: str) -> Column:
    return F.unix_micros(end.cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))


def batch_metrics(batches: DataFrame, now) -> DataFrame:
    """Lag and backlog in minutes and rows a second of every batch; 0 where a batch has no rows or took no time."""
    rows = F.col("insert_count") + F.col("update_count") + F.col("delete_count")
    return batches.withColumns(
        {
            "lag_minutes": _thousandths(_micros(C.ntz(now), "window_end"), F.lit(60_000_000)),
            "backlog_minutes": _thousandths(_micros(C.ntz(now), "window_start"), F.lit(60_000_000)),
            "rows_per_second": _thousandths(rows * 1_000_000, _micros(F.col("completed_time"), "started_time")),
        }
    )


def expired_rows(df: DataFrame, time: str, threshold) -> DataFrame:
    return df.filter(F.col(time) < C.ntz(threshold)).agg(F.count("*").cast("long").alias("expired"))

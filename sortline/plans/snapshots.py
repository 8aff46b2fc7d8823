"""Minute snapshots of tasks and scans, their refresh, and aggregates that combine them with the tables they come from."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed as V
from ..operators import aggregates as A
from ..sources.tables import in_months

HORIZON = timedelta(hours=168)
OVERLAP = timedelta(seconds=30)
AHEAD = timedelta(minutes=5)
MINUTE = timedelta(minutes=1)

#: What tells apart the rows of one minute. The chute is among them so that recirculation by chute comes out as from the tasks.
KEYS = ("bucket", "wave_code", "wave_remark", "dock_code", "chute_code", "working_area", "source_type", "status")


def _at(t) -> datetime:
    return t if isinstance(t, datetime) else datetime.fromisoformat(str(t))


def task_snapshot(tasks: DataFrame) -> DataFrame:
    """Counts and sums of each minute of creation and its KEYS. The remark's newest time is kept so that the newest remark can be told."""
    rows = tasks.withColumns(
        {"bucket": C.minute("created_time"), "wave_code": C.normalized_wave(), "wave_remark": C.blank_to_null("wave_remark"), "dock_code": F.col("resolved_dock_code"), "chute_code": C.chute()}
    )
    return rows.groupBy(*KEYS).agg(
        F.count("*").cast("long").alias("total"),
        A.count_if(F.col("scanned_at").isNotNull()).alias("scanned"),
        A.count_if(C.is_recirculated_dock()).alias("recirculated"),
        A.count_if(C.is_exceptional()).alias("exceptions"),
        A.count_if(F.col("feedback_status") != V.NOT_REQUIRED).alias("feedback_required"),
        A.count_if(F.col("feedback_status") == V.COMPLETED).alias("feedback_completed"),
        F.coalesce(F.sum("volume_mm3"), F.lit(0)).cast("decimal(28,3)").alias("volume_mm3"),
        F.coalesce(F.sum("weight_gram"), F.lit(0)).cast("decimal(28,3)").alias("weight_gram"),
        F.min("created_time").alias("earliest_created"),
        F.max("updated_time").alias("last_updated"),
    )


def scan_snapshot(logs: DataFrame) -> DataFrame:
    """Scans and matches of each minute."""
    out = logs.groupBy(F.window("scan_time", "1 minute").alias("w")).agg(F.count("*").cast("long").alias("total"), A.count_if(F.col("is_matched")).alias("matched"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("bucket"), "total", "matched")


def current_wave_snapshot(tasks: DataFrame) -> DataFrame:
    """Of each minute of creation the task scanned last, by (scanned, updated, id), with what that order needs, so that minutes compare as tasks do."""
    rows = tasks.filter(F.col("scanned_at").isNotNull() & C.normalized_wave().isNotNull())
    shown = F.struct("scanned_at", "updated_time", "id", C.normalized_wave().alias("wave_code"), C.blank_to_null("wave_remark").alias("wave_remark"), "barcode")
    return rows.groupBy(C.minute("created_time").alias("bucket")).agg(F.max_by(shown, F.struct("scanned_at", "updated_time", "id")).alias("t")).select("bucket", "t.*")


def dirty_buckets(rows: DataFrame, last_refresh, coverage_start, time: str = "created_time", changed: str = "updated_time") -> DataFrame:
    """Minutes whose rows changed since the last refresh, less the overlap."""
    since = _at(last_refresh) - OVERLAP
    return rows.filter((F.col(changed) >= C.ntz(since)) & (F.col(time) >= C.ntz(coverage_start))).select(C.minute(time).alias("bucket")).distinct()


def bucket_ranges(buckets: DataFrame) -> DataFrame:
    """Runs of minutes as [start, end). Islands are told inside a day and put together over midnight, so no task sees all buckets."""
    day = Window.partitionBy(F.to_date("bucket")).orderBy("bucket")
    minute = F.floor(F.unix_micros(F.col("bucket").cast("timestamp")) / 60_000_000)
    islands = buckets.distinct().withColumn("m", minute).withColumn("island", F.col("m") - F.row_number().over(day)).groupBy(F.to_date("bucket").alias("day"), "island").agg(F.min("m").alias("first"), (F.max("m") + 1).alias("last"))
    every = Window.orderBy("first")  # a row for each island of a day
    new = F.when(F.lag("last").over(every) == F.col("first"), 0).otherwise(1)
    runs = islands.withColumn("new", new).withColumn("run", F.sum("new").over(every)).groupBy("run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    time = lambda c: F.timestamp_micros(F.col(c) * 60_000_000).cast("timestamp_ntz")
    return runs.select(time("first").alias("start"), time("last").alias("end"))


def needs_full_refresh(now, coverage: tuple | None) -> bool:
    """Without a coverage, or if it ends before the new one starts, starts late, or lies ahead of now."""
    if coverage is None:
        return True
    start, end = map(_at, coverage)
    want = _at(now) - HORIZON
    return start > want or end < want or end > _at(now) + AHEAD


@dataclass(frozen=True)
class Snapshot:
    rows: DataFrame
    coverage: tuple[datetime, datetime]


def _floor(t: datetime) -> datetime:
    return t.replace(second=0, microsecond=0)


def _ceil(t: datetime) -> datetime:
    return t if t == _floor(t) else _floor(t) + MINUTE


def refresh(tasks: DataFrame, old: Snapshot | None, now, last_refresh=None) -> Snapshot:
    """The snapshot after a refresh at `now`: full, or the dirty minutes made anew, with those that leave the horizon dropped. What it covers ends at the
    current minute's start."""
    start, end = _floor(_at(now) - HORIZON), _floor(_at(now))
    covered = in_months(tasks, start, end)
    if needs_full_refresh(now, old.coverage if old else None) or last_refresh is None:
        return Snapshot(task_snapshot(covered), (start, end))
    dirty = _dirty(covered, old.coverage, start, last_refresh)
    return Snapshot(_replaced(old.rows, covered, dirty, task_snapshot, (start, end)), (start, end))


def _dirty(covered: DataFrame, before: tuple, start, last_refresh, time: str = "created_time", changed: str = "updated_time", also: DataFrame | None = None) -> DataFrame:
    """Minutes to make anew: those with changes, those that the old snapshot didn't cover, and `also`. They lie in the horizon, so there are few."""
    fresh = covered.filter(F.col(time) >= C.ntz(before[1])).select(C.minute(time).alias("bucket"))
    minutes = dirty_buckets(covered, last_refresh, start, time, changed).unionByName(fresh)
    return (minutes if also is None else minutes.unionByName(also.filter(F.col("bucket") >= C.ntz(start)))).distinct()


def _replaced(old: DataFrame, covered: DataFrame, dirty: DataFrame, build, coverage: tuple, time: str = "created_time") -> DataFrame:
    """Snapshot rows of the coverage, with those of dirty minutes built anew. Dirty minutes are broadcast: the horizon has 10,080."""
    kept = old.filter(C.in_range("bucket", *coverage)).join(F.broadcast(dirty), "bucket", "left_anti")
    again = covered.withColumn("minute", C.minute(time)).join(F.broadcast(dirty.withColumnRenamed("bucket", "minute")), "minute", "left_semi").drop("minute")
    return kept.unionByName(build(again))


@dataclass(frozen=True)
class Snapshots:
    """The snapshots of tasks, current waves and scans, what they cover and when they were made."""

    tasks: DataFrame
    waves: DataFrame
    scans: DataFrame
    coverage: tuple[datetime, datetime]
    last_refresh: datetime


def refresh_all(tasks: DataFrame, logs: DataFrame, old: Snapshots | None, now, changed: DataFrame | None = None) -> Snapshots:
    """All three snapshots at `now`, as refresh() does it. changed: tasks (created_time) that are known to have changed, whatever their updated_time says. Scans count as
    changed from their created_time on, or their scan_time where they have none."""
    start, end = _floor(_at(now) - HORIZON), _floor(_at(now))
    covered, seen = in_months(tasks, start, end), logs.filter(C.in_range("scan_time", start, end))
    if old is None or needs_full_refresh(now, old.coverage):
        return Snapshots(task_snapshot(covered), current_wave_snapshot(covered), scan_snapshot(seen), (start, end), _at(now))
    also = None if changed is None else changed.filter(C.in_range("created_time", start, end)).select(C.minute("created_time").alias("bucket"))
    dirty = _dirty(covered, old.coverage, start, old.last_refresh, also=also)
    dirty_scans = _dirty(seen, old.coverage, start, old.last_refresh, "scan_time", "created_time" if "created_time" in logs.columns else "scan_time")
    return Snapshots(
        _replaced(old.tasks, covered, dirty, task_snapshot, (start, end)),
        _replaced(old.waves, covered, dirty, current_wave_snapshot, (start, end)),
        _replaced(old.scans, seen, dirty_scans, scan_snapshot, (start, end), "scan_time"),
        (start, end),
        _at(now),
    )


def split_range(start, end, coverage: tuple | None) -> tuple[tuple[datetime, datetime], list[tuple[datetime, datetime]]] | None:
    """(whole minutes that the snapshot covers, what is left of [start, end) at its edges), or None where it covers none."""
    start, end = _at(start), _at(end)
    if coverage is None or end <= start:
        return None
    first, last = max(_ceil(start), _ceil(_at(coverage[0]))), min(_floor(end), _floor(_at(coverage[1])))
    if first >= last:
        return None
    edges = [(a, b) for a, b in ((start, first), (last, end)) if a < b]
    return (first, last), edges


def hybrid_rows(tasks: DataFrame, snapshot: Snapshot | None, start, end, build=task_snapshot, pick=in_months) -> DataFrame:
    """Rows in the shape of the snapshot for [start, end): its whole minutes, and the edges from the tasks (or what else `build` makes the snapshot of and `pick` takes a range
    of); all from the tasks if it covers nothing."""
    plan = split_range(start, end, snapshot.coverage if snapshot else None)
    if plan is None:
        return build(pick(tasks, start, end))
    core, edges = plan
    rows = snapshot.rows.filter(C.in_range("bucket", *core))
    for edge in edges:
        rows = rows.unionByName(build(pick(tasks, *edge)))
    return rows


def hybrid_wave_dashboard(tasks: DataFrame, snapshot: Snapshot | None, start, end) -> DataFrame:
    """As aggregates.wave_dashboard()."""
    wave = F.coalesce("wave_code", F.lit(V.NO_WAVE))
    full, split, unsorted = F.col("source_type") == V.FULL_CASE, F.col("source_type") == V.SPLIT, ~C.is_sorted()
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("total"))), F.lit(0)).cast("long")
    whole = lambda c: F.sum(c).cast("long").alias(c)
    out = hybrid_rows(tasks, snapshot, start, end).groupBy(C.key_text(wave).alias("k")).agg(
        F.min(wave).alias("wave_code"),
        whole("total"),
        total(unsorted).alias("unsorted"),
        total(full).alias("full_case_total"),
        total(full & unsorted).alias("full_case_unsorted"),
        total(split).alias("split_total"),
        total(split & unsorted).alias("split_unsorted"),
        F.sum("scanned").cast("long").alias("recognised"),
        whole("recirculated"),
        whole("exceptions"),
        *(F.sum(c).cast("decimal(28,3)").alias(c) for c in ("volume_mm3", "weight_gram")),
        F.min("earliest_created").alias("earliest_created"),
    )
    return out.drop("k")


def hybrid_recirculation(tasks: DataFrame, snapshot: Snapshot | None, start, end) -> DataFrame:
    """As aggregates.recirculation_summary()."""
    wave = F.coalesce("wave_code", F.lit(V.NO_WAVE))
    rows = hybrid_rows(tasks, snapshot, start, end).filter("recirculated > 0")
    out = rows.groupBy(C.key_text("chute_code").alias("ck"), C.key_text(wave).alias("wk")).agg(F.min("chute_code").alias("chute_code"), F.min(wave).alias("wave_code"), F.sum("recirculated").cast("long").alias("recirculated"))
    return out.drop("ck", "wk")


def hybrid_feedback(tasks: DataFrame, snapshot: Snapshot | None, start, end) -> DataFrame:
    """As aggregates.feedback_totals()."""
    sums: list[Column] = [F.coalesce(F.sum(f"feedback_{n}"), F.lit(0)).cast("long").alias(n) for n in ("required", "completed")]
    return hybrid_rows(tasks, snapshot, start, end).agg(*sums)


def _sum_where(c: Column) -> Column:
    return F.coalesce(F.sum(F.when(c, F.col("total"))), F.lit(0)).cast("long")


def hybrid_dock_dashboard(tasks: DataFrame, snapshot: Snapshot | None, start, end, wave: str | None = None, dock: str | None = None) -> DataFrame:
    """As aggregates.dock_dashboard()."""
    rows = hybrid_rows(tasks, snapshot, start, end)
    if wave is not None:
        rows = rows.filter(C.key_text(F.coalesce("wave_code", F.lit(V.NO_WAVE))) == wave.upper())
    if dock is not None:
        rows = rows.filter(C.key_text("dock_code") == dock.upper())
    full, split, done = F.col("source_type") == V.FULL_CASE, F.col("source_type") == V.SPLIT, C.is_sorted()
    exprs = {
        "total": F.sum("total").cast("long"),
        "sorted": _sum_where(done),
        "split_total": _sum_where(split),
        "split_unsorted": _sum_where(split & ~done),
        "split_sorted": _sum_where(split & done),
        "full_case_total": _sum_where(full),
        "full_case_unsorted": _sum_where(full & ~done),
        "full_case_sorted": _sum_where(full & done),
        "recirculated": F.sum("recirculated").cast("long"),
        "exceptions": F.sum("exceptions").cast("long"),
    }
    out = rows.groupBy(C.key_text("dock_code").alias("k")).agg(F.min("dock_code").alias("shown"), *(c.alias(n) for n, c in exprs.items()))
    return out.select(F.col("shown").alias("dock_code"), *exprs)


def hybrid_recognition(logs: DataFrame, snapshot: Snapshot | None, start, end) -> DataFrame:
    """As aggregates.recognition_totals(). snapshot: of scans."""
    rows = hybrid_rows(logs, snapshot, start, end, scan_snapshot, lambda df, a, b: df.filter(C.in_range("scan_time", a, b)))
    return rows.agg(F.coalesce(F.sum("total"), F.lit(0)).cast("long").alias("scans"), F.coalesce(F.sum("matched"), F.lit(0)).cast("long").alias("matched"))


def hybrid_current_wave(tasks: DataFrame, snapshot: Snapshot | None, start, end) -> DataFrame:
    """As views.current_wave(). snapshot: of current waves."""
    rows = hybrid_rows(tasks, snapshot, start, end, current_wave_snapshot)
    return rows.drop("bucket").orderBy(F.desc("scanned_at"), F.desc("updated_time"), F.desc("id")).limit(1)


def hybrid_wave_codes(tasks: DataFrame, snapshot: Snapshot | None, start, end) -> DataFrame:
    """As aggregates.wave_codes()."""
    return hybrid_wave_options(tasks, snapshot, start, end).select("wave_code")


def hybrid_wave_options(tasks: DataFrame, snapshot: Snapshot | None, start, end) -> DataFrame:
    """As aggregates.wave_options()."""
    wave = F.coalesce("wave_code", F.lit(V.NO_WAVE))
    newest = F.max_by("wave_remark", F.when(F.col("wave_remark").isNotNull(), F.struct("last_updated", "wave_remark")))
    rows = hybrid_rows(tasks, snapshot, start, end).groupBy(C.key_text(wave).alias("k")).agg(F.min(wave).alias("wave_code"), newest.alias("wave_remark"))
    return rows.drop("k")

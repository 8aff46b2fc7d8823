"""Queries of snapshots."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans import snapshots as P
from ..sources import fixtures as X
from ..sources.tables import in_months
from .aggregates import DOCKS, MEASURES, REMARK
from .registry import CHUTE, END, EXCEPTIONAL, IN_RANGE, IN_SCANS, RECIRCULATED, SCAN_END, SCAN_START, START, WAVE, query

SNAPSHOT = f"""snapshot AS (SELECT date_trunc('minute', created_time) AS bucket, normalized_wave_code AS wave_code, wave_remark, resolved_dock_code AS dock_code, {CHUTE} AS chute_code, working_area, source_type, status,
  count(*) AS total, count(scanned_at) AS scanned, count(*) FILTER ({RECIRCULATED}) AS recirculated, count(*) FILTER ({EXCEPTIONAL}) AS exceptions, count(*) FILTER (feedback_status <> 0) AS feedback_required,
  count(*) FILTER (feedback_status = 2) AS feedback_completed, CAST(coalesce(sum(volume_mm3), 0) AS DECIMAL(28,3)) AS volume_mm3, CAST(coalesce(sum(weight_gram), 0) AS DECIMAL(28,3)) AS weight_gram,
  min(created_time) AS earliest_created, max(updated_time) AS last_updated FROM tasks GROUP BY ALL)"""
#: The snapshot covers a middle part of the range.
COVERED = (datetime(1997, 3, 1, 10, 20), datetime(1997, 9, 30, 20, 10))


def _covering(spark, d):
    return P.Snapshot(P.task_snapshot(in_months(X.tasks(spark, d), *COVERED)), COVERED)


@query("SELECT * FROM snapshot", (X.TASKS, SNAPSHOT))
def task_snapshot(spark, d):
    return P.task_snapshot(X.tasks(spark, d))


@query("SELECT date_trunc('minute', scan_time) AS bucket, count(*) AS total, count(*) FILTER (is_matched) AS matched FROM scan_logs GROUP BY 1", (X.SCAN_LOGS,))
def scan_snapshot(spark, d):
    return P.scan_snapshot(X.scan_logs(spark, d))


@query("SELECT date_trunc('minute', created_time) AS bucket, scanned_at, updated_time, id, normalized_wave_code AS wave_code, wave_remark, barcode FROM tasks WHERE scanned_at IS NOT NULL AND normalized_wave_code IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date_trunc('minute', created_time) ORDER BY scanned_at DESC, updated_time DESC, id DESC) = 1")
def current_wave_snapshot(spark, d):
    return P.current_wave_snapshot(X.tasks(spark, d))


@query(f"SELECT min({WAVE}) AS wave_code, {MEASURES} FROM tasks WHERE {IN_RANGE} GROUP BY upper({WAVE})")
def hybrid_wave_dashboard(spark, d):
    return P.hybrid_wave_dashboard(X.tasks(spark, d), _covering(spark, d), START, END)


@query(f"SELECT min({CHUTE}) AS chute_code, min({WAVE}) AS wave_code, count(*) AS recirculated FROM tasks WHERE {IN_RANGE} AND {RECIRCULATED} GROUP BY upper({CHUTE}), upper({WAVE})")
def hybrid_recirculation(spark, d):
    return P.hybrid_recirculation(X.tasks(spark, d), _covering(spark, d), START, END)


@query(f"SELECT count(*) FILTER (feedback_status <> 0) AS required, count(*) FILTER (feedback_status = 2) AS completed FROM tasks WHERE {IN_RANGE}")
def hybrid_feedback(spark, d):
    return P.hybrid_feedback(X.tasks(spark, d), _covering(spark, d), START, END)


@query(f"SELECT min(resolved_dock_code) AS dock_code, {DOCKS} FROM tasks WHERE {IN_RANGE} GROUP BY upper(resolved_dock_code)")
def hybrid_dock_dashboard(spark, d):
    return P.hybrid_dock_dashboard(X.tasks(spark, d), _covering(spark, d), START, END)


@query(f"SELECT min(resolved_dock_code) AS dock_code, {DOCKS} FROM tasks WHERE {IN_RANGE} AND upper({WAVE}) = 'W7' GROUP BY upper(resolved_dock_code)")
def hybrid_dock_dashboard_of_wave(spark, d):
    return P.hybrid_dock_dashboard(X.tasks(spark, d), _covering(spark, d), START, END, wave="w7")


SEEN = (datetime(2024, 1, 7, 1, 2), datetime(2024, 1, 18, 22, 3))


@query(f"SELECT count(*) AS scans, count(*) FILTER (is_matched) AS matched FROM scan_logs WHERE {IN_SCANS}", (X.SCAN_LOGS,))
def hybrid_recognition(spark, d):
    logs = X.scan_logs(spark, d)
    return P.hybrid_recognition(logs, P.Snapshot(P.scan_snapshot(logs.filter(C.in_range("scan_time", *SEEN))), SEEN), SCAN_START, SCAN_END)


@query(f"SELECT scanned_at, updated_time, id, normalized_wave_code AS wave_code, wave_remark, barcode FROM tasks WHERE {IN_RANGE} AND scanned_at IS NOT NULL AND normalized_wave_code IS NOT NULL ORDER BY scanned_at DESC, updated_time DESC, id DESC LIMIT 1")
def hybrid_current_wave(spark, d):
    rows = X.tasks(spark, d)
    return P.hybrid_current_wave(rows, P.Snapshot(P.current_wave_snapshot(in_months(rows, *COVERED)), COVERED), START, END)


@query(f"SELECT min({WAVE}) AS wave_code FROM tasks WHERE {IN_RANGE} GROUP BY upper({WAVE})")
def hybrid_wave_codes(spark, d):
    return P.hybrid_wave_codes(X.tasks(spark, d), _covering(spark, d), START, END)


@query(f"SELECT min({WAVE}) AS wave_code, {REMARK} AS wave_remark FROM tasks WHERE {IN_RANGE} GROUP BY upper({WAVE})")
def hybrid_wave_options(spark, d):
    return P.hybrid_wave_options(X.tasks(spark, d), _covering(spark, d), START, END)


@query("SELECT DISTINCT date_trunc('minute', created_time) AS bucket FROM tasks WHERE updated_time >= TIMESTAMP '1997-11-30 23:59:30' AND created_time >= TIMESTAMP '1997-10-01'")
def dirty_buckets(spark, d):
    return P.dirty_buckets(X.tasks(spark, d), "1997-12-01 00:00:00", "1997-10-01 00:00:00")


@query(
    """SELECT min(bucket) AS start, max(bucket) + INTERVAL 1 MINUTE AS "end" FROM (SELECT bucket, epoch(bucket) // 60 - row_number() OVER (ORDER BY bucket) AS island FROM (SELECT DISTINCT date_trunc('minute', scan_time) AS bucket FROM scan_logs)) GROUP BY island""",
    (X.SCAN_LOGS,),
)
def bucket_ranges(spark, d):
    return P.bucket_ranges(P.scan_snapshot(X.scan_logs(spark, d)).select("bucket"))


@query("SELECT * FROM snapshot WHERE bucket >= TIMESTAMP '1997-06-02 12:30:00' AND bucket < TIMESTAMP '1997-06-09 12:30:00'", (X.TASKS, SNAPSHOT))
def snapshot_refreshed(spark, d):
    """A snapshot of an hour before, brought up to date by its dirty minutes."""
    rows = X.tasks(spark, d)
    now, before = datetime(1997, 6, 9, 12, 30), datetime(1997, 6, 2, 6, 30)
    stale = rows.filter(F.col("updated_time") < C.ntz("1997-06-08 00:00:00"))
    old = P.Snapshot(P.task_snapshot(in_months(stale, before, datetime(1997, 6, 9, 6, 30))), (before, datetime(1997, 6, 9, 6, 30)))
    return P.refresh(rows, old, now, last_refresh=datetime(1997, 6, 8)).rows


AT, BEFORE = datetime(1997, 6, 9, 12, 30), datetime(1997, 6, 9, 6, 30)


def _all_refreshed(spark, d):
    """All three snapshots, brought up to date after six hours. Scans are those of the tasks, at the time that each was scanned."""
    rows = X.tasks(spark, d)
    logs = rows.filter("scanned_at IS NOT NULL").select(F.col("scanned_at").alias("scan_time"), (F.col("scan_retry_count") < 4).alias("is_matched"), F.col("updated_time").alias("created_time"))
    known, seen = (df.filter(F.col(c) < C.ntz(BEFORE)) for df, c in ((rows, "updated_time"), (logs, "created_time")))
    return P.refresh_all(rows, logs, P.refresh_all(known, seen, None, BEFORE), AT)


IN_HORIZON = "bucket >= TIMESTAMP '1997-06-02 12:30:00' AND bucket < TIMESTAMP '1997-06-09 12:30:00'"


@query(
    f"SELECT * FROM (SELECT date_trunc('minute', scanned_at) AS bucket, count(*) AS total, count(*) FILTER (scan_retry_count < 4) AS matched FROM tasks WHERE scanned_at IS NOT NULL GROUP BY 1) WHERE {IN_HORIZON}"
)
def scan_snapshot_refreshed(spark, d):
    return _all_refreshed(spark, d).scans


@query(
    f"SELECT * FROM (SELECT date_trunc('minute', created_time) AS bucket, scanned_at, updated_time, id, normalized_wave_code AS wave_code, wave_remark, barcode FROM tasks WHERE scanned_at IS NOT NULL AND normalized_wave_code IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date_trunc('minute', created_time) ORDER BY scanned_at DESC, updated_time DESC, id DESC) = 1) WHERE {IN_HORIZON}"
)
def current_wave_refreshed(spark, d):
    return _all_refreshed(spark, d).waves

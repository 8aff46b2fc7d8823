"""Queries of the aggregates."""

from __future__ import annotations

from ..operators import aggregates as A
from ..sources import fixtures as X
from .registry import CHUTE, END, EXCEPTIONAL, IN_RANGE, IN_SCANS, NOW, RECIRCULATED, SCAN_END, SCAN_START, SORTED, START, WAVE, percent, query

MEASURES = f"""count(*) AS total, count(*) FILTER (NOT {SORTED}) AS unsorted,
  count(*) FILTER (source_type = 2) AS full_case_total, count(*) FILTER (source_type = 2 AND NOT {SORTED}) AS full_case_unsorted,
  count(*) FILTER (source_type = 1) AS split_total, count(*) FILTER (source_type = 1 AND NOT {SORTED}) AS split_unsorted,
  count(*) FILTER (scanned_at IS NOT NULL) AS recognised, count(*) FILTER ({RECIRCULATED}) AS recirculated, count(*) FILTER ({EXCEPTIONAL}) AS exceptions,
  CAST(coalesce(sum(volume_mm3), 0) AS DECIMAL(28,3)) AS volume_mm3, CAST(coalesce(sum(weight_gram), 0) AS DECIMAL(28,3)) AS weight_gram, min(created_time) AS earliest_created"""
DOCKS = f"""count(*) AS total, count(*) FILTER ({SORTED}) AS sorted,
  count(*) FILTER (source_type = 1) AS split_total, count(*) FILTER (source_type = 1 AND NOT {SORTED}) AS split_unsorted, count(*) FILTER (source_type = 1 AND {SORTED}) AS split_sorted,
  count(*) FILTER (source_type = 2) AS full_case_total, count(*) FILTER (source_type = 2 AND NOT {SORTED}) AS full_case_unsorted, count(*) FILTER (source_type = 2 AND {SORTED}) AS full_case_sorted,
  count(*) FILTER ({RECIRCULATED}) AS recirculated, count(*) FILTER ({EXCEPTIONAL}) AS exceptions"""
REMARK = "arg_max(wave_remark, (updated_time, wave_remark)) FILTER (wave_remark IS NOT NULL)"


@query(f"SELECT min({WAVE}) AS wave_code, {MEASURES} FROM tasks WHERE {IN_RANGE} GROUP BY upper({WAVE})")
def wave_dashboard(spark, d):
    return A.wave_dashboard(X.tasks(spark, d), START, END)


@query(f"SELECT min(resolved_dock_code) AS dock_code, {DOCKS} FROM tasks WHERE {IN_RANGE} GROUP BY upper(resolved_dock_code)")
def dock_dashboard(spark, d):
    return A.dock_dashboard(X.tasks(spark, d), START, END)


@query(f"SELECT min(resolved_dock_code) AS dock_code, {DOCKS} FROM tasks WHERE {IN_RANGE} AND upper({WAVE}) = 'W7' AND resolved_dock_code = '7' GROUP BY upper(resolved_dock_code)")
def dock_dashboard_of_wave(spark, d):
    return A.dock_dashboard(X.tasks(spark, d), START, END, wave="w7", dock="7")


@query(f"SELECT min({CHUTE}) AS chute_code, min({WAVE}) AS wave_code, count(*) AS recirculated FROM tasks WHERE {IN_RANGE} AND {RECIRCULATED} GROUP BY upper({CHUTE}), upper({WAVE})")
def recirculation_summary(spark, d):
    return A.recirculation_summary(X.tasks(spark, d), START, END)


@query(f"SELECT min(normalized_wave_code) AS wave_code, {MEASURES}, count(*) FILTER (status NOT IN (3, 5)) AS cleanable, {REMARK} AS wave_remark FROM tasks WHERE normalized_wave_code IS NOT NULL GROUP BY upper(normalized_wave_code) HAVING count(*) FILTER (status NOT IN (3, 5)) > 0")
def cleanable_waves(spark, d):
    return A.cleanable_waves(X.tasks(spark, d))


@query(f"SELECT count(*) FILTER (feedback_status <> 0) AS required, count(*) FILTER (feedback_status = 2) AS completed FROM tasks WHERE {IN_RANGE}")
def feedback_totals(spark, d):
    return A.feedback_totals(X.tasks(spark, d), START, END)


@query(f"SELECT count(*) AS scans, count(*) FILTER (is_matched) AS matched FROM scan_logs WHERE {IN_SCANS}", (X.SCAN_LOGS,))
def recognition_totals(spark, d):
    return A.recognition_totals(X.scan_logs(spark, d), SCAN_START, SCAN_END)


@query(f"SELECT min({WAVE}) AS wave_code FROM tasks WHERE {IN_RANGE} GROUP BY upper({WAVE})")
def wave_codes(spark, d):
    return A.wave_codes(X.tasks(spark, d), START, END)


@query(f"SELECT min({WAVE}) AS wave_code, {REMARK} AS wave_remark FROM tasks WHERE {IN_RANGE} GROUP BY upper({WAVE})")
def wave_options(spark, d):
    return A.wave_options(X.tasks(spark, d), START, END)


def _minutes(c: str) -> str:
    return f"CAST(CAST(greatest((epoch_us(TIMESTAMP '{NOW}') - epoch_us({c}) + 30000) // 60000, 0) AS DOUBLE) / 1000 AS DECIMAL(18,3))"


METRICS = f"""metrics AS (
  SELECT *, {_minutes("window_end")} AS lag_minutes, {_minutes("window_start")} AS backlog_minutes,
    CAST(CASE WHEN epoch_us(completed_time) > epoch_us(started_time) THEN CAST(((insert_count + update_count + delete_count) * 2000000000 + epoch_us(completed_time) - epoch_us(started_time)) // (2 * (epoch_us(completed_time) - epoch_us(started_time))) AS DOUBLE) / 1000 ELSE 0 END AS DECIMAL(18,3)) AS rows_per_second
  FROM sync_batches)"""


@query("SELECT batch_id, lag_minutes, backlog_minutes, rows_per_second FROM metrics", (X.SYNC_BATCHES, METRICS))
def batch_metrics(spark, d):
    return A.batch_metrics(X.sync_batches(spark, d), NOW).select("batch_id", "lag_minutes", "backlog_minutes", "rows_per_second")


@query(
    f"SELECT count(*) AS tables, count(*) FILTER (status = 4) AS failed, CAST(sum(read_count) AS BIGINT) AS read_rows, CAST(sum(insert_count) AS BIGINT) AS insert_rows, CAST(sum(update_count) AS BIGINT) AS update_rows, CAST(sum(delete_count) AS BIGINT) AS delete_rows, max(lag_minutes) AS max_lag_minutes, max(backlog_minutes) AS max_backlog_minutes, {percent('count(*) FILTER (status = 4)', 'count(*)')} AS failure_percent FROM metrics",
    (X.SYNC_BATCHES, METRICS),
)
def sync_rollup(spark, d):
    return A.sync_rollup(A.batch_metrics(X.sync_batches(spark, d), NOW))


@query("SELECT count(*) AS expired FROM tasks WHERE created_time < TIMESTAMP '1997-06-01 00:00:00'")
def expired_rows(spark, d):
    return A.expired_rows(X.tasks(spark, d), "created_time", "1997-06-01 00:00:00")

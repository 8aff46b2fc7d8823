"""Queries of the dashboards and reports."""

from __future__ import annotations

from ..functions import fixed as V
from ..operators import search as S
from ..operators import views as W
from ..sources import fixtures as X
from .aggregates import DOCKS, MEASURES, REMARK
from . import search  # noqa: F401  box tracking is told by its SQL
from .registry import CHUTE, END, EXCEPTIONAL, IN_RANGE, RECIRCULATED, SORTED, SQL, START, WAVE, percent, query

ALL = (X.TASKS, X.SCAN_LOGS, X.SYNC_BATCHES, X.SYNC_DEFINITIONS)
OF_WAVE = f"{IN_RANGE} AND upper({WAVE}) = 'W7'"
AREA = "upper(regexp_replace(coalesce(working_area, ''), '[^\\p{L}\\p{Nd}]', '', 'g'))"
ZONE = f"CASE WHEN source_type = 2 THEN 'FullCase' ELSE CASE " + " ".join(f"WHEN {AREA} IN ({', '.join(repr(a) for a in areas)}) THEN '{code}'" for code, _, areas in V.ZONES if areas) + " END END"
STATUS = "CASE WHEN exceptions > 0 THEN '异常待处理' WHEN unsorted > 0 THEN '分拣中' ELSE '已完成' END"
SHOWN = "CASE WHEN TRY_CAST(dock_code AS INTEGER) = 7 THEN exceptions ELSE 0 END"
CURRENT = f"current_wave AS (SELECT scanned_at, updated_time, id, normalized_wave_code AS wave_code, wave_remark, barcode FROM tasks WHERE {IN_RANGE} AND scanned_at IS NOT NULL AND normalized_wave_code IS NOT NULL ORDER BY scanned_at DESC, updated_time DESC, id DESC LIMIT 1)"
DOCK_ROWS = f"docks AS (SELECT min(resolved_dock_code) AS dock_code, {DOCKS} FROM tasks WHERE {IN_RANGE} GROUP BY upper(resolved_dock_code))"
WAVES = f"waves AS (SELECT min({WAVE}) AS wave_code, {MEASURES}, {REMARK} AS wave_remark FROM tasks WHERE {IN_RANGE} GROUP BY upper({WAVE}))"
LATEST = "latest AS (SELECT * FROM sync_batches QUALIFY row_number() OVER (PARTITION BY table_code ORDER BY coalesce(completed_time, started_time, window_end) DESC, batch_id DESC) = 1)"


@query(
    f"""SELECT t.total, t.unsorted, full_case_total, full_case_unsorted, split_total, split_unsorted, recognised, recirculated, exceptions, volume_mm3, weight_gram,
  {percent('t.total - t.unsorted', 't.total')} AS progress_percent, {percent('full_case_total - full_case_unsorted', 'full_case_total')} AS full_case_progress_percent,
  {percent('split_total - split_unsorted', 'split_total')} AS split_progress_percent, {percent('matched', 'scans')} AS recognition_percent, latest_sync,
  {percent('done', 'wanted')} AS download_percent, {percent('completed', 'required')} AS writeback_percent
FROM (SELECT {MEASURES}, count(*) FILTER (feedback_status <> 0) AS required, count(*) FILTER (feedback_status = 2) AS completed FROM tasks WHERE {IN_RANGE}) t,
  (SELECT count(*) AS scans, count(*) FILTER (is_matched) AS matched FROM scan_logs WHERE scan_time >= TIMESTAMP '{START}' AND scan_time < TIMESTAMP '{END}') s,
  (SELECT max(coalesce(completed_time, started_time, window_end)) AS latest_sync, count(*) FILTER (status = 3) AS done FROM latest) b, (SELECT count(*) AS wanted FROM sync_definitions) w""",
    (*ALL, LATEST),
)
def global_dashboard(spark, d):
    return W.global_dashboard(X.tasks(spark, d), X.scan_logs(spark, d), X.sync_batches(spark, d), X.sync_definitions(spark, d), START, END)


@query(f"SELECT wave_code, total, unsorted, {percent('total - unsorted', 'total')} AS progress_percent FROM waves", (X.TASKS, WAVES))
def global_wave_list(spark, d):
    return W.global_wave_list(X.tasks(spark, d), START, END)


@query(f"SELECT wave_code, total, unsorted, recirculated, exceptions, wave_remark, {percent('total - unsorted', 'total')} AS progress_percent FROM waves WHERE upper(wave_code) = 'W7'", (X.TASKS, WAVES))
def wave_summary(spark, d):
    return W.wave_summary(X.tasks(spark, d), START, END, "W7")


@query(
    f"""SELECT zone_order, zone_code, zone_name, coalesce(total, 0) AS total, coalesce(unsorted, 0) AS unsorted, coalesce(recirculated, 0) AS recirculated,
  coalesce(exceptions, 0) AS exceptions, {percent('coalesce(total, 0) - coalesce(unsorted, 0)', 'coalesce(total, 0)')} AS progress_percent
FROM (VALUES {', '.join(f"({k + 1}, '{c}', '{n}')" for k, (c, n, _) in enumerate(V.ZONES))}) z(zone_order, zone_code, zone_name)
LEFT JOIN (SELECT {ZONE} AS zone_code, count(*) AS total, count(*) FILTER (NOT {SORTED}) AS unsorted, count(*) FILTER ({RECIRCULATED}) AS recirculated, count(*) FILTER ({EXCEPTIONAL}) AS exceptions
  FROM tasks WHERE {OF_WAVE} GROUP BY 1) USING (zone_code)"""
)
def wave_zones(spark, d):
    return W.wave_zones(X.tasks(spark, d), START, END, "w7")


@query(f"SELECT wave_code, total, unsorted, full_case_total, full_case_unsorted, split_total, split_unsorted, recirculated, exceptions, earliest_created, wave_remark, {STATUS} AS wave_status FROM waves", (X.TASKS, WAVES))
def wave_list(spark, d):
    return W.wave_list(X.tasks(spark, d), START, END)


@query(
    f"""SELECT dock_code, total, sorted, split_total, split_unsorted, split_sorted, full_case_total, full_case_unsorted, full_case_sorted, recirculated, {SHOWN} AS exceptions, {percent('sorted', 'total')} AS progress_percent
FROM (SELECT min(resolved_dock_code) AS dock_code, {DOCKS} FROM tasks WHERE {IN_RANGE} AND upper({WAVE}) IN (SELECT upper(wave_code) FROM current_wave) GROUP BY upper(resolved_dock_code))""",
    (X.TASKS, CURRENT),
)
def dock_view_of_current_wave(spark, d):
    return W.dock_view(X.tasks(spark, d), START, END)


@query(f"SELECT dock_code, split_total, full_case_total, split_sorted, full_case_sorted, recirculated, {SHOWN} AS exceptions FROM docks", (X.TASKS, DOCK_ROWS))
def sorting_report(spark, d):
    return W.sorting_report(X.tasks(spark, d), START, END)


@query(f"SELECT min({CHUTE}) AS chute_code, min({WAVE}) AS wave_code, count(*) AS recirculated FROM tasks WHERE {IN_RANGE} AND {RECIRCULATED} GROUP BY upper({CHUTE}), upper({WAVE}) ORDER BY 3 DESC, 1, 2 LIMIT 25")
def recirculation_top(spark, d):
    return W.recirculation_view(X.tasks(spark, d), START, END, limit=25)


@query(f"SELECT min({CHUTE}) AS chute_code, min({WAVE}) AS wave_code, count(*) AS recirculated FROM tasks WHERE {IN_RANGE} AND {RECIRCULATED} GROUP BY upper({CHUTE}), upper({WAVE}) ORDER BY 3, 1, 2 LIMIT 25")
def recirculation_least(spark, d):
    return W.recirculation_view(X.tasks(spark, d), START, END, most_first=False, limit=25)


@query(
    f"""SELECT count(*) AS total, count(*) FILTER (NOT {SORTED}) AS unsorted, count(*) FILTER (source_type = 1) AS split_total, count(*) FILTER (source_type = 2) AS full_case_total,
  count(*) FILTER ({EXCEPTIONAL}) AS exceptions, min(created_time) AS earliest_created, count(*) FILTER (is_recirculated OR {RECIRCULATED}) AS recirculated,
  count(*) FILTER (status NOT IN (3, 5)) AS cleanable, {REMARK} AS wave_remark FROM tasks WHERE upper(normalized_wave_code) = 'W7' HAVING count(*) > 0"""
)
def cleanup_preview(spark, d):
    return W.cleanup_preview(X.tasks(spark, d), "W7")


@query("SELECT * FROM current_wave", (X.TASKS, CURRENT))
def current_wave(spark, d):
    return W.current_wave(X.tasks(spark, d), START, END)


DETAILS = f"""details AS (SELECT task_code, {WAVE} AS wave_code, wave_remark, CASE source_type WHEN 1 THEN '拆零' WHEN 2 THEN '整件' ELSE '未知来源' END AS source_text, working_area, barcode,
  order_id, store_id, store_name, product_code, pick_location, {CHUTE} AS chute_code,
  CASE status WHEN 1 THEN '已创建' WHEN 2 THEN '已扫描' WHEN 3 THEN '已落格' WHEN 4 THEN '待回传' WHEN 5 THEN '异常' ELSE '未知状态' END AS status_text,
  is_recirculated OR {RECIRCULATED} AS is_recirculated, {EXCEPTIONAL} AS is_exception, scanned_at, created_time, updated_time, id FROM tasks WHERE {OF_WAVE})"""


@query("SELECT * FROM details", (X.TASKS, DETAILS))
def wave_details(spark, d):
    return W.wave_details(X.tasks(spark, d), START, END, "W7")


@query("SELECT table_code, batch_id, status, started_time, completed_time FROM latest", (X.SYNC_BATCHES, LATEST))
def latest_batches(spark, d):
    return W.latest_batches(X.sync_batches(spark, d)).select("table_code", "batch_id", "status", "started_time", "completed_time")


@query("SELECT table_code, batch_id FROM sync_batches WHERE status = 4 QUALIFY row_number() OVER (PARTITION BY table_code ORDER BY completed_time DESC NULLS LAST, batch_id DESC) = 1", (X.SYNC_BATCHES,))
def latest_failed_batch(spark, d):
    return W.latest_failed_batch(X.sync_batches(spark, d))


def _time(c: str) -> str:
    return f"coalesce(strftime({c}, '%Y-%m-%d %H:%M:%S'), '')"


def _text(c: str) -> str:
    return f"coalesce(CAST({c} AS VARCHAR), '')"


def _flag(c: str) -> str:
    return f"CASE WHEN {c} THEN '是' ELSE '否' END"


def _csv(columns, headers) -> str:
    how = {"earliest_created": _time, "scanned_at": _time, "created_time": _time, "updated_time": _time, "is_recirculated": _flag, "is_exception": _flag}
    return ", ".join(f'{how.get(c, _text)(c)} AS "{h}"' for c, h in zip(columns, headers))


@query(f"SELECT {_csv(W.WAVE_LIST_COLUMNS, V.WAVE_LIST_HEADERS)} FROM (SELECT *, {STATUS} AS wave_status FROM waves)", (X.TASKS, WAVES))
def csv_wave_list(spark, d):
    return W.report(W.wave_list(X.tasks(spark, d), START, END), W.WAVE_LIST_COLUMNS, V.WAVE_LIST_HEADERS)


@query(f"SELECT {_csv(W.SORTING_COLUMNS, V.SORTING_HEADERS)} FROM (SELECT * REPLACE ({SHOWN} AS exceptions) FROM docks)", (X.TASKS, DOCK_ROWS))
def csv_sorting_report(spark, d):
    return W.report(W.sorting_report(X.tasks(spark, d), START, END), W.SORTING_COLUMNS, V.SORTING_HEADERS)


@query(f"SELECT {_csv(W.DETAIL_COLUMNS, V.DETAIL_HEADERS)} FROM details", (X.TASKS, DETAILS))
def csv_wave_details(spark, d):
    return W.report(W.wave_details(X.tasks(spark, d), START, END, "W7"), W.DETAIL_COLUMNS, V.DETAIL_HEADERS)


@query(f"SELECT {_csv(W.RECIRCULATION_COLUMNS, V.RECIRCULATION_HEADERS)} FROM (SELECT min({CHUTE}) AS chute_code, min({WAVE}) AS wave_code, count(*) AS recirculated FROM tasks WHERE {IN_RANGE} AND {RECIRCULATED} GROUP BY upper({CHUTE}), upper({WAVE}))")
def csv_recirculation(spark, d):
    return W.report(W.recirculation_view(X.tasks(spark, d), START, END), W.RECIRCULATION_COLUMNS, V.RECIRCULATION_HEADERS)


def _number(c: str) -> str:
    return f"regexp_replace(CAST(CAST(round({c}, 2) AS DECIMAL(28,2)) AS VARCHAR), '\\.?0+$', '')"


NUMBERS = ("progress_percent", "full_case_progress_percent", "split_progress_percent", "recognition_percent", "download_percent", "writeback_percent", "volume_mm3", "weight_gram")


def _shown(c: str) -> str:
    return f"coalesce({_number(c)}, '')" if c in NUMBERS else _time(c) if c in ("latest_sync", "scan_time") else _text(c)


def _of(name: str, columns, headers) -> str:
    return f"SELECT {', '.join(f'{_shown(c)} AS {chr(34)}{h}{chr(34)}' for c, h in zip(columns, headers))} FROM ({SQL[name]})"


@query(_of("dock_view_of_current_wave", W.DOCK_COLUMNS, V.DOCK_HEADERS), ())
def csv_dock_dashboard(spark, d):
    return W.report(W.dock_view(X.tasks(spark, d), START, END), W.DOCK_COLUMNS, V.DOCK_HEADERS)


@query(_of("wave_zones", W.ZONE_COLUMNS, V.ZONE_HEADERS), ())
def csv_wave_zones(spark, d):
    return W.report(W.wave_zones(X.tasks(spark, d), START, END, "w7"), W.ZONE_COLUMNS, V.ZONE_HEADERS)


@query(_of("box_tracking", W.BOX_COLUMNS, V.BOX_HEADERS), ())
def csv_box_tracking(spark, d):
    return W.report(S.box_tracking(X.scan_logs(spark, d), X.tasks(spark, d)), W.BOX_COLUMNS, V.BOX_HEADERS)


@query(" UNION ALL ".join(f"SELECT '{label}' AS \"指标\", {_shown(c)} AS \"值\" FROM ({SQL['global_dashboard']})" for c, label in zip(W.GLOBAL_COLUMNS, V.GLOBAL_LABELS)), ())
def csv_global_dashboard(spark, d):
    return W.vertical_report(global_dashboard(spark, d), W.GLOBAL_COLUMNS, V.GLOBAL_LABELS, V.PAIR_HEADERS)

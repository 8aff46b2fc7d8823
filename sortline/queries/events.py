"""Queries of scans, drops and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as E
from ..sources import fixtures as X
from .registry import NOW, query

NEWEST = "newest AS (SELECT * FROM tasks QUALIFY row_number() OVER (PARTITION BY upper(barcode) ORDER BY created_time DESC, shard_month DESC, id DESC) = 1)"
MATCHED = """matched AS (SELECT e.*, upper(trim(e.barcode)) AS code, CASE WHEN regexp_matches(upper(e.barcode), '^02[0-9]') THEN 1 WHEN regexp_matches(upper(e.barcode), '^Z[0-9]') THEN 2 ELSE 0 END AS kind,
  CASE WHEN regexp_matches(upper(e.barcode), '^02[0-9]') THEN substr(e.barcode, 3, 1) WHEN regexp_matches(upper(e.barcode), '^Z[0-9]') THEN substr(e.barcode, 2, 1) END AS chute,
  t.id AS task_id, t.shard_month AS task_month, t.status AS task_status FROM scan_events e LEFT JOIN newest t ON upper(t.barcode) = upper(e.barcode))"""
SCANS = (X.TASKS, X.ORDER_KEYS, X.SCAN_EVENTS, NEWEST, MATCHED)


@query("SELECT event_id, code, kind, chute, task_id, task_month, task_status FROM matched", SCANS)
def scan_match(spark, d):
    return E.match_scans(X.scan_events(spark, d), X.tasks(spark, d)).select("event_id", "code", F.col("kind").cast("int").alias("kind"), "chute", "task_id", "task_month", "task_status")


@query(
    """SELECT event_id, CASE WHEN kind > 0 THEN task_id END AS business_task_id, barcode, device_code, kind > 0 AND task_id IS NOT NULL AS is_matched,
  CASE WHEN kind = 0 THEN 'barcode not supported' WHEN task_id IS NULL THEN 'no task' WHEN task_status = 4 THEN 'not allowed in 待回传' WHEN task_status = 5 THEN 'not allowed in 异常' END AS failure_reason, scan_time FROM matched""",
    SCANS,
)
def scan_log_rows(spark, d):
    return E.scan_log_rows(E.match_scans(X.scan_events(spark, d), X.tasks(spark, d)))


FOLDED = """folded AS (SELECT task_id, task_month, count(*) AS scans, max(scan_time) AS scan_time, arg_max(chute, (scan_time, event_id)) AS chute, arg_max(weight_gram, (scan_time, event_id)) AS weight
  FROM matched WHERE kind > 0 AND task_id IS NOT NULL GROUP BY 1, 2),
applied AS (SELECT t.*, f.scans, f.scan_time, f.chute, f.weight, f.scans IS NOT NULL AS hit, f.scans IS NOT NULL AND status IN (1, 2, 3) AS ok FROM tasks t LEFT JOIN folded f ON t.id = f.task_id AND t.shard_month = f.task_month)"""


APPLIED = """SELECT id, shard_month, CASE WHEN ok THEN 2 ELSE status END AS status, CASE WHEN ok THEN scan_time ELSE scanned_at END AS scanned_at, CASE WHEN ok THEN chute ELSE target_chute_code END AS target_chute_code,
  CASE WHEN ok AND status = 3 THEN NULL ELSE actual_chute_code END AS actual_chute_code, CASE WHEN ok AND status = 3 THEN NULL ELSE dropped_at END AS dropped_at,
  CASE WHEN ok AND status = 3 THEN 0 ELSE feedback_status END AS feedback_status, CASE WHEN ok THEN coalesce(weight, weight_gram) ELSE weight_gram END AS weight_gram,
  CASE WHEN ok THEN coalesce(CASE WHEN status <> 3 OR scans = 1 THEN actual_chute_code END, chute) ELSE resolved_dock_code END AS resolved_dock_code, CASE WHEN hit AND NOT ok THEN CAST(scan_retry_count + scans AS INTEGER) ELSE scan_retry_count END AS scan_retry_count,
  CASE WHEN hit THEN TIMESTAMP '2024-02-01' ELSE updated_time END AS updated_time FROM applied"""


@query(APPLIED, (*SCANS, FOLDED))
def scans_applied(spark, d):
    out = E.apply_scans(X.tasks(spark, d), X.scan_events(spark, d), NOW)
    return out.select("id", "shard_month", "status", "scanned_at", "target_chute_code", "actual_chute_code", "dropped_at", "feedback_status", "weight_gram", "resolved_dock_code", "scan_retry_count", "updated_time")


REQUESTS = """requests AS (SELECT o_orderkey AS request_id, list(barcode ORDER BY id) AS barcodes, CAST(max(o_totalprice) AS DECIMAL(18,3)) AS weight_gram FROM tasks JOIN orders ON CAST(order_id AS BIGINT) = o_orderkey GROUP BY 1),
codes AS (SELECT request_id, unnest(barcodes) AS barcode, unnest(range(0, len(barcodes))) AS nth, weight_gram FROM requests),
parsed AS (SELECT *, CASE WHEN barcode LIKE '02%' THEN substr(barcode, 3, 1) WHEN barcode LIKE 'Z%' THEN substr(barcode, 2, 1) END AS chute FROM codes),
judged AS (SELECT request_id, CASE WHEN count(*) > count(chute) THEN 'barcode not supported' WHEN count(DISTINCT chute) > 1 THEN 'barcodes of several chutes' END AS reason FROM parsed GROUP BY 1)"""


def requests(spark, d):
    t = X.tasks(spark, d).groupBy(F.col("order_id").cast("long").alias("request_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "barcode"))), lambda x: x.barcode).alias("barcodes"))
    o = X.load(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_totalprice").cast("decimal(18,3)").alias("weight_gram"))
    return t.join(o, "request_id")


@query("SELECT request_id, nth, barcode, CASE WHEN nth = 0 THEN weight_gram ELSE 0 END AS weight_gram FROM codes JOIN judged USING (request_id) WHERE reason IS NULL", (X.TASKS, REQUESTS))
def multi_barcode_scans(spark, d):
    scans, _ = E.scan_requests(requests(spark, d))
    return scans.select("request_id", F.col("nth").cast("long").alias("nth"), "barcode", F.col("weight_gram").cast("decimal(18,3)").alias("weight_gram"))


@query("SELECT request_id, reason FROM judged WHERE reason IS NOT NULL", (X.TASKS, REQUESTS))
def multi_barcode_rejects(spark, d):
    return E.scan_requests(requests(spark, d))[1]


CHUTES = """asked AS (SELECT event_id AS request_id, CASE WHEN event_id % 4 > 0 THEN (event_id % orders_used) || '-' || (1 + event_id % 7) END AS task_code, CASE WHEN event_id % 4 < 2 THEN '02' || (event_id % 10) || (event_id % 400) END AS barcode FROM events, order_keys),
found AS (SELECT a.request_id, coalesce(c.task_code, n.task_code) AS task_code, coalesce(c.status, n.status) AS status, coalesce(c.target_chute_code, n.target_chute_code) AS chute
  FROM asked a LEFT JOIN tasks c ON c.task_code = a.task_code LEFT JOIN newest n ON upper(n.barcode) = upper(a.barcode))"""


@query(
    "SELECT request_id, task_code, status IS NOT NULL AND status IN (2, 3) AS is_resolved, CASE WHEN status IN (2, 3) THEN chute END AS chute_code, CASE WHEN status IS NULL THEN 'no task' WHEN status NOT IN (2, 3) THEN 'status not allowed' END AS reason FROM found",
    (X.TASKS, X.ORDER_KEYS, NEWEST, CHUTES),
)
def chutes_resolved(spark, d):
    nr = F.col("event_id")
    asked = X.load(spark, d, "events").crossJoin(X.order_keys(spark, d)).select(  # one row
        nr.alias("request_id"), F.when(nr % 4 > 0, F.concat_ws("-", nr % F.col("orders_used"), 1 + nr % 7)).alias("task_code"), F.when(nr % 4 < 2, F.concat(F.lit("02"), nr % 10, nr % 400)).alias("barcode")
    )
    return E.resolve_chutes(asked, X.tasks(spark, d))


JUDGED = """judged0 AS (SELECT e.*, t.id, t.shard_month, t.status, CASE WHEN e.task_code IS NULL THEN '参数校验失败' WHEN t.id IS NULL THEN '未找到任务' WHEN t.status NOT IN (2, 3, 4) THEN '任务状态不允许落格回传'
    WHEN is_success AND e.actual_chute_code IS NULL THEN '实际落格编码不能为空' END AS reason0 FROM drop_events e LEFT JOIN tasks t USING (task_code)),
judged AS (SELECT *, CASE WHEN reason0 IS NULL AND coalesce(bool_or(NOT is_success) OVER (PARTITION BY id, shard_month, reason0 IS NULL ORDER BY drop_time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN '任务状态不允许落格回传' ELSE reason0 END AS reason FROM judged0),
folded AS (SELECT id AS drop_of, shard_month AS drop_month, bool_and(is_success) AS fine, arg_max(actual_chute_code, (drop_time, event_id)) FILTER (is_success) AS chute, max(drop_time) FILTER (is_success) AS at_time FROM judged WHERE reason IS NULL GROUP BY 1, 2)"""
DROPS = (X.TASKS, X.ORDER_KEYS, X.DROP_EVENTS, JUDGED)


@query("SELECT event_id, CASE WHEN id IS NOT NULL THEN task_code END AS task_code, reason IS NULL AS is_accepted, reason FROM judged", DROPS)
def drops_judged(spark, d):
    return E.apply_drops(X.tasks(spark, d), X.drop_events(spark, d), NOW).judged


@query(
    """SELECT id, shard_month, CASE WHEN fine THEN 3 WHEN drop_of IS NOT NULL THEN 5 ELSE status END AS status, CASE WHEN chute IS NOT NULL THEN 1 ELSE feedback_status END AS feedback_status, coalesce(chute, actual_chute_code) AS actual_chute_code,
  coalesce(at_time, dropped_at) AS dropped_at, is_exception OR (drop_of IS NOT NULL AND NOT fine) AS is_exception, coalesce(chute, actual_chute_code, target_chute_code, '未分配码头') AS resolved_dock_code FROM tasks LEFT JOIN folded ON id = drop_of AND shard_month = drop_month""",
    DROPS,
)
def drops_applied(spark, d):
    out = E.apply_drops(X.tasks(spark, d), X.drop_events(spark, d), NOW).tasks
    return out.select("id", "shard_month", "status", "feedback_status", "actual_chute_code", "dropped_at", "is_exception", "resolved_dock_code")


@query("SELECT event_id, id AS business_task_id, actual_chute_code, is_success, failure_reason, drop_time FROM judged WHERE reason IS NULL", DROPS)
def drop_log_rows(spark, d):
    return E.apply_drops(X.tasks(spark, d), X.drop_events(spark, d), NOW).log.drop("task_code")


@query("SELECT id, scan_retry_count >= 3 AS should_recirculate, is_recirculated OR scan_retry_count >= 3 AS is_recirculated, CASE WHEN scan_retry_count >= 3 THEN 5 ELSE status END AS status, is_exception OR scan_retry_count >= 3 AS is_exception FROM tasks")
def recirculation_rule(spark, d):
    return E.recirculation_rule(X.tasks(spark, d), 3, NOW).select("id", "should_recirculate", "is_recirculated", "status", "is_exception")


ACTIVE = "active AS (SELECT barcode AS label, count(*) AS n_active, arg_min(task_code, (created_time, task_code)) AS first_code, arg_max(task_code, (created_time, task_code)) AS last_code FROM tasks WHERE status NOT IN (3, 5) GROUP BY 1)"


def _labels(picked: str, decided: str) -> str:
    return f"SELECT label, n_active, n_active > 1 AS is_multi_label, {decided} AS is_decided, CASE WHEN {decided} THEN {picked} END AS selected_task, CASE WHEN n_active > 1 THEN n_active - CAST({decided} AS BIGINT) ELSE 0 END AS n_discarded FROM active"


@query(_labels("first_code", "true"), (X.TASKS, ACTIVE))
def labels_use_first(spark, d):
    return E.decide_labels(X.tasks(spark, d), E.USE_FIRST)


@query(_labels("last_code", "true"), (X.TASKS, ACTIVE))
def labels_use_latest(spark, d):
    return E.decide_labels(X.tasks(spark, d), E.USE_LATEST)


@query(_labels("first_code", "(n_active = 1)"), (X.TASKS, ACTIVE))
def labels_mark_exception(spark, d):
    return E.decide_labels(X.tasks(spark, d), E.MARK_EXCEPTION)


@query("SELECT label, task_code FROM tasks JOIN active ON barcode = label WHERE status NOT IN (3, 5) AND n_active > 1 AND task_code <> first_code", (X.TASKS, ACTIVE))
def labels_discarded(spark, d):
    return E.discarded_tasks(X.tasks(spark, d), E.USE_FIRST)

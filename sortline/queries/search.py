"""Queries of filters, lookups, pages and box tracking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed as V
from ..operators import search as S
from ..sources import fixtures as X
from ..sources import tables as T
from .registry import CHUTE, END, EXCEPTIONAL, IN_RANGE, IN_SCANS, RECIRCULATED, SCAN_END, SCAN_START, START, query

FOUND = S.TaskFilter(START, END, wave="w7", chute="5")
ID = "id, task_code, status, created_time"


@query(f"SELECT {ID} FROM tasks WHERE {IN_RANGE} AND upper(normalized_wave_code) = 'W7' AND (target_chute_code = '5' OR actual_chute_code = '5')")
def task_search(spark, d):
    return S.find_tasks(X.tasks(spark, d), FOUND).select(*ID.split(", "))


@query(f"SELECT {ID} FROM tasks WHERE {IN_RANGE} AND normalized_wave_code IS NULL AND resolved_dock_code = '3' AND {EXCEPTIONAL}")
def task_search_without_wave(spark, d):
    return S.find_tasks(X.tasks(spark, d), S.TaskFilter(START, END, wave=V.NO_WAVE, dock="3", only_exceptions=True)).select(*ID.split(", "))


@query(f"SELECT {ID} FROM tasks WHERE {IN_RANGE} AND {RECIRCULATED} AND regexp_full_match(resolved_dock_code, '[0-9]+')")
def recirculated_search(spark, d):
    return S.find_tasks(X.tasks(spark, d), S.TaskFilter(START, END, only_recirculated=True)).select(*ID.split(", "))


@query("SELECT id, barcode, created_time FROM tasks WHERE barcode IS NOT NULL AND status NOT IN (3, 5)")
def active_tasks(spark, d):
    return S.active_tasks(X.tasks(spark, d)).select("id", "barcode", "created_time")


@query("SELECT barcode, id, task_code FROM tasks QUALIFY row_number() OVER (PARTITION BY barcode ORDER BY created_time DESC, shard_month DESC, id DESC) = 1")
def newest_by_barcode(spark, d):
    return S.newest_by(X.tasks(spark, d), "barcode").select("barcode", "id", "task_code")


@query("SELECT source_table_code, business_key, id FROM tasks")
def newest_by_key(spark, d):
    return S.newest_by(X.tasks(spark, d), "source_table_code", "business_key").select("source_table_code", "business_key", "id")


@query("SELECT id, task_code FROM tasks QUALIFY row_number() OVER (PARTITION BY id ORDER BY shard_month DESC) = 1")
def ids_of_newest_month(spark, d):
    return S.by_newest_month(X.tasks(spark, d)).select("id", "task_code")


@query("SELECT id, business_key FROM tasks WHERE business_key IN (SELECT l_orderkey || '-' || l_linenumber FROM lineitem WHERE l_partkey % 97 = 0)")
def tasks_with_pairs(spark, d):
    pairs = X.load(spark, d, "lineitem").filter("l_partkey % 97 = 0").select(F.lit("LINES").alias("source_table_code"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("business_key"))
    return S.with_pairs(X.tasks(spark, d), pairs).select("id", "business_key")


@query(f"SELECT task_code, wave_code, wave_remark, source_type, status, working_area, resolved_dock_code, is_exception, is_recirculated, updated_time FROM tasks WHERE {IN_RANGE} AND upper(normalized_wave_code) = 'W7'")
def wave_task_stats(spark, d):
    return S.wave_task_stats(X.tasks(spark, d), START, END, "W7")


ITEMS = f"""items AS (SELECT id, task_code, barcode, normalized_wave_code AS wave_code,
  CASE status WHEN 1 THEN '已创建' WHEN 2 THEN '已扫描' WHEN 3 THEN '已落格' WHEN 4 THEN '待回传' WHEN 5 THEN '异常' ELSE '未知状态' END AS status_text,
  CASE source_type WHEN 1 THEN '拆零' WHEN 2 THEN '整件' ELSE '未知来源' END AS source_text,
  coalesce(actual_chute_code, target_chute_code, '未分配码头') AS dock_code, {EXCEPTIONAL} AS is_exception, is_recirculated, created_time, scanned_at FROM tasks WHERE {IN_RANGE})"""


@query("SELECT * FROM items", (X.TASKS, ITEMS))
def task_items(spark, d):
    return S.task_items(S.find_tasks(X.tasks(spark, d), S.TaskFilter(START, END)))


@query("SELECT * FROM items ORDER BY created_time DESC, id DESC LIMIT 50 OFFSET 100", (X.TASKS, ITEMS))
def task_page(spark, d):
    return S.task_items(S.page(S.find_tasks(X.tasks(spark, d), S.TaskFilter(START, END)), 3, 50))


@query(f"SELECT * FROM items WHERE is_exception ORDER BY created_time DESC, id DESC LIMIT 50", (X.TASKS, ITEMS))  # noqa: F541
def exception_page(spark, d):
    return S.task_items(S.page(S.find_tasks(X.tasks(spark, d), S.TaskFilter(START, END, only_exceptions=True)), 1, 50))


@query(f"SELECT i.* FROM items i JOIN tasks t USING (task_code) WHERE {RECIRCULATED} ORDER BY i.created_time DESC, i.id DESC LIMIT 50", (X.TASKS, ITEMS))
def recirculated_page(spark, d):
    return S.task_items(S.page(S.find_tasks(X.tasks(spark, d), S.TaskFilter(START, END, only_recirculated=True)), 1, 50))


@query(f"SELECT {ID} FROM tasks WHERE {IN_RANGE} AND (created_time < TIMESTAMP '1997-06-15 00:03:20' OR (created_time = TIMESTAMP '1997-06-15 00:03:20' AND id < 30000)) ORDER BY created_time DESC, id DESC LIMIT 51")
def task_page_after(spark, d):
    return S.page_after(S.find_tasks(X.tasks(spark, d), S.TaskFilter(START, END)), "1997-06-15 00:03:20", 30000, 50).select(*ID.split(", "))


@query(f"SELECT count(*) AS tasks FROM tasks WHERE {IN_RANGE} AND upper(normalized_wave_code) = 'W7' AND (target_chute_code = '5' OR actual_chute_code = '5')")
def task_count(spark, d):
    return S.count_tasks(X.tasks(spark, d), FOUND)


@query("SELECT id, created_time, feedback_status FROM tasks WHERE feedback_status = 1 ORDER BY created_time, id LIMIT 100")
def oldest_pending_feedback(spark, d):
    return S.oldest_feedback(X.tasks(spark, d), V.PENDING, 100).select("id", "created_time", "feedback_status")


@query("SELECT id, created_time, feedback_status FROM tasks WHERE feedback_status = 3 ORDER BY created_time, id LIMIT 100")
def oldest_failed_feedback(spark, d):
    return S.oldest_feedback(X.tasks(spark, d), V.FAILED, 100).select("id", "created_time", "feedback_status")


@query(f"SELECT * FROM scan_logs WHERE {IN_SCANS} AND device_code = 'D3'", (X.SCAN_LOGS,))
def scan_search(spark, d):
    return S.find_scans(X.scan_logs(spark, d), SCAN_START, SCAN_END, device="D3")


@query(f"SELECT * FROM scan_logs WHERE {IN_SCANS} ORDER BY scan_time DESC, id DESC LIMIT 40 OFFSET 40", (X.SCAN_LOGS,))
def scan_page(spark, d):
    return S.page(S.find_scans(X.scan_logs(spark, d), SCAN_START, SCAN_END), 2, 40, time="scan_time")


BOXES = f"""newest AS (SELECT * FROM tasks QUALIFY row_number() OVER (PARTITION BY id ORDER BY shard_month DESC) = 1),
boxes AS (SELECT s.id, s.barcode AS box_id, t.task_code, t.wave_code, t.order_id, t.store_id, t.store_name, t.product_code, t.pick_location, s.device_code AS scanner, s.scan_time,
  CASE WHEN t.id IS NOT NULL THEN {CHUTE} END AS chute,
  CASE WHEN NOT s.is_matched THEN '未匹配' WHEN t.id IS NULL THEN '已匹配' WHEN {EXCEPTIONAL} THEN '异常待处理' WHEN is_recirculated OR {RECIRCULATED} THEN '回流复扫' ELSE '已扫描' END AS box_status,
  s.is_matched, s.failure_reason FROM scan_logs s LEFT JOIN newest t ON s.business_task_id = t.id)"""


@query("SELECT * FROM boxes", (X.TASKS, X.SCAN_LOGS, BOXES))
def box_tracking(spark, d):
    return S.box_tracking(X.scan_logs(spark, d), X.tasks(spark, d))


@query("SELECT * FROM boxes WHERE lower(chute) = '7'", (X.TASKS, X.SCAN_LOGS, BOXES))
def box_tracking_of_chute(spark, d):
    return S.box_tracking(X.scan_logs(spark, d), X.tasks(spark, d), chute="7")


@query("SELECT * FROM boxes ORDER BY scan_time DESC, id DESC LIMIT 50", (X.TASKS, X.SCAN_LOGS, BOXES))
def box_page(spark, d):
    return S.box_tracking(S.page(X.scan_logs(spark, d), 1, 50, time="scan_time"), X.tasks(spark, d))


@query(f"SELECT shard_month, count(*) AS rows FROM tasks WHERE {IN_RANGE} GROUP BY 1")
def months_in_range(spark, d):
    return T.month_counts(T.in_months(X.tasks(spark, d), START, END), "created_time")


@query("SELECT CASE WHEN created_time < TIMESTAMP '1995-01-01' THEN 'legacy' ELSE shard_month END AS shard_month, count(*) AS rows FROM tasks GROUP BY 1")
def months_with_legacy(spark, d):
    rows = X.tasks(spark, d)
    old = C.ntz("1995-01-01 00:00:00")
    both = T.with_legacy(rows.filter(F.col("created_time") >= old), rows.filter(F.col("created_time") < old).drop("shard_month"))
    return both.groupBy("shard_month").agg(F.count("*").cast("long").alias("rows"))


@query("SELECT id, started_time, table_name, status FROM (SELECT event_id AS id, ts AS started_time, event_type AS table_name, event_id % 3 AS status FROM events) WHERE started_time BETWEEN TIMESTAMP '2024-01-05 06:30:20' AND TIMESTAMP '2024-01-20 18:45:40' AND status = 1 ORDER BY started_time DESC, id DESC LIMIT 30 OFFSET 30", ())
def retention_audit_page(spark, d):
    audit = X.load(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("started_time"), F.col("event_type").alias("table_name"), (F.col("event_id") % 3).alias("status"))
    return S.audit_page(audit, SCAN_START, SCAN_END, 2, 30, status=1)


@query(
    """SELECT business_key, row_nr FROM (SELECT business_key, row_number() OVER (ORDER BY cursor, l_partkey, l_suppkey, business_key, turn) AS row_nr FROM incoming WHERE cursor > TIMESTAMP '1997-01-01' AND cursor <= TIMESTAMP '1997-02-01')
WHERE row_nr BETWEEN 101 AND 200""",
    (X.INCOMING,),
)
def source_page(spark, d):
    rows = X.incoming(spark, d).filter("cursor > '1997-01-01' AND cursor <= '1997-02-01'")
    return S.source_page(rows, ["cursor", "l_partkey", "l_suppkey", "business_key", "seq"], 2, 100).select("business_key", F.col("row_nr").cast("long").alias("row_nr"))


@query(
    """SELECT barcode, regexp_full_match(barcode, '(02|Z)[0-9].*') AS known, CASE WHEN barcode LIKE '02%' THEN 1 WHEN barcode LIKE 'Z%' THEN 2 ELSE 0 END AS kind,
  CASE WHEN barcode LIKE '02%' THEN substr(barcode, 3, 1) WHEN barcode LIKE 'Z%' THEN substr(barcode, 2, 1) END AS chute, strftime(created_time, '%Y%m') AS month,
  date_trunc('minute', created_time) AS minute, upper(regexp_replace(working_area, '[^\\p{L}\\p{Nd}]', '', 'g')) AS area, TRY_CAST(resolved_dock_code AS INTEGER) AS dock, CAST(date_trunc('month', created_time) - INTERVAL 5 MONTH AS DATE) AS kept_from FROM tasks"""
)
def scalar_functions(spark, d):
    code, kind, digit = C.parse_barcode(F.concat(F.lit(" "), F.lower("barcode"), F.lit("\t")))
    return X.tasks(spark, d).select(
        code.alias("barcode"),
        (kind > 0).alias("known"),
        kind.cast("int").alias("kind"),
        digit.alias("chute"),
        C.month_key("created_time").alias("month"),
        C.minute("created_time").alias("minute"),
        C.alphanumeric_key("working_area").alias("area"),
        C.safe_int(F.concat(F.lit(" "), "resolved_dock_code")).alias("dock"),
        C.retention_threshold("created_time", 6).alias("kept_from"),
    )

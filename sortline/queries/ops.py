"""Queries of cleanup, feedback and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed as V
from ..operators import maintenance as M
from ..sources import fixtures as X
from .registry import NOW, query

HIT = "(coalesce(upper(normalized_wave_code) = 'W7', false) AND status NOT IN (3, 5))"


@query(f"SELECT id, CASE WHEN {HIT} THEN 5 ELSE status END AS status, is_exception OR {HIT} AS is_exception FROM tasks")
def wave_cleaned(spark, d):
    return M.clean_wave(X.tasks(spark, d), "w7", V.EXCEPTION, NOW)[0].select("id", "status", "is_exception")


@query(f"SELECT 'W7' AS wave_code, false AS dry_run, count(*) AS found, count(*) FILTER ({HIT}) AS cleanable, count(*) FILTER ({HIT}) AS cleaned, 'completed' AS outcome, TIMESTAMP '{NOW}' AS started_time FROM tasks WHERE upper(normalized_wave_code) = 'W7'")
def wave_cleanup_audit(spark, d):
    return M.clean_wave(X.tasks(spark, d), "W7", V.EXCEPTION, NOW)[1]


@query(f"SELECT 'W7' AS wave_code, true AS dry_run, count(*) AS found, count(*) FILTER ({HIT}) AS cleanable, CAST(0 AS BIGINT) AS cleaned, 'completed' AS outcome, TIMESTAMP '{NOW}' AS started_time FROM tasks WHERE upper(normalized_wave_code) = 'W7'")
def wave_cleanup_dry_run(spark, d):
    return M.clean_wave(X.tasks(spark, d), "W7", V.EXCEPTION, NOW, dry_run=True)[1]


CLAIMED = "claimed AS (SELECT * FROM tasks WHERE feedback_status = 1 OR (feedback_status = 4 AND updated_time < TIMESTAMP '1998-01-01 11:50:00') ORDER BY created_time, id LIMIT 200)"


@query("SELECT id, created_time FROM claimed", (X.TASKS, CLAIMED))
def feedback_claimed(spark, d):
    return M.claim_feedback(X.tasks(spark, d), V.PENDING, 200, "1998-01-01 12:00:00").select("id", "created_time")


@query("SELECT id, shard_month, CASE WHEN (id, shard_month) IN (SELECT (id, shard_month) FROM claimed) THEN 4 ELSE feedback_status END AS feedback_status FROM tasks", (X.TASKS, CLAIMED))
def feedback_processing(spark, d):
    rows = X.tasks(spark, d)
    return M.mark_claimed(rows, M.claim_feedback(rows, V.PENDING, 200, "1998-01-01 12:00:00"), "1998-01-01 12:00:00").select("id", "shard_month", "feedback_status")


@query("SELECT id, shard_month, CASE WHEN (id, shard_month) IN (SELECT (id, shard_month) FROM claimed) THEN 2 ELSE feedback_status END AS feedback_status FROM tasks", (X.TASKS, CLAIMED))
def feedback_finished(spark, d):
    rows = X.tasks(spark, d)
    claimed = M.claim_feedback(rows, V.PENDING, 200, "1998-01-01 12:00:00")
    return M.finish_feedback(rows, claimed, claimed.count(), "1998-01-01 12:00:00").select("id", "shard_month", "feedback_status")


@query("SELECT id, shard_month, CASE WHEN (id, shard_month) IN (SELECT (id, shard_month) FROM claimed) THEN 3 ELSE feedback_status END AS feedback_status FROM tasks", (X.TASKS, CLAIMED))
def feedback_short_write(spark, d):
    rows = X.tasks(spark, d)
    claimed = M.claim_feedback(rows, V.PENDING, 200, "1998-01-01 12:00:00")
    return M.finish_feedback(rows, claimed, claimed.count() - 1, "1998-01-01 12:00:00").select("id", "shard_month", "feedback_status")


@query("SELECT shard_month, count(*) AS rows FROM tasks WHERE shard_month < '199708' GROUP BY 1")
def expired_months(spark, d):
    return M.expired_months(X.tasks(spark, d), "1998-01-15 00:00:00", 6)


@query("SELECT id FROM tasks WHERE created_time >= TIMESTAMP '1997-08-01'")
def rows_kept(spark, d):
    return M.delete_before(X.tasks(spark, d), "created_time", "1997-08-01 00:00:00").select("id")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || '0|' || event_type || '|' AS business_key FROM events", ())
def business_keys(spark, d):
    e = X.load(spark, d, "events").withColumn("none", F.lit(None).cast("string"))
    return e.select("event_id", C.business_key(("ts", "timestamp_ntz"), ("event_type", "string"), ("none", "string")).alias("business_key"))


REPORTED = "SELECT id, shard_month, CASE WHEN (id, shard_month) IN (SELECT (id, shard_month) FROM claimed) THEN 2 ELSE feedback_status END AS feedback_status FROM tasks"


@query(REPORTED, (X.TASKS, CLAIMED))
def feedback_reported(spark, d):
    """The whole run: claim, write back, finish."""
    return M.report_feedback(X.tasks(spark, d), lambda rows: rows.count(), "1998-01-01 12:00:00", 200).tasks.select("id", "shard_month", "feedback_status")


FAILED = CLAIMED.replace("feedback_status = 1", "feedback_status = 3")


@query("SELECT count(*) AS claimed, count(*) - 1 AS written, 0 AS succeeded, count(*) AS failed, 0 AS skipped, (count(*) - 1) || ' rows written, ' || count(*) || ' claimed' AS failure FROM claimed", (X.TASKS, FAILED))
def feedback_retry_result(spark, d):
    """A retry of failed tasks whose target takes a row less."""
    return M.report_feedback(X.tasks(spark, d), lambda rows: rows.count() - 1, "1998-01-01 12:00:00", 200, V.FAILED).result


@query(
    """SELECT 'run-1:tasks' AS id, 'run-1' AS batch_id, 'tasks' AS target_code, 'business_tasks' AS logical_table, 'DropShards' AS retention_mode, 'created_time' AS time_column, 6 AS keep_months, false AS is_dry_run, true AS allow_delete,
  TIMESTAMP '1997-08-01' AS threshold_time, 'Completed' AS execution_stage, count(DISTINCT shard_month) AS scanned_count, count(DISTINCT shard_month) FILTER (shard_month < '199708') AS candidate_count,
  count(DISTINCT shard_month) FILTER (shard_month < '199708') AS deleted_count, 'dropped: ' || count(DISTINCT shard_month) FILTER (shard_month < '199708') || ' months' AS message, 'here' AS instance_id,
  TIMESTAMP '1998-01-15' AS started_time, TIMESTAMP '1998-01-15 00:00:09' AS completed_time FROM tasks"""
)
def retention_audit(spark, d):
    target = M.Target("tasks", "business_tasks", 6)
    return M.retention_audit(X.tasks(spark, d), target, "run-1", "1998-01-15 00:00:00", "here", "1998-01-15 00:00:09")


@query(
    """SELECT task_code, CASE WHEN l < 5 THEN make_date(CAST(shard_month[1:4] AS BIGINT), CAST(shard_month[5:6] AS BIGINT), 1) END AS month, order_id AS first_part, split_part(task_code, '-', 2) AS second_part, l % 2 = 0 AS has_zone, left('a' || order_id || 'b', 4) AS cleaned
FROM (SELECT *, CAST(split_part(task_code, '-', 2) AS INTEGER) AS l FROM tasks)"""
)
def text_functions(spark, d):
    t = X.tasks(spark, d).withColumn("l", F.split("task_code", "-")[1].cast("int"))
    name = F.when(F.col("l") < 5, F.concat(F.lit("business_tasks_"), "shard_month")).otherwise(F.concat(F.lit("business_tasks_13"), "l"))
    first, second = C.split_key(F.translate("task_code", "-", "|"), 2)
    at = F.concat(F.date_format("created_time", "yyyy-MM-dd HH:mm:ss"), F.when(F.col("l") % 4 == 0, "Z").when(F.col("l") % 2 == 0, "+08:00").otherwise(""))
    text = F.concat(F.lit("a\n"), "order_id", F.lit("\tb"))
    return t.select("task_code", C.month_of_name(name).alias("month"), first.alias("first_part"), second.alias("second_part"), C.has_zone(at).alias("has_zone"), C.clean_text(text, 4).alias("cleaned"))

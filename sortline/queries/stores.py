"""Queries of what runs on stores: sync runs, claims, retention, reconciliation, kept totals, ranked pages and streams. Each fills a store from the given tables first."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed as V
from ..operators import maintenance as M
from ..operators import reconcile as R
from ..operators import sync as Y
from ..plans import rank_index as K
from ..plans import wave_totals as T
from ..sources import fixtures as X
from ..sources import tables
from ..sources.scratch import folder
from ..sources.versions import Store, retried
from ..streaming import scans as stream
from . import events, ops, sync
from .aggregates import MEASURES, REMARK
from .registry import END, IN_RANGE, NOW, START, query

# --- sync runs -------------------------------------------------------------------------------------------------------

#: The batch of a window, held against the state before, as views.
BATCH = (X.INCOMING.replace("incoming AS", "every AS"), sync.STATE.replace("FROM incoming", "FROM every"), f"incoming AS (SELECT * FROM every WHERE {sync.WINDOWED})", sync.CLASSIFIED, sync.MERGED)
GONE = f"gone AS (SELECT business_key FROM merged WHERE {sync.WINDOWED} AND business_key NOT IN (SELECT business_key FROM source_keys))"


def sync_store(spark, d) -> Store:
    old = sync.state(spark, d)
    store = Store(spark, folder(spark, "sync"))
    target = X.incoming(spark, d).filter("cursor < '1998-01-01' AND seq.turn = 0").groupBy("business_key").agg(F.max_by(F.struct("l_partkey", "quantity", "cursor"), "seq").alias("r"))
    Y.open_sync(store, old, target.select("business_key", "r.l_partkey", "r.quantity", C.month_key("r.cursor").alias("shard_month")))
    return store


def run_sync(spark, d):
    return Y.sync_months(X.incoming(spark, d), sync_store(spark, d), X.source_keys(spark, d), sync.COLUMNS, sync.FROM, sync.TO, sync.LATER, "b1")


@query("SELECT business_key, cursor, shard_month, business_key IN (SELECT business_key FROM gone) AS is_soft_deleted FROM merged", (*BATCH, X.SOURCE_KEYS, GONE))
def sync_run(spark, d):
    """The state that a run over a year leaves in its store."""
    return run_sync(spark, d).state.select("business_key", "cursor", "shard_month", "is_soft_deleted")


@query(
    "SELECT count(*) AS read, count(*) FILTER (op = 'I') AS inserted, count(*) FILTER (op = 'U') AS updated, count(*) FILTER (op = 'S') AS skipped, max(cursor) AS max_cursor, (SELECT count(*) FROM gone) AS deleted FROM classified",
    (*BATCH, X.SOURCE_KEYS, GONE),
)
def sync_run_counts(spark, d):
    """Its figures, observed while it wrote."""
    return run_sync(spark, d).result


@query(f"SELECT business_key, cursor FROM state WHERE {sync.WINDOWED} AND business_key NOT IN (SELECT business_key FROM source_keys)", (X.INCOMING, X.SOURCE_KEYS, sync.STATE))
def reconciled_deletions(spark, d):
    return R.reconcile(sync.state(spark, d), X.source_keys(spark, d), sync.FROM, sync.TO).gone.select("business_key", "cursor")


# --- claims and retention --------------------------------------------------------------------------------------------


def task_store(spark, d, name: str, **how) -> Store:
    store = Store(spark, folder(spark, name))
    attempt = store.attempt()
    attempt.replace("rows", X.tasks(spark, d), **how)
    attempt.commit()
    return store


@query(ops.REPORTED, (X.TASKS, ops.CLAIMED))
def feedback_run(spark, d):
    """Tasks after a stored claim, the write-back and its end."""
    store = task_store(spark, d, "feedback")
    M.feedback_run(store, lambda rows: rows.count(), lambda: "1998-01-01 12:00:00", 200)
    return store.read("rows").select("id", "shard_month", "feedback_status")


@query("SELECT id, created_time FROM tasks WHERE created_time >= TIMESTAMP '1997-08-01'")
def retention_rows(spark, d):
    """Tasks that a retention of rows leaves."""
    store = task_store(spark, d, "retention", time="created_time")
    M.retention_run(store, [M.Target("tasks", "rows", 6, M.DELETE_ROWS)], "1998-01-15 00:00:00", "run-1")
    return store.read("rows").select("id", "created_time")


@query(
    """SELECT 'tasks' AS target_code, 'Completed' AS execution_stage, count(DISTINCT shard_month) AS scanned_count, count(DISTINCT shard_month) FILTER (shard_month < '199708') AS candidate_count,
  count(DISTINCT shard_month) FILTER (shard_month < '199708') AS deleted_count FROM tasks
UNION ALL SELECT 'dry', 'Completed', count(DISTINCT shard_month) FILTER (shard_month >= '199708'), count(DISTINCT shard_month) FILTER (shard_month >= '199708' AND shard_month < '199711'), 0 FROM tasks
UNION ALL SELECT 'lost', 'Failed', 0, 0, 0"""
)
def retention_run(spark, d):
    """The audit of a run over three targets: months dropped, a dry run over what is left, and a table that isn't there."""
    store = task_store(spark, d, "retention")
    targets = [M.Target("tasks", "rows", 6), M.Target("dry", "rows", 3, dry_run=True), M.Target("lost", "nowhere")]
    return M.retention_run(store, targets, "1998-01-15 00:00:00", "run-1").select("target_code", "execution_stage", "scanned_count", "candidate_count", "deleted_count")


# --- kept totals and ranked pages ------------------------------------------------------------------------------------

#: Tasks after a batch of changes: some products go, some are dropped and get a remark, some move to another wave.
CHANGED = """changed AS (SELECT * REPLACE (CASE WHEN CAST(product_code AS BIGINT) % 10 = 1 THEN 3 ELSE status END AS status, CASE WHEN CAST(product_code AS BIGINT) % 10 = 1 THEN 'late' ELSE wave_remark END AS wave_remark,
  CASE WHEN CAST(product_code AS BIGINT) % 10 = 2 THEN 'W3' ELSE normalized_wave_code END AS normalized_wave_code) FROM tasks WHERE CAST(product_code AS BIGINT) % 10 <> 0)"""


@query(
    f"SELECT min(normalized_wave_code) AS wave_code, {MEASURES}, count(*) FILTER (status NOT IN (3, 5)) AS cleanable, {REMARK} AS wave_remark FROM changed WHERE normalized_wave_code IS NOT NULL GROUP BY upper(normalized_wave_code) HAVING count(*) FILTER (status NOT IN (3, 5)) > 0",
    (X.TASKS, CHANGED),
)
def wave_totals_kept(spark, d):
    """Cleanable waves by totals that took the changes up, not by all tasks."""
    before = X.tasks(spark, d)
    of = F.col("product_code").cast("long") % 10
    after = before.filter(of != 0).withColumns(
        {"status": F.when(of == 1, V.DROPPED).otherwise(F.col("status")), "wave_remark": F.when(of == 1, "late").otherwise(F.col("wave_remark")), "wave_code": F.when(of == 2, "W3").otherwise(F.col("wave_code"))}
    )
    changes = T.changes_between(before.filter(of <= 2), after.filter(of <= 2), columns=T.READ)

    def kept(moved):
        path = folder(spark, "totals")
        moved.write.parquet(path)
        return spark.read.schema(moved.schema).parquet(path)

    return T.cleanable_waves(T.apply_changes(T.wave_totals(before), changes, T.tasks_of_waves(after), kept).totals)


def ranked(spark, d) -> Store:
    store = Store(spark, folder(spark, "ranked"))
    retried(store, lambda attempt: K.write_ranked(attempt, "rows", X.tasks(spark, d), range_rows=500) or {})
    return store


@query("SELECT id, task_code, created_time FROM tasks ORDER BY created_time DESC, id DESC LIMIT 50 OFFSET (SELECT count(*) // 2 // 50 * 50 FROM tasks)")
def ranked_page(spark, d):
    """The page in the middle of all tasks, of which one range or two are opened."""
    store = ranked(spark, d)
    total = sum(r.rows for r in K.ranges(store.last(), "rows"))
    return K.page_at(store, "rows", total // 2 // 50 + 1, 50).rows.select("id", "task_code", "created_time")


@query(f"SELECT id, task_code, created_time FROM tasks WHERE {IN_RANGE} AND (is_exception OR status = 5) ORDER BY created_time DESC, id DESC LIMIT 40 OFFSET 120")
def ranked_exception_page(spark, d):
    """A page of a filtered search."""
    return K.page_at(ranked(spark, d), "rows", 4, 40, C.in_range("created_time", START, END) & C.is_exceptional()).rows.select("id", "task_code", "created_time")


# --- appends and streams ---------------------------------------------------------------------------------------------


@query("SELECT shard_month, count(*) AS rows FROM tasks GROUP BY 1")
def appended_months(spark, d):
    """Tasks appended to a table by month in two batches, read back."""
    path, rows = folder(spark, "appended"), X.tasks(spark, d).drop("shard_month")
    for k in range(2):
        tables.append_by_month(rows.filter(F.col("id") % 2 == k), path, "created_time", ["order_id"])
    return tables.read_months(spark, path).groupBy("shard_month").agg(F.count("*").cast("long").alias("rows"))


@query("SELECT task_code, count(*) OVER (PARTITION BY task_code) = 1 AS alone, true AS shaped FROM tasks")
def generated_codes(spark, d):
    """Codes for keys that have none: all of one form, and as many as there are keys."""
    code = C.generated_code("task_code")
    rows = X.tasks(spark, d).select("task_code", code.alias("code"))
    same = rows.groupBy("code").agg(F.count("*").alias("n"))
    return rows.join(same, "code").select("task_code", (F.col("n") == 1).alias("alone"), F.col("code").rlike("^S[0-9A-F]{16}$").alias("shaped"))


@query(events.APPLIED, (*events.SCANS, events.FOLDED))
def scan_stream(spark, d):
    """Tasks after a stream of all scans."""
    src, root = folder(spark, "scans"), folder(spark, "stream")
    scans = X.scan_events(spark, d)
    scans.write.parquet(src)
    table = stream.scanned_tasks(spark, f"{root}/tasks")
    table.write(X.tasks(spark, d), 0)
    stream.apply_scan_stream(spark.readStream.schema(scans.schema).parquet(src), table, f"{root}/log", f"{root}/checkpoint", lambda: NOW).awaitTermination()
    return table.read().select("id", "shard_month", "status", "scanned_at", "target_chute_code", "actual_chute_code", "dropped_at", "feedback_status", "weight_gram", "resolved_dock_code", "scan_retry_count", "updated_time")


@query("SELECT date_trunc('minute', scan_time) AS bucket, count(*) AS total, count(*) FILTER (is_matched) AS matched FROM scan_logs WHERE scan_time < (SELECT date_trunc('minute', max(scan_time)) FROM scan_logs) GROUP BY 1", (X.SCAN_LOGS,))
def minute_stream(spark, d):
    """Counts of the minutes that a stream of scans has closed: all but the last."""
    src, root = folder(spark, "logs"), folder(spark, "minutes")
    seen = X.scan_logs(spark, d)
    seen.write.parquet(src)
    counts = stream.minute_counts(spark.readStream.schema(seen.schema).parquet(src), "0 seconds")
    writer = counts.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True)
    writer.start().awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{root}/out").select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "total", "matched")


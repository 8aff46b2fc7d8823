"""Queries of sources, sinks, keyed sync and projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed as V
from ..operators import projection as P
from ..operators import sync as S
from ..sources import fixtures as X
from ..sources import scans, sinks
from .registry import IN_RANGE, NOW, query

FROM, TO = "1997-06-01 00:00:00", "1998-06-01 00:00:00"
COLUMNS = ["l_partkey", "l_suppkey", "quantity", "l_returnflag"]
VALUES = "(l_partkey, l_suppkey, quantity, l_returnflag)"
SEQ = "cursor, l_partkey, l_suppkey, turn"
#: The state before: the last row of each key shipped before 1998.
STATE = f"""state AS (SELECT business_key, {VALUES} AS v, cursor FROM incoming WHERE cursor < TIMESTAMP '1998-01-01' AND turn = 0
  QUALIFY row_number() OVER (PARTITION BY business_key ORDER BY cursor DESC, l_partkey DESC, l_suppkey DESC) = 1)"""
CLASSIFIED = f"""seen AS (SELECT i.*, {VALUES} AS v, coalesce(lag({VALUES}) OVER w, s.v) AS before, lead(1) OVER w IS NULL AS is_last
  FROM incoming i LEFT JOIN state s USING (business_key) WINDOW w AS (PARTITION BY business_key ORDER BY i.cursor, l_partkey, l_suppkey, turn)),
classified AS (SELECT *, CASE WHEN before IS NULL THEN 'I' WHEN before = v THEN 'S' ELSE 'U' END AS op FROM seen)"""
ALL = (X.INCOMING, STATE, CLASSIFIED)


def incoming(spark, d):
    return S.with_digest(X.incoming(spark, d), COLUMNS)


def state(spark, d):
    """Only the values of a key's last row are moved, and only if a digest of them is wanted; the cursor, by which seq begins, is that of the last row too."""
    rows = X.incoming(spark, d).filter("cursor < '1998-01-01' AND seq.turn = 0")
    last = rows.groupBy("business_key").agg(F.max("cursor").alias("cursor"), F.max_by(F.struct(*COLUMNS), "seq").alias("r"))
    digest = F.when(F.col("cursor").isNotNull(), C.row_digest(*COLUMNS))  # it never is null, but so all that read a digest move the same columns and share them
    return last.select("business_key", "r.*", "cursor").select(
        "business_key", digest.alias("digest"), "cursor", C.month_key("cursor").alias("shard_month"), F.lit(False).alias("is_soft_deleted"), C.ntz("1998-01-01 00:00:00").alias("updated_time")
    )


WINDOWED = f"cursor > TIMESTAMP '{FROM}' AND cursor <= TIMESTAMP '{TO}'"


@query(f"SELECT business_key, cursor, l_partkey FROM incoming WHERE {WINDOWED}", (X.INCOMING,))
def incremental_scan(spark, d):
    return scans.incremental(X.incoming(spark, d), "cursor", FROM, TO).select("business_key", "cursor", "l_partkey")


@query(f"SELECT DISTINCT business_key FROM incoming WHERE {WINDOWED}", (X.INCOMING,))
def key_scan(spark, d):
    return scans.keys_of_window(X.incoming(spark, d), ["business_key"], "cursor", FROM, TO)


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey % 50 = 3)", ())
def key_lookup(spark, d):
    keys = X.load(spark, d, "orders").filter("o_custkey % 50 = 3").select(F.col("o_orderkey").alias("l_orderkey"))
    return scans.rows_of_keys(X.load(spark, d, "lineitem"), keys, ["l_orderkey", "l_linenumber", "l_quantity"])


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P' AND o_orderdate BETWEEN TIMESTAMP '1997-06-01' AND TIMESTAMP '1998-06-01'", ())
def status_scan(spark, d):
    return scans.by_status(X.load(spark, d, "orders"), "o_orderstatus", scans.EQUALS, "P", "o_orderdate", FROM, TO).select("o_orderkey", "o_orderdate")


@query("SELECT event_id, ts, event_type, value FROM events", ())
def scan_without_columns(spark, d):
    return scans.without(X.load(spark, d, "events"), ["props", "user_id"], ["event_id", "ts"])


@query("SELECT CAST(o_orderkey AS VARCHAR) AS row_id, 'DONE' AS new_status, TIMESTAMP '2024-02-01 00:00:00' AS done_at, 'batch-1' AS batch_id FROM orders WHERE o_orderstatus = 'P'", ())
def status_write_back(spark, d):
    rows = scans.by_status(X.load(spark, d, "orders"), "o_orderstatus", scans.EQUALS, "P").select(F.col("o_orderkey").cast("string").alias("rid"))
    return sinks.status_write_back(rows, "rid", "DONE", NOW, "batch-1")


@query(f"SELECT CASE source_type WHEN 1 THEN 'split_feedback' WHEN 2 THEN 'full_case_feedback' END AS target, business_key, actual_chute_code AS chute, scanned_at AS at FROM tasks WHERE {IN_RANGE} AND feedback_status = 1")
def feedback_write_back(spark, d):
    from ..sources.tables import in_months
    from .registry import END, START

    rows = in_months(X.tasks(spark, d), START, END).filter(F.col("feedback_status") == V.PENDING)
    return sinks.feedback_write_back(rows, sinks.ROUTES, {"chute": "actual_chute_code", "at": "scanned_at"})


REQUESTED = "requested AS (SELECT CASE WHEN event_id % 10 = 0 THEN '  ' ELSE (event_id % 3000) || '-' || (1 + event_id % 7) END AS business_key FROM events)"


@query(
    """SELECT (SELECT count(*) FROM requested) AS requested, (SELECT count(*) FROM requested WHERE trim(business_key) = '') AS blank, (SELECT count(*) - count(DISTINCT business_key) FROM requested WHERE trim(business_key) <> '') AS duplicate,
  count(*) FILTER (there) AS skipped, count(*) FILTER (NOT there) AS inserted
FROM (SELECT DISTINCT business_key, business_key IN (SELECT business_key FROM tasks WHERE shard_month = '199705') AS there FROM requested WHERE trim(business_key) <> '')""",
    (X.TASKS, REQUESTED),
)
def seed_counts(spark, d):
    e = X.load(spark, d, "events")
    nr = F.col("event_id")
    requested = e.select(F.when(nr % 10 == 0, "  ").otherwise(F.concat(F.lit(" "), nr % 3000, F.lit("-"), 1 + nr % 7)).alias("business_key"))
    return sinks.seed(X.tasks(spark, d), requested, "business_key", "199705")[1]


CHECKPOINTS = "checkpoints AS (SELECT table_code, max(completed_time) AS last_cursor, TIMESTAMP '2024-02-03' AS last_success FROM sync_batches WHERE table_code IN ('click', 'view') GROUP BY 1)"


@query(
    """SELECT table_code, priority, coalesce(last_cursor, start_time) AS window_start,
  greatest(coalesce(last_cursor, start_time), greatest(TIMESTAMP '2024-02-01', coalesce(last_success, TIMESTAMP '2024-02-01')) - to_minutes(lag_minutes)) AS window_end FROM sync_definitions LEFT JOIN checkpoints USING (table_code)""",
    (X.SYNC_DEFINITIONS, X.SYNC_BATCHES, CHECKPOINTS),
)
def sync_windows(spark, d):
    done = X.sync_batches(spark, d).filter("table_code IN ('click', 'view')")
    checkpoints = done.groupBy("table_code").agg(F.max("completed_time").alias("last_cursor")).withColumn("last_success", C.ntz("2024-02-03 00:00:00"))
    return S.sync_window(X.sync_definitions(spark, d), checkpoints, NOW)


@query("SELECT business_key, cursor, l_partkey, l_suppkey, turn, op, is_last FROM classified", ALL)
def classify_rows(spark, d):
    return S.classify(incoming(spark, d), state(spark, d)).select("business_key", "cursor", "l_partkey", "l_suppkey", "seq.turn", "op", "is_last")


@query("SELECT count(*) AS read, count(*) FILTER (op = 'I') AS inserted, count(*) FILTER (op = 'U') AS updated, count(*) FILTER (op = 'S') AS skipped, max(cursor) AS max_cursor FROM classified", ALL)
def merge_counts(spark, d):
    return S.merge_counts(S.classify(incoming(spark, d), state(spark, d)))


MERGED = f"""latest AS (SELECT business_key, cursor, bool_or(op <> 'S') OVER (PARTITION BY business_key) AS changed, is_last FROM classified),
fresh AS (SELECT business_key, cursor, CASE WHEN date_diff('month', date_trunc('month', TIMESTAMP '1998-03-15'), date_trunc('month', cursor)) BETWEEN 0 AND 1 THEN strftime(cursor, '%Y%m') ELSE '199803' END AS shard_month FROM latest WHERE is_last AND changed),
merged AS (SELECT coalesce(f.business_key, s.business_key) AS business_key, coalesce(f.cursor, s.cursor) AS cursor, coalesce(f.shard_month, strftime(s.cursor, '%Y%m')) AS shard_month FROM state s FULL JOIN fresh f USING (business_key))"""
LATER = "1998-03-15 00:00:00"


@query("SELECT * FROM merged", (*ALL, MERGED))
def merge_state(spark, d):
    old = state(spark, d)
    return S.merge_state(old, S.last_rows(S.classify(incoming(spark, d), old)), LATER).select("business_key", "cursor", "shard_month")


@query("SELECT m.business_key, strftime(s.cursor, '%Y%m') AS old_month, m.shard_month AS new_month FROM merged m JOIN state s USING (business_key) WHERE strftime(s.cursor, '%Y%m') <> m.shard_month", (*ALL, MERGED))
def moved_keys(spark, d):
    old = state(spark, d)
    return S.moved_keys(old, S.merge_state(old, S.last_rows(S.classify(incoming(spark, d), old)), LATER))


@query(f"SELECT business_key, {SEQ} FROM incoming QUALIFY row_number() OVER (PARTITION BY business_key ORDER BY cursor DESC, l_partkey DESC, l_suppkey DESC, turn DESC) = 1", (X.INCOMING,))
def last_of_batch(spark, d):
    return P.last_of_batch(X.incoming(spark, d), ("business_key",), "seq").select("business_key", "cursor", "l_partkey", "l_suppkey", "seq.turn")


BATCH = """batch AS (SELECT business_key, cursor, quantity, CASE WHEN l_partkey % 3 = 0 THEN strftime(cursor + INTERVAL 1 MONTH, '%Y%m') ELSE strftime(cursor, '%Y%m') END AS shard_month
  FROM incoming WHERE cursor >= TIMESTAMP '1997-12-20' AND cursor < TIMESTAMP '1998-01-10' AND turn = 0 QUALIFY row_number() OVER (PARTITION BY business_key ORDER BY cursor DESC, l_partkey DESC, l_suppkey DESC) = 1),
kept AS (SELECT business_key, cursor, quantity, strftime(cursor, '%Y%m') AS shard_month FROM (SELECT *, (cursor, l_partkey, l_suppkey) AS o FROM incoming WHERE cursor < TIMESTAMP '1998-01-01' AND turn = 0) QUALIFY row_number() OVER (PARTITION BY business_key ORDER BY o DESC) = 1),
touched AS (SELECT shard_month FROM batch UNION SELECT shard_month FROM kept WHERE business_key IN (SELECT business_key FROM batch))"""


@query(
    "SELECT * FROM batch UNION ALL SELECT * FROM kept WHERE shard_month IN (SELECT shard_month FROM touched) AND business_key NOT IN (SELECT business_key FROM batch)",
    (X.INCOMING, BATCH),
)
def months_merged(spark, d):
    """What a batch of three weeks, a third of it moved to the next month, makes of the months that it touches."""
    rows = X.incoming(spark, d).filter("seq.turn = 0")
    last = lambda df: df.groupBy("business_key").agg(F.max_by(F.struct("cursor", "quantity", "l_partkey"), "seq").alias("r")).select("business_key", "r.*")
    target = last(rows.filter("cursor < '1998-01-01'")).withColumn("shard_month", C.month_key("cursor")).drop("l_partkey")
    batch = last(rows.filter("cursor >= '1997-12-20' AND cursor < '1998-01-10'"))
    month = F.when(F.col("l_partkey") % 3 == 0, C.month_key(F.col("cursor") + F.expr("INTERVAL 1 MONTH"))).otherwise(C.month_key("cursor"))
    return S.merge_months(target, batch.withColumn("shard_month", month).drop("l_partkey"))[1]


STATES = "states AS (SELECT business_key, strftime(cursor, '%Y%m') AS shard_month, cursor + to_days(CAST(l_partkey % 40 AS INTEGER)) AS updated_time FROM incoming WHERE turn = 0)"


@query("SELECT business_key, max(shard_month) AS shard_month, max(updated_time) AS updated_time FROM (SELECT * FROM states QUALIFY rank() OVER (PARTITION BY business_key ORDER BY updated_time DESC, shard_month DESC) = 1) GROUP BY 1", (X.INCOMING, STATES))
def latest_state(spark, d):
    rows = X.incoming(spark, d).filter("seq.turn = 0")
    states = rows.select("business_key", C.month_key("cursor").alias("shard_month"), (F.col("cursor") + F.make_dt_interval(days=(F.col("l_partkey") % 40).cast("int"))).alias("updated_time"))
    return S.latest_state(states)


GONE = f"gone AS (SELECT business_key, cursor FROM state WHERE {WINDOWED} AND business_key NOT IN (SELECT business_key FROM source_keys))"
DELETED = (X.INCOMING, X.SOURCE_KEYS, STATE, GONE)


@query("SELECT * FROM gone", DELETED)
def deleted_keys(spark, d):
    return S.deleted_keys(state(spark, d), X.source_keys(spark, d), FROM, TO).select("business_key", "cursor")


@query("SELECT business_key, business_key IN (SELECT business_key FROM gone) AS is_soft_deleted FROM state", DELETED)
def soft_deletion(spark, d):
    old = state(spark, d)
    return S.apply_deletions(old, old, S.deleted_keys(old, X.source_keys(spark, d), FROM, TO), S.SOFT, NOW).state.select("business_key", "is_soft_deleted")


@query("SELECT business_key, cursor FROM state WHERE business_key NOT IN (SELECT business_key FROM gone)", DELETED)
def hard_deletion(spark, d):
    old = state(spark, d)
    return S.apply_deletions(old, old, S.deleted_keys(old, X.source_keys(spark, d), FROM, TO), S.HARD, NOW).target.select("business_key", "cursor")


@query("SELECT strftime(TIMESTAMP '2024-02-01', '%Y%m') AS shard_month, count(*) AS rows FROM gone HAVING count(*) > 0", DELETED)
def deletion_log_months(spark, d):
    from ..sources.tables import month_counts

    old = state(spark, d)
    return month_counts(S.apply_deletions(old, old, S.deleted_keys(old, X.source_keys(spark, d), FROM, TO), S.SOFT, NOW, dry_run=True).log, "deleted_time")


@query(
    "SELECT business_key, op, l_partkey, turn FROM (SELECT business_key, l_partkey, turn, last_value(CASE WHEN op <> 'S' THEN op END IGNORE NULLS) OVER (PARTITION BY business_key ORDER BY cursor, l_partkey, l_suppkey, turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS op FROM classified) WHERE op IS NOT NULL",
    ALL,
)
def change_log(spark, d):
    log = S.change_log(S.classify(incoming(spark, d), state(spark, d)), COLUMNS, NOW)
    return log.select("business_key", "op", F.get_json_object("after", "$.l_partkey").cast("long").alias("l_partkey"), "seq.turn")


@query(
    "SELECT count(*) AS read, count(*) FILTER (op = 'I') AS inserted, count(*) FILTER (op = 'U') AS updated, count(*) FILTER (op = 'S') AS skipped, max(cursor) AS max_cursor FROM classified",
    (X.INCOMING.replace("incoming AS", "every AS"), STATE.replace("FROM incoming", "FROM every"), f"incoming AS (SELECT * FROM every WHERE {WINDOWED})", CLASSIFIED),
)
def sync_batch_result(spark, d):
    old = state(spark, d)
    source = X.incoming(spark, d)
    target = source.filter("seq.turn = 0").select("business_key", "l_partkey", "quantity").dropDuplicates(["business_key"])
    return S.run_batch(source, old, target, X.source_keys(spark, d), COLUMNS, FROM, TO, NOW).result.drop("deleted")


LEDGER = "steps AS (SELECT batch_id, 1 AS status, window_end AS moment FROM sync_batches UNION ALL SELECT batch_id, 2, started_time FROM sync_batches UNION ALL SELECT batch_id, CASE WHEN status = 4 THEN 4 ELSE 3 END, completed_time FROM sync_batches WHERE completed_time IS NOT NULL)"


@query("SELECT batch_id, CAST(arg_max(status, (moment, status)) AS INTEGER) AS status, min(moment) AS created_time, max(moment) AS changed_time FROM steps GROUP BY batch_id", (X.SYNC_BATCHES, LEDGER))
def batch_ledger(spark, d):
    b = X.sync_batches(spark, d)
    done = F.when(F.col("status") == V.BATCH_FAILED, V.BATCH_FAILED).otherwise(V.BATCH_COMPLETED)
    events = b.select("batch_id", F.explode(F.array(F.struct(F.lit(V.BATCH_PENDING).alias("status"), F.col("window_end").alias("at")), F.struct(F.lit(V.BATCH_RUNNING).alias("status"), F.col("started_time").alias("at")), F.struct(done.alias("status"), F.col("completed_time").alias("at")))).alias("e"))
    return S.batch_ledger(events.select("batch_id", "e.*").filter("at IS NOT NULL"))


# Projection: order lines that come as source rows, some of them new.
SOURCE = """source AS (SELECT CASE WHEN l_partkey % 31 = 0 THEN NULL WHEN l_partkey % 5 = 0 THEN 'N' || l_orderkey ELSE l_orderkey || '-' || l_linenumber END AS k, l_shipdate AS t, ' V' || (l_suppkey % 9) AS wave,
  'B' || l_partkey AS code, CASE WHEN l_suppkey % 8 > 0 THEN 'R' || l_orderkey END AS rid, (l_shipdate, l_partkey, l_suppkey, l_linenumber) AS seq FROM lineitem),
given AS (SELECT * FROM source WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq DESC) = 1)"""
LINES = P.Projection("LINES", V.SPLIT, "k", "t", {"wave_code": "wave", "barcode": "code"})


def source(spark, d):
    line = X.load(spark, d, "lineitem")
    key = F.when(F.col("l_partkey") % 31 == 0, None).when(F.col("l_partkey") % 5 == 0, F.concat(F.lit("N"), "l_orderkey")).otherwise(F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return line.select(
        key.alias("k"),
        F.col("l_shipdate").alias("t"),
        F.concat(F.lit(" V"), F.col("l_suppkey") % 9).alias("wave"),
        F.concat(F.lit("B"), "l_partkey").alias("code"),
        F.when(F.col("l_suppkey") % 8 > 0, F.concat(F.lit("R"), "l_orderkey")).alias("rid"),
        F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber").alias("seq"),
    )


@query("SELECT k AS business_key, t AS created_time, trim(wave) AS wave_code, code AS barcode, 'LINES' AS source_table_code FROM given", (SOURCE,))
def project_rows(spark, d):
    good, _ = P.project(P.last_of_batch(source(spark, d).filter("k IS NOT NULL"), ("k",), "seq"), LINES, NOW)
    return good.select("business_key", "created_time", "wave_code", "barcode", "source_table_code")


@query("SELECT k AS business_key, 'key too long' AS reason FROM given WHERE length(k) > 6", (SOURCE,))
def project_rejects(spark, d):
    short = P.Projection("LINES", V.SPLIT, "k", "t", {}, key_length=6)
    return P.project(P.last_of_batch(source(spark, d).filter("k IS NOT NULL"), ("k",), "seq"), short, NOW)[1]


UPSERTED = """upserted AS (SELECT coalesce(o.business_key, g.k) AS business_key, CASE WHEN g.k IS NOT NULL THEN trim(g.wave) ELSE o.wave_code END AS wave_code, coalesce(o.status, 1) AS status,
  CASE WHEN o.business_key IS NULL THEN g.code ELSE o.barcode END AS barcode, coalesce(o.created_time, g.t) AS created_time, CASE WHEN o.business_key IS NULL THEN 'I' WHEN g.k IS NOT NULL THEN 'U' END AS change
  FROM tasks o FULL JOIN given g ON o.business_key = g.k)"""


@query("SELECT * FROM upserted", (X.TASKS, SOURCE, UPSERTED))
def projection_upsert(spark, d):
    good, _ = P.project(P.last_of_batch(source(spark, d).filter("k IS NOT NULL"), ("k",), "seq"), LINES, NOW)
    return P.upsert(X.tasks(spark, d), good).select("business_key", "wave_code", "status", "barcode", "created_time", "change")


FEW = """few AS (SELECT * FROM given WHERE t >= TIMESTAMP '1997-06-01' AND t < TIMESTAMP '1997-06-08'),
touched AS (SELECT shard_month FROM tasks JOIN few ON business_key = k UNION SELECT strftime(t, '%Y%m') FROM few),
updated AS (SELECT coalesce(o.business_key, g.k) AS business_key, CASE WHEN g.k IS NOT NULL THEN trim(g.wave) ELSE o.wave_code END AS wave_code, coalesce(o.shard_month, strftime(g.t, '%Y%m')) AS shard_month,
  CASE WHEN o.business_key IS NULL THEN 'I' WHEN g.k IS NOT NULL THEN 'U' END AS change
  FROM (SELECT * FROM tasks WHERE shard_month IN (SELECT shard_month FROM touched)) o FULL JOIN few g ON o.business_key = g.k)"""


@query("SELECT * FROM updated", (X.TASKS, SOURCE, FEW))
def months_upserted(spark, d):
    """What the source rows of a week make of the months that they touch."""
    good, _ = P.project(P.last_of_batch(source(spark, d).filter("k IS NOT NULL"), ("k",), "seq"), LINES, NOW)
    week = good.filter("created_time >= '1997-06-01' AND created_time < '1997-06-08'")
    return P.upsert_months(X.tasks(spark, d), week)[1].select("business_key", "wave_code", "shard_month", "change")


@query("SELECT count(*) FILTER (change = 'I') AS inserted, count(*) FILTER (change = 'U') AS updated, count(change) AS affected FROM upserted", (X.TASKS, SOURCE, UPSERTED))
def projection_counts(spark, d):
    good, _ = P.project(P.last_of_batch(source(spark, d).filter("k IS NOT NULL"), ("k",), "seq"), LINES, NOW)
    return P.upsert_counts(P.upsert(X.tasks(spark, d), good))


@query("SELECT count(*) AS read, count(k) AS appended, count(*) FILTER (k IS NULL) AS skipped, count(*) FILTER (k IS NOT NULL AND rid IS NULL) AS without_id, false AS moves_cursor FROM source", (SOURCE,))
def consume_counts(spark, d):
    return P.consume(source(spark, d), X.tasks(spark, d), LINES, "rid", "seq", "DONE", "b1", NOW).counts


@query("SELECT DISTINCT rid AS row_id, 'DONE' AS new_status, TIMESTAMP '2024-02-01' AS done_at, 'b1' AS batch_id FROM source WHERE k IS NOT NULL AND rid IS NOT NULL", (SOURCE,))
def consume_write_back(spark, d):
    return P.consume(source(spark, d), X.tasks(spark, d), LINES, "rid", "seq", "DONE", "b1", NOW).write_back


@query("SELECT business_key, resolved_dock_code, normalized_wave_code, normalized_barcode FROM tasks")
def derived_fields(spark, d):
    stale = X.tasks(spark, d).drop("resolved_dock_code", "normalized_wave_code", "normalized_barcode")
    return P.refresh(stale).select("business_key", "resolved_dock_code", "normalized_wave_code", "normalized_barcode")

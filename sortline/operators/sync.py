"""Keyed sync: classify, merge, detect deletions, log. Every step is a function from tables to tables; jobs write what they give."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed as V
from ..sources.scans import incremental
from ..sources.versions import Commit, Store, retried

INSERT, UPDATE, SKIP, DELETE = "I", "U", "S", "D"
DISABLED, SOFT, HARD = "disabled", "soft", "hard"


def sync_window(definitions: DataFrame, checkpoints: DataFrame, now) -> DataFrame:
    """table_code, window_start and window_end of the next run. The window starts at the checkpoint's cursor or else the configured start; it ends `lag_minutes`
    before now, or before the last success if the clock went back, and never before its start."""
    at = C.ntz(now)
    rows = definitions.join(checkpoints, "table_code", "left")
    start = F.coalesce("last_cursor", "start_time")
    clock = F.greatest(at, F.coalesce("last_success", at))
    end = clock - F.make_dt_interval(mins=F.col("lag_minutes"))
    return rows.select("table_code", "priority", start.alias("window_start"), F.greatest(start, end).alias("window_end"))


def with_digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.withColumn("digest", C.row_digest(*columns))


def _key(df: DataFrame) -> Column:
    """What keys are compared by. classify() leaves it in its rows, which are dealt by it, so that what follows needn't deal them anew."""
    return F.col("match_key") if "match_key" in df.columns else C.key_text("business_key")


def classify(incoming: DataFrame, state: DataFrame) -> DataFrame:
    """incoming (business_key, digest, seq, ...) with match_key, op and is_last. The first row of a key is held against the state, each later one against the row before it:
    insert if there is none, skip if digests agree, else update. Rows with a blank key are dropped. Keys are compared ignoring case."""
    keyed = incoming.filter(C.blank_to_null("business_key").isNotNull()).withColumn("match_key", C.key_text("business_key"))
    old = state.select(C.key_text("business_key").alias("match_key"), F.col("digest").alias("old_digest"))
    order = Window.partitionBy("match_key").orderBy("seq")
    before = F.coalesce(F.lag("digest").over(order), F.col("old_digest"))
    last = F.lead(F.lit(1)).over(order).isNull()
    joined = keyed.join(old, "match_key", "left")
    op = F.when(F.col("before").isNull(), INSERT).when(F.col("before") == F.col("digest"), SKIP).otherwise(UPDATE)
    return joined.withColumns({"before": before, "is_last": last}).withColumn("op", op).drop("before", "old_digest")


def merge_counts(classified: DataFrame) -> DataFrame:
    count = lambda op: F.count_if(F.col("op") == op).cast("long")
    return classified.agg(
        F.count("*").cast("long").alias("read"), count(INSERT).alias("inserted"), count(UPDATE).alias("updated"), count(SKIP).alias("skipped"), F.max("cursor").alias("max_cursor")
    )


def last_rows(classified: DataFrame) -> DataFrame:
    """The row of each key that stays, if it changed anything."""
    changed = F.max(F.col("op") != SKIP).over(Window.partitionBy(_key(classified)))
    return classified.withColumn("changed", changed).filter("is_last AND changed").drop("changed", "op", "is_last")


def month_for_cursor(cursor: Column, now, months_ahead: int) -> Column:
    """Month where a row is kept: that of its cursor from the current month up to `months_ahead` later, else the current."""
    at = C.ntz(now)
    ahead = F.months_between(F.trunc(cursor, "MM"), F.trunc(at, "MM"))
    return F.when(ahead.between(0, months_ahead), C.month_key(cursor)).otherwise(C.month_key(at))


def merge_state(state: DataFrame, rows: DataFrame, now, months_ahead: int = 1) -> DataFrame:
    """The state after a batch: business_key, digest, cursor, shard_month, is_soft_deleted, updated_time. A row that comes again isn't deleted any more."""
    new = rows.select(
        _key(rows).alias("key"),
        F.struct(
            "business_key", "digest", "cursor", month_for_cursor(F.col("cursor"), now, months_ahead).alias("shard_month"), F.lit(False).alias("is_soft_deleted"), C.ntz(now).alias("updated_time")
        ).alias("new"),
    )
    old = state.select(C.key_text("business_key").alias("key"), F.struct(*(F.col(c) for c in ("business_key", "digest", "cursor", "shard_month", "is_soft_deleted", "updated_time"))).alias("old"))
    return old.join(new, "key", "full").select(F.coalesce("new", "old").alias("s")).select("s.*")


def latest_state(state: DataFrame) -> DataFrame:
    """One state row for each key: the last one written, whatever its month."""
    return C.first_of(state.withColumn("key", C.key_text("business_key")), ["key"], F.desc("updated_time"), F.desc("shard_month")).drop("key")


def moved_keys(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys whose row changed its month: deleted in old_month, written in new_month."""
    old = before.select(C.key_text("business_key").alias("key"), F.col("shard_month").alias("old_month"))
    new = after.select(C.key_text("business_key").alias("key"), "business_key", F.col("shard_month").alias("new_month"))
    return new.join(old, "key").filter("old_month <> new_month").select("business_key", "old_month", "new_month")


def merge_table(target: DataFrame, rows: DataFrame, key: str = "business_key") -> DataFrame:
    """Rows of the target replaced by those of equal key, and the others added."""
    columns = target.columns
    old = target.select(C.key_text(key).alias("k"), F.struct(*columns).alias("old"))
    new = rows.select(C.key_text(key).alias("k"), F.struct(*columns).alias("new"))
    return old.join(new, "k", "full").select(F.coalesce("new", "old").alias("r")).select("r.*")


def touched_months(target: DataFrame, rows: DataFrame, key: str = "business_key") -> list[str]:
    """Months that a merge of rows (with the shard_month that each goes to) changes: those that hold rows of their keys now, found by keys alone, and those they go to.
    A table has few months."""
    keys = rows.select(C.key_text(key).alias("k")).distinct()
    held = target.select(C.key_text(key).alias("k"), "shard_month").join(keys, "k", "left_semi").select("shard_month")
    return sorted(r[0] for r in held.unionByName(rows.select("shard_month")).distinct().collect())


def merge_months(target: DataFrame, rows: DataFrame, key: str = "business_key") -> tuple[list[str], DataFrame]:
    """(months, their rows after the merge), to be written in place of those months; all other months stay as they are and aren't read but for keys. A row whose
    month changed leaves the old one, as both are among the months."""
    months = touched_months(target, rows, key)
    return months, merge_table(target.filter(F.col("shard_month").isin(months)), rows, key)


def delete_keys(target: DataFrame, keys: DataFrame, key: str = "business_key") -> DataFrame:
    gone = keys.select(C.key_text(key).alias("gone")).distinct()
    return target.join(gone, C.key_text(target[key]) == F.col("gone"), "left_anti")


def deleted_keys(state: DataFrame, source_keys: DataFrame, start, end) -> DataFrame:
    """State rows with a cursor in (start, end] whose key the source lacks; soft-deleted ones are found again."""
    window = state.filter((F.col("cursor") > C.ntz(start)) & (F.col("cursor") <= C.ntz(end)))
    there = source_keys.select(C.key_text("business_key").alias("there")).distinct()
    return window.join(there, C.key_text(window["business_key"]) == F.col("there"), "left_anti")


@dataclass(frozen=True)
class Deletion:
    state: DataFrame
    target: DataFrame
    log: DataFrame


def apply_deletions(state: DataFrame, target: DataFrame, keys: DataFrame, mode: str, now, dry_run: bool = False) -> Deletion:
    """Tables after a deletion and its log. soft: only the state is marked; hard: state and target lose the rows; disabled or a dry run: no change, and
    disabled logs nothing."""
    log = keys.select("business_key", F.lit(DELETE).alias("op"), F.lit(mode).alias("mode"), F.lit(dry_run).alias("dry_run"), C.ntz(now).alias("deleted_time"), F.to_json(F.struct("business_key", "digest", "cursor")).alias("before"))
    if mode == DISABLED:
        return Deletion(state, target, log.limit(0))
    if dry_run:
        return Deletion(state, target, log)
    if mode == HARD:
        return Deletion(delete_keys(state, keys), delete_keys(target, keys), log)
    gone = keys.select(C.key_text("business_key").alias("gone"), F.lit(True).alias("hit")).distinct()
    marked = state.join(gone, C.key_text(state["business_key"]) == F.col("gone"), "left")
    hit = F.coalesce("hit", F.lit(False))
    marked = marked.withColumns({"is_soft_deleted": hit | F.col("is_soft_deleted"), "updated_time": F.when(hit, C.ntz(now)).otherwise(F.col("updated_time"))}).drop("gone", "hit")
    return Deletion(marked, target, log)


def change_log(classified: DataFrame, columns: list[str], now) -> DataFrame:
    """A row for every incoming row whose key changed in the batch, skipped ones too, all with the key's last operation that isn't a skip."""
    by_key = Window.partitionBy(_key(classified))
    final = F.max_by("op", F.when(F.col("op") != SKIP, F.col("seq"))).over(by_key)
    rows = classified.withColumn("final_op", final).filter(F.col("final_op").isNotNull())
    return rows.select("business_key", F.col("final_op").alias("op"), "seq", F.to_json(F.struct(*columns)).alias("after"), C.ntz(now).alias("changed_time"))


def batch_ledger(events: DataFrame) -> DataFrame:
    """Current status of every batch from its status events (batch_id, status, at): the furthest of the latest."""
    return events.groupBy("batch_id").agg(F.max_by("status", F.struct("at", "status")).alias("status"), F.min("at").alias("created_time"), F.max("at").alias("changed_time"))


@dataclass(frozen=True)
class Batch:
    """What a sync run gives. checkpoint and result have one row."""

    state: DataFrame
    target: DataFrame
    changes: DataFrame
    deletions: DataFrame
    result: DataFrame
    checkpoint: DataFrame


def run_batch(source: DataFrame, state: DataFrame, target: DataFrame, keys: DataFrame, columns: list[str], start, end, now, deletion: str = SOFT, table_code: str = "T") -> Batch:
    """One sync of (start, end]: read, classify, merge, delete, log, checkpoint. source: business_key, cursor, seq and `columns`."""
    rows = classify(with_digest(incremental(source, "cursor", start, end), columns), state)
    new = last_rows(rows)
    merged = merge_state(state, new, now)
    gone = deleted_keys(merged, keys, start, end)
    after = merge_table(target, new.select(*target.columns))
    done = apply_deletions(merged, after, gone, deletion, now)
    result = merge_counts(rows).crossJoin(done.log.agg(F.count("*").cast("long").alias("deleted")))  # one row each
    checkpoint = result.select(
        F.lit(table_code).alias("table_code"), F.coalesce("max_cursor", C.ntz(start)).alias("last_cursor"), C.ntz(now).alias("last_success"), F.lit(None).cast("string").alias("last_error")
    )
    return Batch(done.state, done.target, change_log(rows, columns, now), done.log, result, checkpoint)


#: Tables of a sync store. The logs are by the month of their time.
STATE, TARGET, CHANGES, DELETIONS, BATCHES = "state", "target", "changes", "deletions", "batches"
KEY = "key"
LEDGER = "batch_id string, table_code string, status int, at timestamp_ntz, window_start timestamp_ntz, window_end timestamp_ntz, read long, inserted long, updated long, skipped long, deleted long, error string"


def open_sync(store: Store, state: DataFrame, target: DataFrame) -> Commit:
    """The first commit of a store for sync runs: a state and a target by month, and no logs yet."""
    attempt = store.attempt()
    attempt.replace(STATE, state, keys=_state_keys())
    attempt.replace(TARGET, target)
    return attempt.commit({"runs": {}})


def _state_keys() -> dict[str, Column]:
    return {KEY: C.key_text("business_key")}


def checkpoints(store: Store) -> DataFrame:
    """table_code, last_cursor, last_success and last_error of the runs so far, as sync_window() reads them."""
    runs = store.last().info.get("runs", {})
    time = lambda t: t and datetime.fromisoformat(t)
    rows = [(code, time(r["last_cursor"]), time(r["last_success"]), r["last_error"]) for code, r in sorted(runs.items())]
    return store.spark.createDataFrame(rows, "table_code string, last_cursor timestamp_ntz, last_success timestamp_ntz, last_error string")


def sync_months(
    source: DataFrame, store: Store, keys: DataFrame, columns: list[str], start, end, now, batch_id: str, deletion: str = SOFT, table_code: str = "T", months_ahead: int = 1
) -> Batch:
    """run_batch() on the tables by month of a store. State, target, logs and cursor change in one commit, so a run that dies at any step has changed nothing, and comes again as a whole;
    a batch that was committed last of its table does nothing. If another run was committed meanwhile it raises Conflict, and the batch has to be run again.

    Only months that hold a changed or deleted key, before or after, are rewritten. Filters tell which months may hold keys of the batch, so the others' keys aren't read, but for those
    whose cursors are in the window, where deletions are looked for. The batch is classified once: its rows are staged, and the counts come with that write.
    """
    base = store.last()
    run = base.info.get("runs", {}).get(table_code)
    if run and run["batch_id"] == batch_id and run["last_error"] is None:
        return _batch_of(store, base, table_code, batch_id)
    attempt, spark = store.attempt(base), store.spark
    fresh = with_digest(incremental(source, "cursor", start, end), columns)
    batch_keys = fresh.select(C.key_text("business_key").alias(KEY)).distinct()
    near = store.months_that_may_hold(STATE, KEY, batch_keys, base)
    seen = Observation()
    of = lambda op: F.count_if(F.col("op") == op).alias(op)
    classified = classify(fresh, store.read(STATE, near, base)).observe(seen, F.count(F.lit(1)).alias("read"), *map(of, (INSERT, UPDATE, SKIP)), F.max("cursor").alias("max_cursor"))
    rows = attempt.stage(classified, "rows")
    counts = seen.get
    new = attempt.stage(last_rows(rows).withColumn("shard_month", month_for_cursor(F.col("cursor"), now, months_ahead)), "new")
    slim = ("business_key", "digest", "cursor", "shard_month")
    # rows of keys that come anew have their new cursor; of the others those of the window are looked up in the source
    known = store.read(STATE, at=base).filter((F.col("cursor") > C.ntz(start)) & (F.col("cursor") <= C.ntz(end)))
    gone = attempt.stage(deleted_keys(delete_keys(known.select(*slim), new).unionByName(new.select(*slim)), keys, start, end), "gone")
    touched = touched_months(store.read(STATE, near, base), new.select(*slim)) if near else sorted(r[0] for r in new.select("shard_month").distinct().collect())
    touched = sorted({*touched, *(r[0] for r in gone.select("shard_month").distinct().collect())})  # a table has few months
    part, held = store.read(STATE, touched, base), store.read(TARGET, touched, base)
    done = apply_deletions(merge_state(part, new, now, months_ahead), merge_table(held, new.select(*held.columns)), gone, deletion, now)
    attempt.replace(TARGET, done.target, touched)
    attempt.replace(STATE, done.state, touched, _state_keys())
    attempt.append(CHANGES, change_log(rows, columns, now).withColumn("batch_id", F.lit(batch_id)).drop("seq"), C.month_key("changed_time"))
    deleted = Observation()
    log = done.log.withColumn("batch_id", F.lit(batch_id)).observe(deleted, F.count(F.lit(1)).alias("deleted"))
    attempt.append(DELETIONS, log, C.month_key("deleted_time"))
    figures = {"read": counts["read"], "inserted": counts[INSERT], "updated": counts[UPDATE], "skipped": counts[SKIP], "deleted": deleted.get["deleted"]}
    cursor = counts["max_cursor"]
    ledger = [(V.BATCH_PENDING, {}, None), (V.BATCH_RUNNING, {}, None), (V.BATCH_COMPLETED, figures, None)]
    attempt.append(BATCHES, _ledger(spark, ledger, batch_id, table_code, start, end, now), C.month_key("at"))
    run = {"batch_id": batch_id, "last_cursor": str(cursor or start), "last_success": str(now), "last_error": None, "max_cursor": cursor and str(cursor), "months": touched, **figures}
    made = attempt.commit({"runs": base.info.get("runs", {}) | {table_code: run}})
    return _batch_of(store, made, table_code, batch_id)


def _batch_of(store: Store, commit: Commit, table_code: str, batch_id: str) -> Batch:
    """What a committed run gave."""
    run, spark = commit.info["runs"][table_code], store.spark
    time = lambda t: t and datetime.fromisoformat(t)
    result = spark.createDataFrame([(*(run[k] for k in FIGURES[:4]), time(run["max_cursor"]), run["deleted"])], "read long, inserted long, updated long, skipped long, max_cursor timestamp_ntz, deleted long")
    checkpoint = spark.createDataFrame([(table_code, time(run["last_cursor"]), time(run["last_success"]), run["last_error"])], CHECKPOINT)
    of_batch = lambda t: store.read(t, at=commit).filter(F.col("batch_id") == batch_id).drop("batch_id")
    return Batch(store.read(STATE, at=commit), store.read(TARGET, at=commit), of_batch(CHANGES), of_batch(DELETIONS), result, checkpoint)


FIGURES = ("read", "inserted", "updated", "skipped", "deleted")
CHECKPOINT = "table_code string, last_cursor timestamp_ntz, last_success timestamp_ntz, last_error string"


def _ledger(spark, steps: list[tuple[int, dict, str | None]], batch_id: str, table_code: str, start, end, now) -> DataFrame:
    time = lambda t: datetime.fromisoformat(str(t))
    rows = [(batch_id, table_code, status, time(now), time(start), time(end), *(figures.get(k) for k in FIGURES), error) for status, figures, error in steps]
    return spark.createDataFrame(rows, LEDGER)


def sync_job(source: DataFrame, store: Store, keys: DataFrame, columns: list[str], definition: DataFrame, now, batch_id: str, deletion: str = SOFT, months_ahead: int = 1) -> Batch | None:
    """The run of a table by its definition (one row: table_code, priority, lag_minutes, start_time): its window begins at the stored cursor. A run that fails keeps cursor and tables, and is
    recorded with its error; the next one reads the same window. An empty window is no run. A batch that was committed gives what it gave."""
    code = definition.first()["table_code"]
    run = store.last().info.get("runs", {}).get(code)
    if run and run["batch_id"] == batch_id and run["last_error"] is None:
        return _batch_of(store, store.last(), code, batch_id)
    window = sync_window(definition, checkpoints(store), now).first()
    start, end = window["window_start"], window["window_end"]
    if not start < end:
        return None
    try:
        return sync_months(source, store, keys, columns, start, end, now, batch_id, deletion, code, months_ahead)
    except Exception as e:
        record_failure(store, code, batch_id, start, end, now, f"{type(e).__name__}: {e}")
        raise


def record_failure(store: Store, table_code: str, batch_id: str, start, end, now, error: str) -> Commit:
    """A batch that failed, in the ledger and beside the cursor, which stays."""
    said = "".join(c for c in error if c.isprintable())[:512]

    def change(attempt):
        runs = attempt.base.info.get("runs", {})
        old = runs.get(table_code) or {"last_cursor": str(start), "last_success": None, "max_cursor": None, **dict.fromkeys(FIGURES, 0)}
        steps = [(V.BATCH_PENDING, {}, None), (V.BATCH_RUNNING, {}, None), (V.BATCH_FAILED, {}, said)]
        attempt.append(BATCHES, _ledger(store.spark, steps, batch_id, table_code, start, end, now), C.month_key("at"))
        return {"runs": runs | {table_code: old | {"batch_id": batch_id, "last_error": said}}}

    return retried(store, change)


def failed_checkpoint(checkpoint: DataFrame, error: str) -> DataFrame:
    """A failed run keeps the cursor and records why."""
    return checkpoint.withColumn("last_error", F.lit(error))

"""Wave cleanup, feedback and retention."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed as V
from ..sources.sinks import ROUTES, feedback_write_back
from ..sources.tables import LEGACY, read_months
from ..sources.versions import Store, retried
from .search import newest_by

#: A claim older than this may be claimed again.
STALE = timedelta(minutes=10)


def clean_wave(tasks: DataFrame, wave: str, status: int, now, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """(tasks, audit row): cleanable tasks of a wave get the status. A dry run only counts."""
    hit = F.coalesce(C.key_text(C.normalized_wave()) == wave.strip().upper(), F.lit(False)) & C.is_cleanable()
    audit = tasks.filter(C.key_text(C.normalized_wave()) == wave.strip().upper()).agg(
        F.lit(wave.strip()).alias("wave_code"),
        F.lit(dry_run).alias("dry_run"),
        F.count("*").cast("long").alias("found"),
        F.count_if(hit).cast("long").alias("cleanable"),
        F.when(F.lit(dry_run), 0).otherwise(F.count_if(hit)).cast("long").alias("cleaned"),
        F.lit("completed").alias("outcome"),
        C.ntz(now).alias("started_time"),
    )
    if dry_run:
        return tasks, audit
    new = {"status": F.lit(status), "updated_time": C.ntz(now)} | ({"is_exception": F.lit(True)} if status == V.EXCEPTION else {})
    return tasks.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()}), audit


def audit_failed(audit: DataFrame, error: str) -> DataFrame:
    return audit.withColumns({"outcome": F.lit("failed"), "cleaned": F.lit(0).cast("long"), "error": C.clean_text(F.lit(error), 512)})


def claim_feedback(tasks: DataFrame, status: int, n: int, now) -> DataFrame:
    """The n oldest tasks to report: those in the status, and those claimed longer ago than ten minutes."""
    at = datetime.fromisoformat(str(now)) - STALE
    due = (F.col("feedback_status") == status) | ((F.col("feedback_status") == V.PROCESSING) & (F.col("updated_time") < C.ntz(at)))
    return tasks.filter(due).orderBy("created_time", "id").limit(n)


def claim_by_code(tasks: DataFrame, task_code: str, status: int, now) -> DataFrame:
    """The claim of a single task: the newest of its code, and none if that isn't due, even where an older one is."""
    return claim_feedback(newest_by(tasks.filter(F.col("task_code") == task_code), "task_code"), status, 1, now)


def mark_claimed(tasks: DataFrame, claimed: DataFrame, now) -> DataFrame:
    return _mark(tasks, claimed, {"feedback_status": F.lit(V.PROCESSING), "updated_time": C.ntz(now)})


def finish_feedback(tasks: DataFrame, claimed: DataFrame, written: int | None, now) -> DataFrame:
    """Claimed tasks are completed if as many rows were written, else all failed; None stands for a write that failed."""
    return _finished(tasks, claimed, written is not None and written == claimed.count(), now)


def _finished(tasks: DataFrame, claimed: DataFrame, done: bool, now) -> DataFrame:
    new = {"feedback_status": F.lit(V.COMPLETED if done else V.FAILED), "updated_time": C.ntz(now)}
    if done:
        new |= {"is_feedback_reported": F.lit(True), "feedback_time": C.ntz(now)}
    return _mark(tasks, claimed, {c: v for c, v in new.items() if c in tasks.columns})


@dataclass(frozen=True)
class Feedback:
    """tasks after the run and one row of result: claimed, written, succeeded, failed, skipped, failure."""

    tasks: DataFrame
    result: DataFrame


def report_feedback(tasks: DataFrame, write: Callable[[DataFrame], int], now, n: int = 100, status: int = V.PENDING, task_code: str | None = None) -> Feedback:
    """Claim, write back, finish, as a plan over tasks that aren't stored: feedback_run() is for tables that are. status: pending for the run of a day, failed for a retry; task_code: of one task alone, which is skipped if it isn't due. write() gets
    the rows for the targets and gives how many were written. A write that fails, or that writes another number, makes all claimed tasks failed. The claim is of n rows at most
    and taken once, so that what is written is what is finished."""
    found = claim_feedback(tasks, status, n, now) if task_code is None else claim_by_code(tasks, task_code.strip(), status, now)
    spark, keys = tasks.sparkSession, ["id", "shard_month"]
    taken = spark.createDataFrame(found.select(*keys).collect(), found.select(*keys).schema)
    count = taken.count()
    skipped = int(task_code is not None and not count)
    written, failure = 0, None
    if count:
        rows = mark_claimed(tasks, taken, now).join(F.broadcast(taken), keys, "left_semi")
        try:
            written = write(feedback_write_back(rows, ROUTES, {"chute": "actual_chute_code", "at": "scanned_at"}))
            failure = None if written == count else f"{written} rows written, {count} claimed"
        except Exception as e:
            written, failure = None, f"write-back failed: {type(e).__name__}"
    after = finish_feedback(tasks, taken, written, now) if count else tasks
    return Feedback(after, _result(spark, count, written or 0, 0 if failure else count, count if failure else 0, skipped, failure))


def feedback_run(store: Store, write: Callable[[DataFrame], int], now: Callable[[], object], n: int = 100, status: int = V.PENDING, task_code: str | None = None, table: str = "rows") -> DataFrame:
    """report_feedback() on a stored table of tasks by month: the row of its result. The claim is a commit of its own before anything is written outside, made only if its base is still
    the last commit, so two runs never have a row in common. Finishing is another, which touches just the rows that this run still has: those in processing since its own claim. A
    driver that is lost in between leaves rows in processing, and they can be claimed again after ten minutes, by when they may be written outside a second time. now() is asked for the
    time of the claim and of the end; a claim's time has to be its own, so a run whose time was taken by another claims a microsecond later."""
    spark, keys, taken = store.spark, ["id", "shard_month"], {}

    def claim(attempt):
        base = attempt.base
        times = base.info.get("claims", [])
        at = datetime.fromisoformat(str(now()))
        while str(at) in times:
            at += timedelta(microseconds=1)
        rows = store.read(table, at=base)
        found = claim_feedback(rows, status, n, at) if task_code is None else claim_by_code(rows, task_code.strip(), status, at)
        picked = found.select(*keys).collect()  # n rows at most
        taken.update(at=at, rows=picked)
        if not picked:
            return None
        months = sorted({r["shard_month"] for r in picked})
        some = spark.createDataFrame(picked, found.select(*keys).schema)
        attempt.replace(table, mark_claimed(store.read(table, months, base), some, at), months)
        old = str(at - 2 * STALE)
        return {"claims": [*(t for t in times if t > old), str(at)]}

    held = retried(store, claim)
    count, at = len(taken["rows"]), taken["at"]
    if not count:
        return _result(spark, 0, 0, 0, 0, int(task_code is not None), None)
    months = sorted({r["shard_month"] for r in taken["rows"]})
    some = spark.createDataFrame(taken["rows"], "id long, shard_month string")
    rows = store.read(table, months, held).join(F.broadcast(some), keys, "left_semi")
    try:
        written = write(feedback_write_back(rows, ROUTES, {"chute": "actual_chute_code", "at": "scanned_at"}))
        failure = None if written == count else f"{written} rows written, {count} claimed"
    except Exception as e:
        written, failure = None, f"write-back failed: {type(e).__name__}"
    done = {}

    def finish(attempt):
        rows = store.read(table, months, attempt.base)
        ours = rows.join(F.broadcast(some), keys, "left_semi").filter((F.col("feedback_status") == V.PROCESSING) & (F.col("updated_time") == C.ntz(at)))
        left = ours.select(*keys).collect()  # n rows at most
        done["rows"] = len(left)
        if not left:
            return None
        # all or none were written, whether or not another run has some of them by now
        some_left = spark.createDataFrame(left, ours.select(*keys).schema)
        attempt.replace(table, _finished(rows, some_left, failure is None, now()), months)
        return {}

    retried(store, finish)
    ended = done["rows"]
    return _result(spark, count, written or 0, 0 if failure else ended, ended if failure else count - ended, 0, failure)


def _result(spark: SparkSession, *values) -> DataFrame:
    return spark.createDataFrame([values], "claimed long, written long, succeeded long, failed long, skipped long, failure string")


def _mark(tasks: DataFrame, some: DataFrame, new: dict) -> DataFrame:
    """tasks with new values where id and month are in `some`, which a claim keeps small. Ids repeat over months."""
    ids = some.select(F.col("id").alias("marked"), F.col("shard_month").alias("marked_month")).distinct()
    rows = tasks.join(ids, (tasks["id"] == F.col("marked")) & (tasks["shard_month"] == F.col("marked_month")), "left")
    return rows.withColumns({c: F.when(F.col("marked").isNotNull(), v).otherwise(F.col(c)) for c, v in new.items()}).drop("marked", "marked_month")


def expired_months(tasks: DataFrame, now, keep_months: int) -> DataFrame:
    """Months before the threshold with their rows; the legacy month never expires."""
    first = C.month_key(C.retention_threshold(C.ntz(now), keep_months))
    return tasks.filter((F.col("shard_month") != LEGACY) & (F.col("shard_month") < first)).groupBy("shard_month").agg(F.count("*").cast("long").alias("rows"))


@dataclass(frozen=True)
class Target:
    """A table under retention."""

    code: str
    table: str
    keep_months: int = 3
    mode: str = "DropShards"
    time: str = "created_time"
    dry_run: bool = False
    allowed: bool = True


@dataclass(frozen=True)
class Retention:
    dropped: list[str]
    months: DataFrame
    audit: DataFrame


AUDIT = (
    "id string, batch_id string, target_code string, logical_table string, retention_mode string, time_column string, keep_months int, is_dry_run boolean, allow_delete boolean, threshold_time timestamp_ntz, "
    "execution_stage string, scanned_count long, candidate_count long, deleted_count long, message string, instance_id string, started_time timestamp_ntz, completed_time timestamp_ntz"
)


def retention_audit(tasks: DataFrame, target: Target, batch_id: str, now, instance: str = "", completed=None, error: str | None = None) -> DataFrame:
    """The audit row of a run over a table by month: months scanned, months that expired, and how many of them were dropped (none in a dry run, where dropping isn't
    allowed, or if it failed). Months without rows aren't there to be counted."""
    first = C.month_key(C.retention_threshold(C.ntz(now), target.keep_months))
    months = tasks.select("shard_month").distinct().agg(F.count("*").cast("long").alias("scanned"), F.count_if((F.col("shard_month") != LEGACY) & (F.col("shard_month") < first)).cast("long").alias("expired"))
    drops = target.allowed and not target.dry_run and error is None
    said = "failed" if error is not None else "dry run" if target.dry_run else "dropped" if target.allowed else "not allowed"
    none = F.lit(0).cast("long")
    return months.select(
        F.concat_ws(":", F.lit(batch_id), F.lit(target.code)).alias("id"),
        F.lit(batch_id).alias("batch_id"),
        F.lit(target.code).alias("target_code"),
        F.lit(target.table).alias("logical_table"),
        F.lit(target.mode).alias("retention_mode"),
        F.lit(target.time).alias("time_column"),
        F.lit(target.keep_months).alias("keep_months"),
        F.lit(target.dry_run).alias("is_dry_run"),
        F.lit(target.allowed).alias("allow_delete"),
        C.retention_threshold(C.ntz(now), target.keep_months).cast("timestamp_ntz").alias("threshold_time"),
        F.lit("Completed" if error is None else "Failed").alias("execution_stage"),
        (F.col("scanned") if error is None else none).alias("scanned_count"),
        (F.col("expired") if error is None else none).alias("candidate_count"),
        (F.col("expired") if drops else none).alias("deleted_count"),
        (F.concat(F.lit(f"{said}: "), "expired", F.lit(" months")) if error is None else C.clean_text(F.lit(error), 512)).alias("message"),
        F.lit(instance).alias("instance_id"),
        C.ntz(now).alias("started_time"),
        C.ntz(now if completed is None else completed).alias("completed_time"),
    )


def drop_months(spark: SparkSession, path: str, now, keep_months: int, dry_run: bool = False, allowed: bool = True, batch_id: str = "", target: Target | None = None) -> Retention:
    """Drop the directories of expired months of a table that is plain directories; retention_run() is for stores, and commits its audit first. A dry run, or where dropping isn't allowed, only counts. months has a row for each expired month, audit one for the run."""
    target = target or Target(path, path, keep_months, dry_run=dry_run, allowed=allowed)
    table = read_months(spark, path)
    found = expired_months(table, now, target.keep_months).collect()  # a row for each month of the table
    audit = retention_audit(table, target, batch_id, now).collect()
    outcome = "dry run" if target.dry_run else "dropped" if target.allowed else "not allowed"
    rows = [(r["shard_month"], r["rows"], outcome) for r in found]
    if outcome == "dropped":
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        for month, _, _ in rows:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(root, f"shard_month={month}"), True)
    months = spark.createDataFrame(rows, "shard_month string, rows long, outcome string")
    return Retention([m for m, _, _ in rows if outcome == "dropped"], months, spark.createDataFrame(audit, AUDIT))


AUDITS = "retention_audit"


def retention_run(store: Store, targets: list[Target], now, batch_id: str, instance: str = "", completed=None) -> DataFrame:
    """Retention over the tables of a store; gives the audit rows of the run. The audit of a target is committed before anything goes (stage Started, or the failure). Dropping its months, or
    deleting its rows by the bounds of its files, and the figures of that are one commit, so months never go without their audit. Kept versions stay readable: rows are
    deleted by Store.prune(), which forgets versions first. A target that fails doesn't stop the others; a dry run, or where deleting isn't allowed, only counts."""
    spark = store.spark
    for target in targets:
        first = _stage(spark, target, batch_id, now, instance)
        retried(store, lambda attempt: attempt.append(AUDITS, first("Started", 0, 0, 0, "", None), C.month_key("started_time")) or {})
        ended = now if completed is None else completed

        def change(attempt):
            drops = target.allowed and not target.dry_run
            months = attempt.base.months(target.table)
            if target.table not in attempt.base.tables:
                raise ValueError(f"no table {target.table}")
            threshold = _threshold(now, target.keep_months)
            said = "dry run" if target.dry_run else "deleted" if target.allowed else "not allowed"
            if target.mode == DROP_SHARDS:
                old = [m for m in months if m != LEGACY and len(m) == 6 and m < f"{threshold:%Y%m}"]
                if drops:
                    attempt.drop(target.table, old)
                scanned, found, gone, unit = len(months), len(old), len(old) if drops else 0, "months"
            elif target.mode == DELETE_ROWS:
                found = store.read(target.table, at=attempt.base).filter(F.col(target.time) < C.ntz(threshold)).count()
                gone = attempt.delete_before(target.table, target.time, threshold)["rows_deleted"] if drops and found else 0
                scanned, unit = 1, "rows"
            else:
                raise ValueError(f"unknown mode {target.mode} of {target.code}")
            attempt.append(AUDITS, first("Completed", scanned, found, gone, f"{said}: {found} {unit}", ended), C.month_key("started_time"))
            return {}

        try:
            retried(store, change)
        except Exception as e:
            error = "".join(c for c in f"{type(e).__name__}: {e}" if c.isprintable())[:512]
            retried(store, lambda attempt: attempt.append(AUDITS, first("Failed", 0, 0, 0, error, ended), C.month_key("started_time")) or {})
    return retention_log(store).filter(F.col("batch_id") == batch_id)


DROP_SHARDS, DELETE_ROWS = "DropShards", "DeleteRows"


def _threshold(now, keep_months: int) -> datetime:
    """First of the oldest month that is kept, the current one counted; three months where none or fewer are asked for."""
    at = datetime.fromisoformat(str(now))
    months = at.year * 12 + at.month - 1 - ((keep_months if keep_months > 0 else 3) - 1)
    return datetime(months // 12, months % 12 + 1, 1)


def _stage(spark: SparkSession, target: Target, batch_id: str, now, instance: str):
    time = lambda t: None if t is None else datetime.fromisoformat(str(t))

    def row(stage: str, scanned: int, found: int, gone: int, message: str, ended) -> DataFrame:
        values = (f"{batch_id}:{target.code}", batch_id, target.code, target.table, target.mode, target.time, target.keep_months, target.dry_run, target.allowed, _threshold(now, target.keep_months))
        return spark.createDataFrame([(*values, stage, scanned, found, gone, message, instance, time(now), time(ended))], AUDIT)

    return row


def retention_log(store: Store) -> DataFrame:
    """An audit row for each run and target as it stands: Started until its end is there."""
    rows = store.read(AUDITS)
    return C.first_of(rows, ["id"], F.desc(F.col("execution_stage") != "Started"), F.desc("completed_time"))


def delete_before(df: DataFrame, time: str, threshold) -> DataFrame:
    """Rows from the threshold on, and those without a time."""
    return df.filter((F.col(time) >= C.ntz(threshold)) | F.col(time).isNull())

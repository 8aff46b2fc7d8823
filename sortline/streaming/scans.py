"""Scan events as a stream: minute counts with a watermark, and scans applied to tasks by micro-batch."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import columns as C
from ..operators.events import apply_folded, brought_by, fold_scans, match_scans, parse_scans, scan_log_rows, scan_state
from ..plans.snapshots import Snapshots, refresh_all
from ..sources import key_filters
from ..sources.versions import Files, MonthTable, retried


def minute_counts(scans: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Scans and matches of each minute of a stream with scan_time and is_matched. A minute is final once the watermark, `late` behind the newest scan, has passed it."""
    stream = scans.withColumn("at", F.col("scan_time").cast("timestamp")).withWatermark("at", late)
    out = stream.groupBy(F.window("at", "1 minute").alias("w")).agg(F.count("*").alias("total"), F.count_if("is_matched").alias("matched"))
    return out.select(F.col("w.start").alias("bucket"), "total", "matched")


BARCODE = "barcode"


def _code() -> Column:
    """A task's barcode as scans look for it."""
    return C.key_text(C.blank_to_null("barcode"))


def scanned_tasks(spark: SparkSession, root: str) -> MonthTable:
    """A task table whose months have a filter of their barcodes, as scans look for them."""
    return MonthTable(spark, root, {BARCODE: _code()})


SCAN_STATE = "scan_state"


def apply_scan_stream(scans: DataFrame, tasks: MonthTable, log_path: str, checkpoint: str, now: Callable[[], object], keep: int = 2, late: str | None = None) -> StreamingQuery:
    """Apply a stream of scans to a task table and write the scan log. A micro-batch looks its barcodes up in the months whose filter may hold one of them (in all months of a table
    without filters), and rewrites those of the tasks that it finds. The newest task of a barcode is in one of these months. Tasks that may have a barcode of the batch are staged, and only these
    are matched and updated; the others are copied where they lie, and no filter is made anew, as a scan gives no task a barcode that it lacks: those that have none aren't found. Delivery is at least once; the commit names the last batch of
    this stream, and the log's folder its batch, so the effect of each is once. The commit lists the months opened and rewritten. Where other jobs commit meanwhile, the batch is made anew.

    late: how far a scan may be behind the newest, such as "10 minutes". Then a scan that is delivered again (by event_id) within that time counts once, scans behind it are dropped, and an older
    scan doesn't overwrite a newer one of an earlier batch: the store keeps where each task's scans stand, until they are further behind than that. Without it each batch is taken as newer
    than those before."""
    table = MonthTable.ROWS
    if late is not None:
        scans = scans.withColumn("__at", F.col("scan_time").cast("timestamp")).withWatermark("__at", late).dropDuplicatesWithinWatermark(["event_id"]).drop("__at")

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        held = []

        def change(attempt):
            base, store = attempt.base, tasks.store
            streams = base.info.get("streams", {})
            told = streams.get(checkpoint, {})
            if told.get("batch", -1) >= number:
                return None
            codes = parse_scans(df).select("code")
            opened = store.months_that_may_hold(table, BARCODE, codes, base)
            asked = key_filters.of_batch(codes).persist()
            held.append(asked)
            near = attempt.stage(key_filters.split(store.read(table, opened, base), _code(), asked)[0], "near")
            matched = match_scans(df, near).persist()
            held.append(matched)
            scan_log_rows(matched).write.mode("overwrite").parquet(f"{log_path}/batch={number}")
            months = sorted(r[0] for r in matched.filter(F.col("task_month").isNotNull()).select("task_month").distinct().collect())  # a table has few
            others = key_filters.split(store.read(table, months, base), _code(), asked)[1]
            rows = near.filter(F.coalesce("shard_month", F.lit("")).isin(months))
            folded = fold_scans(matched, brought_by(df, rows))
            same_keys = {BARCODE}.issuperset(tasks.keys or {})
            newest = told.get("newest")
            if late is None:
                attempt.replace(table, apply_folded(rows, folded, now()).unionByName(others), months, tasks.keys, same_keys=same_keys)
            else:
                state = store.read(SCAN_STATE, months, base) if SCAN_STATE in base.tables else None
                attempt.replace(table, apply_folded(rows, folded, now(), state).unionByName(others), months, tasks.keys, same_keys=same_keys)
                attempt.replace(SCAN_STATE, scan_state(folded, state), months, time="at")
                newest = max(filter(None, (newest, _text(df.agg(F.max("scan_time")).first()[0]))), default=None)
                if newest:
                    behind = df.sparkSession.sql(f"SELECT CAST('{newest}' AS TIMESTAMP_NTZ) - INTERVAL {late}").first()[0]
                    attempt.delete_before(SCAN_STATE, "at", behind)
            return {"streams": streams | {checkpoint: {"batch": number, "opened": opened, "rewritten": months, "newest": newest}}}

        retried(tasks.store, change)
        tasks.prune(keep)
        for d in [df, *held]:
            d.unpersist()

    return scans.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _text(time) -> str | None:
    return None if time is None else time.isoformat(" ", "microseconds")


class SnapshotStore:
    """Snapshots as they were stored last, with what they cover, so that a restart goes on from there. A version is there once its state is."""

    PARTS = ("tasks", "waves", "scans")

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self.files.names("state") if n.isdigit())

    def state(self) -> dict | None:
        known = self.versions()
        return self.files.read(f"state/{known[-1]}") if known else None

    def read(self) -> Snapshots | None:
        state = self.state()
        if state is None:
            return None
        time = datetime.fromisoformat
        parts = (self.spark.read.parquet(f"{self.files.root}/data/{self.versions()[-1]}/{p}") for p in self.PARTS)
        return Snapshots(*parts, (time(state["start"]), time(state["end"])), time(state["last_refresh"]))

    def write(self, s: Snapshots, batch: str = "", keep: int = 2) -> None:
        version = (self.versions() or [0])[-1] + 1
        self.files.delete(f"data/{version}")
        for p in self.PARTS:
            getattr(s, p).write.parquet(f"{self.files.root}/data/{version}/{p}")
        self.files.write(f"state/{version}", {"start": str(s.coverage[0]), "end": str(s.coverage[1]), "last_refresh": str(s.last_refresh), "batch": batch})
        for v in self.versions()[:-keep]:
            self.files.delete(f"state/{v}")
            self.files.delete(f"data/{v}")


def refresh_stream(changes: DataFrame, read_tasks: Callable[[], DataFrame], read_logs: Callable[[], DataFrame], store: SnapshotStore, checkpoint: str, now: Callable[[], object]) -> StreamingQuery:
    """Refresh the snapshots at every micro-batch of task changes (created_time), whose minutes are made anew with those that tasks and scans say have changed. A batch that
    comes again does nothing."""

    def batch(df: DataFrame, number: int) -> None:
        name, state = f"{checkpoint}#{number}", store.state()
        if state is None or state["batch"] != name:
            store.write(refresh_all(read_tasks(), read_logs(), store.read(), now(), df), name)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

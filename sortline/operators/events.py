"""Scans and drops applied to tasks, and the rules that read tasks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed as V
from .search import active_tasks, newest_by

#: Measures that a scan brings; a task keeps its own where the scan has none.
MEASURES = ("length_mm", "width_mm", "height_mm", "volume_mm3", "weight_gram")
MAX_BARCODES, MAX_BARCODE_LENGTH = 100, 128


def parse_scans(scans: DataFrame) -> DataFrame:
    """scans with code, kind (0 if the barcode isn't known) and chute."""
    code, kind, chute = C.parse_barcode("barcode")
    return scans.withColumns({"code": code, "kind": kind, "chute": chute})


def match_scans(scans: DataFrame, tasks: DataFrame) -> DataFrame:
    """Parsed scans with the id, month and status of the newest task of their barcode, whatever its status; nulls where there is none. Ids repeat over months, so both name a task."""
    newest = newest_by(tasks.select(C.key_text(C.blank_to_null("barcode")).alias("code"), "id", "status", "task_code", "created_time", "shard_month"), "code")
    found = newest.select("code", F.col("id").alias("task_id"), F.col("shard_month").alias("task_month"), F.col("status").alias("task_status"), F.col("task_code").alias("matched_code"))
    return parse_scans(scans).join(found, "code", "left")


def can_scan(status: Column) -> Column:
    return status.isin(V.CREATED, V.SCANNED, V.DROPPED)


def scan_log_rows(matched: DataFrame) -> DataFrame:
    """A log row for every scan, whatever came of it."""
    reason = (
        F.when(F.col("kind") == 0, "barcode not supported")
        .when(F.col("task_id").isNull(), "no task")
        .when(~can_scan(F.col("task_status")), F.concat(F.lit("not allowed in "), C.status_text("task_status")))
    )
    known = F.when(F.col("kind") > 0, F.col("task_id"))
    return matched.select("event_id", known.alias("business_task_id"), "barcode", "device_code", known.isNotNull().alias("is_matched"), reason.alias("failure_reason"), "scan_time")


def fold_scans(matched: DataFrame, brought: list[str]) -> DataFrame:
    """A row for each task that known scans found: task_id, task_month, allowed, scans (how many), and of the scans in the order of scan_time, then event_id: the last time and code, the last
    chute, device and measure that isn't null, and where each stands (o_last, o_chute, o_device_code, ...)."""
    order = F.struct("scan_time", "event_id")
    known = matched.filter((F.col("kind") > 0) & F.col("task_id").isNotNull())
    given = lambda c: F.when(F.col(c).isNotNull(), order)
    parts = ("chute", "device_code", *brought)
    return known.groupBy("task_id", "task_month").agg(
        F.max(can_scan(F.col("task_status"))).alias("allowed"),
        F.count("*").cast("int").alias("scans"),
        F.max("scan_time").alias("s_scan_time"),
        F.max_by("code", order).alias("s_code"),
        F.max(order).alias("o_last"),
        *(F.max_by(c, given(c)).alias(f"s_{c}") for c in parts),
        *(F.max(given(c)).alias(f"o_{c}") for c in parts),
    )


def apply_scans(tasks: DataFrame, scans: DataFrame, now) -> DataFrame:
    """Tasks after a batch of scans. Scans of one task are folded in the order of scan_time, then event_id: since a scan leaves a task scanned, all of a batch are
    allowed or none. Allowed: the last scan sets status, time and device, the last value of each measure and chute counts, and each adds to scan_count; a dropped task
    loses drop time, actual chute and feedback, while the first scan still makes its dock of the chutes before. Not allowed: each scan adds a retry."""
    return apply_folded(tasks, fold_scans(match_scans(scans, tasks), brought_by(scans, tasks)), now)


def brought_by(scans: DataFrame, tasks: DataFrame) -> list[str]:
    return [c for c in MEASURES if c in scans.columns and c in tasks.columns]


def apply_folded(tasks: DataFrame, folded: DataFrame, now, state: DataFrame | None = None) -> DataFrame:
    """apply_scans() of folded scans. state (see scan_state()): where the scans stand that were applied before; a value of an older scan doesn't take the place of a newer one's, while each scan
    counts. So scans give the same tasks however they are dealt into batches."""
    brought = [c for c in MEASURES if f"s_{c}" in folded.columns]
    rows = tasks.join(folded, (tasks["id"] == folded["task_id"]) & (tasks["shard_month"] == folded["task_month"]), "left")
    if state is None:
        newer = lambda c: F.lit(True)
    else:
        rows = rows.join(state.drop("shard_month", "at"), (rows["task_id"] == state["state_id"]) & (rows["task_month"] == state["state_month"]), "left").drop("state_id", "state_month")
        newer = lambda c: F.col(f"l_{c}").isNull() | (F.col(f"o_{c}") > F.col(f"l_{c}"))
    hit = F.col("scans").isNotNull()
    ok, again = hit & can_scan(F.col("status")), hit & (F.col("status") == V.DROPPED)
    blank = C.blank_to_null("barcode").isNull()
    before = F.when(~again | (F.col("scans") == 1), C.blank_to_null("actual_chute_code"))  # the second scan of a dropped task finds no actual chute
    chute = F.when(newer("chute"), C.blank_to_null("s_chute"))
    dock = F.coalesce(before, chute, C.blank_to_null("target_chute_code"), F.lit(V.NO_DOCK))
    new = {
        "status": F.when(ok, V.SCANNED),
        "scanned_at": F.when(ok & newer("last"), F.col("s_scan_time")),
        "device_code": F.when(ok & newer("device_code"), F.col("s_device_code")),
        "barcode": F.when(ok & blank, F.col("s_code")),
        "normalized_barcode": F.when(ok & blank, F.col("s_code")),
        "target_chute_code": F.when(ok & newer("chute"), F.col("s_chute")),
        "resolved_dock_code": F.when(ok, dock),
        "feedback_status": F.when(again, V.NOT_REQUIRED),
        "updated_time": F.when(hit, C.ntz(now)),
        "scan_retry_count": F.when(hit & ~ok, F.col("scan_retry_count") + F.col("scans")),
        "scan_count": F.when(ok, F.coalesce("scan_count", F.lit(0)) + F.col("scans")) if "scan_count" in tasks.columns else None,
        "is_feedback_reported": F.when(again, False) if "is_feedback_reported" in tasks.columns else None,
        **{c: F.when(ok & newer(c), F.col(f"s_{c}")) for c in brought},
    }
    emptied = {c: F.when(again, None).otherwise(F.col(c)) for c in ("dropped_at", "actual_chute_code", "feedback_time")}

    def value(c: str) -> Column:
        if c in emptied:
            return emptied[c].alias(c)
        return (F.coalesce(new[c], F.col(c)) if new.get(c) is not None else tasks[c]).alias(c)

    return rows.select(*map(value, tasks.columns))


def scan_state(folded: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Where the scans stand that tasks have their values of, with those of `folded` that are allowed: state_id, state_month, shard_month, l_last, l_chute, ... and at, the time of the
    latest. A row for each task that was scanned."""
    parts = [c.removeprefix("o_") for c in folded.columns if c.startswith("o_")]
    new = folded.filter("allowed").select(F.col("task_id").alias("state_id"), F.col("task_month").alias("state_month"), *(F.col(f"o_{c}").alias(f"l_{c}") for c in parts))
    if state is not None:
        new = new.unionByName(state.select(*new.columns))
    last = new.groupBy("state_id", "state_month").agg(*(F.max(f"l_{c}").alias(f"l_{c}") for c in parts))
    return last.withColumns({"shard_month": F.col("state_month"), "at": F.col("l_last.scan_time")})


def scan_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scans, rejects) of requests (request_id, barcodes, scan_time, measures). All barcodes of a request must parse to one chute; at most 100 of 128 characters. Measures
    go to the first barcode, zeros to the others."""
    codes = F.col("barcodes")
    n = F.coalesce(F.size(codes), F.lit(0))
    chutes = F.transform(codes, lambda b: C.parse_barcode(b)[2])
    reason = (
        F.when(n == 0, "no barcodes")
        .when(n > MAX_BARCODES, "too many barcodes")
        .when(F.exists(codes, lambda b: F.coalesce(F.length(b) > MAX_BARCODE_LENGTH, F.lit(False))), "barcode too long")
        .when(F.exists(chutes, lambda c: c.isNull()), "barcode not supported")
        .when(F.size(F.array_distinct(chutes)) > 1, "barcodes of several chutes")
    )
    judged = requests.withColumn("reason", reason)
    brought = [c for c in MEASURES if c in requests.columns]
    others = [c for c in requests.columns if c not in ("barcodes", *brought)]
    good = judged.filter(F.col("reason").isNull()).select(*others, *brought, F.posexplode("barcodes").alias("nth", "barcode"))
    scans = good.select(*others, "nth", "barcode", *(F.when(F.col("nth") == 0, F.col(c)).otherwise(F.lit(0)).alias(c) for c in brought))
    return scans, judged.filter(F.col("reason").isNotNull()).select("request_id", "reason")


def _located(requests: DataFrame, tasks: DataFrame, columns: list[str]) -> DataFrame:
    """requests with task columns (as t_...): of the task with their code, else of the newest with their barcode."""
    rest = [*dict.fromkeys([*columns, "id", "task_code", "barcode", "created_time", "shard_month"])]
    rows = tasks.select(*rest)
    by_code = newest_by(rows, "task_code").select(F.col("task_code").alias("code_of"), F.struct(*rest).alias("one"))
    keyed = rows.withColumn("code_key", C.key_text(C.blank_to_null("barcode")))
    by_barcode = newest_by(keyed, "code_key").select("code_key", F.struct(*rest).alias("two"))
    out = requests.withColumn("asked_code", C.blank_to_null("task_code")).withColumn("asked_barcode", C.key_text(C.blank_to_null("barcode")))
    out = out.join(by_code, F.col("asked_code") == F.col("code_of"), "left").join(by_barcode, F.col("asked_barcode") == F.col("code_key"), "left")
    return out.withColumn("t", F.coalesce("one", "two")).drop("one", "two", "code_of", "code_key")


def resolve_chutes(requests: DataFrame, tasks: DataFrame) -> DataFrame:
    """request_id, found task_code, is_resolved, chute_code and reason. A scanned or dropped task gives its target chute, else that of its barcode."""
    rows = _located(requests, tasks, ["status", "target_chute_code"])
    found, target = F.col("t").isNotNull(), C.blank_to_null("t.target_chute_code")
    chute = F.coalesce(target, C.parse_barcode("t.barcode")[2])
    reason = (
        F.when(~found, "no task")
        .when(~F.col("t.status").isin(V.SCANNED, V.DROPPED), "status not allowed")
        .when(target.isNull() & C.blank_to_null("t.barcode").isNull(), "no barcode")
        .when(chute.isNull(), "barcode without chute")
    )
    return rows.select("request_id", F.col("t.task_code").alias("task_code"), reason.isNull().alias("is_resolved"), F.when(reason.isNull(), chute).alias("chute_code"), reason.alias("reason"))


@dataclass(frozen=True)
class Drops:
    tasks: DataFrame
    judged: DataFrame
    log: DataFrame


def judge_drops(drops: DataFrame, tasks: DataFrame) -> DataFrame:
    """drops with t (their task) and reason, null if accepted."""
    rows = _located(drops, tasks, ["status"])
    chute = C.blank_to_null("actual_chute_code")
    differs = F.col("asked_code").isNotNull() & F.col("asked_barcode").isNotNull() & C.blank_to_null("t.barcode").isNotNull() & (C.key_text("t.barcode") != F.col("asked_barcode"))
    reason = (
        F.when(F.col("asked_code").isNull() & F.col("asked_barcode").isNull(), V.DROP_INVALID)
        .when(F.col("t").isNull(), V.DROP_NO_TASK)
        .when(differs, V.DROP_BARCODE)
        .when(~F.col("t.status").isin(V.SCANNED, V.DROPPED, V.FEEDBACK_PENDING), V.DROP_STATUS)
        .when(F.col("is_success") & chute.isNull(), V.DROP_NO_CHUTE)
    )
    return rows.withColumns({"reason": reason, "chute": chute})


def apply_drops(tasks: DataFrame, drops: DataFrame, now) -> Drops:
    """Tasks after a batch of drops, the judged drops (event_id, task_code, is_accepted, reason), and drop-log rows of the accepted ones.

    Of a task's drops in one batch those up to its first failure count, by drop_time and event_id: a failure makes an exception, after which none is allowed."""
    judged = judge_drops(drops, tasks)
    order = Window.partitionBy("t.id", "t.shard_month").orderBy("drop_time", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    valid = judged.filter(F.col("reason").isNull())
    failed_before = F.coalesce(F.max(~F.col("is_success")).over(order), F.lit(False))
    valid = valid.withColumn("reason", F.when(failed_before, V.DROP_STATUS))
    every = valid.unionByName(judged.filter(F.col("reason").isNotNull()))
    good = valid.filter(F.col("reason").isNull())
    when = F.struct("drop_time", "event_id")
    folded = good.groupBy(F.col("t.id").alias("drop_of"), F.col("t.shard_month").alias("drop_month")).agg(
        F.min("is_success").alias("all_fine"),
        F.max_by("chute", F.when(F.col("is_success"), when)).alias("d_chute"),
        F.max(F.when(F.col("is_success"), F.col("drop_time"))).alias("d_time"),
        F.max_by("failure_reason", F.when(~F.col("is_success"), when)).alias("d_reason"),
    )
    rows = tasks.join(folded, (tasks["id"] == folded["drop_of"]) & (tasks["shard_month"] == folded["drop_month"]), "left")
    hit, fine, any_fine = F.col("drop_of").isNotNull(), F.col("all_fine"), F.col("d_chute").isNotNull()
    actual = F.coalesce("d_chute", "actual_chute_code")
    new = {
        "status": F.when(hit & fine, V.DROPPED).when(hit, V.EXCEPTION).otherwise(F.col("status")),
        "feedback_status": F.when(hit & any_fine, V.PENDING).otherwise(F.col("feedback_status")),
        "actual_chute_code": actual,
        "dropped_at": F.coalesce("d_time", "dropped_at"),
        "is_exception": F.col("is_exception") | (hit & ~fine),
        "updated_time": F.when(hit, C.ntz(now)).otherwise(F.col("updated_time")),
        "resolved_dock_code": F.when(hit, F.coalesce(C.blank_to_null(actual), C.blank_to_null("target_chute_code"), F.lit(V.NO_DOCK))).otherwise(F.col("resolved_dock_code")),
    }
    if "failure_reason" in tasks.columns:
        new["failure_reason"] = F.when(hit & ~fine, F.col("d_reason")).otherwise(F.col("failure_reason"))
    after = rows.select(*(new.get(c, tasks[c]).alias(c) for c in tasks.columns))
    log = good.select("event_id", F.col("t.id").alias("business_task_id"), F.col("t.task_code").alias("task_code"), F.col("chute").alias("actual_chute_code"), "is_success", F.when(~F.col("is_success"), F.col("failure_reason")).alias("failure_reason"), "drop_time")
    return Drops(after, every.select("event_id", F.col("t.task_code").alias("task_code"), F.col("reason").isNull().alias("is_accepted"), "reason"), log)


def recirculation_rule(tasks: DataFrame, most_retries: int, now, dry_run: bool = False) -> DataFrame:
    """tasks with should_recirculate; those with too many retries become exceptions that recirculate, unless it is a dry run."""
    due = F.col("scan_retry_count") >= most_retries
    out = tasks.withColumn("should_recirculate", due)
    if dry_run:
        return out
    new = {"is_recirculated": F.lit(True), "status": F.lit(V.EXCEPTION), "is_exception": F.lit(True), "updated_time": C.ntz(now)}
    return out.withColumns({c: F.when(due, v).otherwise(F.col(c)) for c, v in new.items()})


USE_FIRST, USE_LATEST, MARK_EXCEPTION = "UseFirst", "UseLatest", "MarkException"


def decide_labels(tasks: DataFrame, strategy: str) -> DataFrame:
    """A row for each barcode with an active task: n_active, is_multi_label, is_decided, selected_task (null if none can be) and n_discarded."""
    rows = active_tasks(tasks).withColumn("label", C.blank_to_null("barcode"))
    order = F.struct("created_time", "task_code")
    picked = F.max_by("task_code", order) if strategy == USE_LATEST else F.min_by("task_code", order)
    groups = rows.groupBy("label").agg(F.count("*").cast("long").alias("n_active"), picked.alias("picked"))
    many = F.col("n_active") > 1
    decided = ~many | F.lit(strategy in (USE_FIRST, USE_LATEST))
    left = F.when(~many, F.lit(0)).otherwise(F.col("n_active") - decided.cast("long")).cast("long")
    return groups.select("label", "n_active", many.alias("is_multi_label"), decided.alias("is_decided"), F.when(decided, F.col("picked")).alias("selected_task"), left.alias("n_discarded"))


def discarded_tasks(tasks: DataFrame, strategy: str) -> DataFrame:
    """label and task_code of every active task that a decision between several discards. A row for each, as a barcode may have any number of them."""
    chosen = decide_labels(tasks, strategy).filter("is_multi_label").select("label", "selected_task")
    rows = active_tasks(tasks).select(C.blank_to_null("barcode").alias("label"), "task_code")
    return rows.join(chosen, "label").filter(~F.col("task_code").eqNullSafe(F.col("selected_task"))).select("label", "task_code")

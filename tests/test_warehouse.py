"""Literal cases and laws of the warehouse operators."""

import re
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sortline.functions import columns as C
from sortline.functions import fixed as V
from sortline.operators import aggregates as A
from sortline.operators import events as E
from sortline.operators import maintenance as M
from sortline.operators import projection as P
from sortline.operators import search as S
from sortline.operators import sync
from sortline.operators import views as W
from sortline.plans import snapshots as SN
from sortline.sources import fixtures as X
from sortline.sources import scans, sinks, tables
from sortline.sources.versions import MonthTable, Store
from sortline.streaming import scans as stream

T0 = datetime(2026, 7, 6, 8, 0)
START, END = "2026-07-06 00:00:00", "2026-07-07 00:00:00"
TASKS = (
    "id long, task_code string, source_table_code string, business_key string, source_type int, created_time timestamp_ntz, wave_code string, wave_remark string, working_area string,"
    "target_chute_code string, actual_chute_code string, resolved_dock_code string, status int, feedback_status int, is_exception boolean, is_recirculated boolean, scan_retry_count int,"
    "scan_count int, scanned_at timestamp_ntz, dropped_at timestamp_ntz, updated_time timestamp_ntz, volume_mm3 decimal(18,3), weight_gram decimal(18,3), barcode string, order_id string,"
    "store_id string, store_name string, product_code string, pick_location string, device_code string, is_feedback_reported boolean, feedback_time timestamp_ntz"
)
NAMES = [c.split()[0] for c in re.split(r",(?!\d)", TASKS)]
BASE = dict(source_table_code="T", source_type=V.SPLIT, created_time=T0, wave_code="WAVE-001", status=V.CREATED, feedback_status=0, is_exception=False, is_recirculated=False, scan_retry_count=0, scan_count=0, updated_time=T0, target_chute_code="1")


def tasks(spark, *rows):
    full = []
    for k, r in enumerate(rows):
        r = BASE | {"id": k + 1, "task_code": f"T{k + 1}", "business_key": f"K{k + 1}"} | r
        for c in ("volume_mm3", "weight_gram"):
            r[c] = Decimal(r[c]) if r.get(c) is not None else None
        full.append(tuple(r.get(c) for c in NAMES))
    df = spark.createDataFrame(full, TASKS)
    if not any(r.get("resolved_dock_code") for r in rows):
        df = df.withColumn("resolved_dock_code", C.resolved_dock())
    return df.withColumns({"normalized_wave_code": C.normalized_wave(), "normalized_barcode": C.blank_to_null("barcode"), "shard_month": C.month_key("created_time")})


def logs(spark, *rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id long, business_task_id long, barcode string, device_code string, is_matched boolean, failure_reason string, scan_time timestamp_ntz")


def test_global_dashboard_case(spark):
    rows = tasks(
        spark,
        dict(source_type=V.FULL_CASE, status=V.DROPPED, actual_chute_code="6", volume_mm3=100, weight_gram=10),
        dict(status=V.CREATED, target_chute_code="8", is_exception=True, volume_mm3=200, weight_gram=20),
        dict(status=V.FEEDBACK_PENDING, actual_chute_code="7", wave_code=" ", volume_mm3=300, weight_gram=30),
    )
    seen = logs(spark, *((None, "b", "d", m, None, T0) for m in (True, True, False)))
    batches = X.sync_batches(spark, "/root/testdata/sf0.001").limit(0)
    definitions = spark.createDataFrame([("t",)], "table_code string")
    r = W.global_dashboard(rows, seen, batches, definitions, START, END).first()
    assert (r.total, r.unsorted, r.progress_percent) == (3, 1, Decimal("66.667"))
    assert (r.split_total, r.split_unsorted, r.split_progress_percent) == (2, 1, Decimal(50))
    assert (r.recognition_percent, r.recirculated, r.exceptions, r.volume_mm3, r.weight_gram) == (Decimal("66.667"), 1, 1, 600, 60)
    assert r.download_percent == 0 and r.latest_sync is None
    waves = {x.wave_code: (x.total, x.unsorted) for x in W.global_wave_list(rows, START, END).collect()}
    assert waves == {"WAVE-001": (2, 1), V.NO_WAVE: (1, 0)}


def test_wave_list_case_and_case_folding(spark):
    rows = tasks(spark, dict(source_type=V.FULL_CASE, status=V.DROPPED, wave_remark=" "), dict(wave_code="wave-001", wave_remark="late", updated_time=T0 + timedelta(hours=1)))
    r = W.wave_list(rows, START, END).first()
    assert (r.wave_code, r.total, r.split_total, r.full_case_total, r.split_unsorted, r.full_case_unsorted, r.wave_status, r.wave_remark) == ("WAVE-001", 2, 1, 1, 1, 0, V.WAVE_SORTING, "late")
    assert W.wave_list(rows, END, "2026-07-08 00:00:00").isEmpty()
    assert W.wave_summary(rows, START, END, "none").isEmpty()


def test_range_ends(spark):
    rows = tasks(spark, dict(created_time=datetime(2026, 7, 6)), dict(created_time=datetime(2026, 7, 7)), dict(created_time=datetime(2026, 7, 6, 23, 59, 59, 999999)))
    assert A.wave_dashboard(rows, START, END).first().total == 2
    df = spark.createDataFrame([(datetime(2026, 7, 6),), (datetime(2026, 7, 7),)], "cursor timestamp_ntz")
    assert [r.cursor for r in scans.incremental(df, "cursor", START, END).collect()] == [datetime(2026, 7, 7)]
    assert scans.by_status(df, "cursor", scans.IGNORE, None, "cursor", START, END).count() == 2


def test_zone_aliases(spark):
    rows = tasks(spark, *(dict(working_area=a, status=V.DROPPED if a == "b-2" else V.CREATED) for a in ("YA1", "a 1", "1", "ya-2", "B1", "b-2", "Yb_2", "X9", None)), dict(source_type=V.FULL_CASE), dict(source_type=0))
    got = {r.zone_code: (r.zone_order, r.total, r.unsorted) for r in W.wave_zones(rows, START, END, " wave-001 ").collect()}
    assert got == {"SplitZone1": (1, 3, 3), "SplitZone2": (2, 1, 1), "SplitZone3": (3, 1, 1), "SplitZone4": (4, 2, 1), "FullCase": (5, 1, 1)}
    assert W.wave_zones(rows, START, END, "other").isEmpty()


def test_recirculation_has_three_meanings(spark):
    rows = tasks(spark, dict(target_chute_code="+8"), dict(target_chute_code="8"), dict(target_chute_code="7", is_recirculated=True), dict(target_chute_code="8.5"), dict(target_chute_code=" 9 "))
    by = lambda c: [r.id for r in rows.filter(c).orderBy("id").collect()]
    assert by(C.is_recirculated_dock()) == [1, 2, 5] and by(C.is_recirculated_dock_strict()) == [2, 5] and by(C.is_recirculated_any()) == [1, 2, 3, 5]


def test_exceptions_show_for_dock_seven_alone(spark):
    rows = tasks(spark, dict(target_chute_code="7", is_exception=True), dict(target_chute_code="6", is_exception=True))
    assert {r.dock_code: r.exceptions for r in W.sorting_report(rows, START, END).collect()} == {"7": 1, "6": 0}


@pytest.mark.parametrize(("n", "d", "want"), [(1, 3, "33.333"), (2, 3, "66.667"), (1, 2000, "0.050"), (1, 200000, "0.001"), (0, 5, "0"), (5, 0, "0"), (1, 16, "6.25"), (1, 400000, "0")])
def test_percent(spark, n, d, want):
    assert spark.range(1).select(C.percent(F.lit(n), F.lit(d))).first()[0] == Decimal(want)


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(C.safe_int(F.lit(x))) for x in (" 8 ", "+8", "8.5", "99999999999", "")] == [8, 8, None, None, None]
    assert one(C.has_zone(F.lit("2026-01-01 00:00:00+08:00"))) and not one(C.has_zone(F.lit("2026-01-01 00:00:00")))
    assert one(C.clean_text(F.lit("a\nb\tcdef"), 4)) == "abcd" and one(C.blank_to_null(F.lit("　 "))) is None
    assert str(one(C.month_of_name(F.lit("tasks_202602")))) == "2026-02-01" and one(C.month_of_name(F.lit("tasks_x"))) is None
    assert [one(c) for c in C.split_key(F.lit("a||c"), 4)] == ["a", "", "c", None]
    assert one(C.generated_code(F.lit("x"))) == one(C.generated_code(F.lit("x"))) != one(C.generated_code(F.lit("y")))
    df = spark.createDataFrame([("a", 1), ("a", None)], "x string, y int")
    assert df.select(C.row_digest("x", "y")).distinct().count() == 2 and df.select(C.row_digest("y", "x")).subtract(df.select(C.row_digest("x", "y"))).isEmpty()


def test_barcodes(spark):
    df = spark.createDataFrame([(" 025x ",), ("z7",), ("02",), ("Zx",), ("9",), (" ",), (None,)], "b string")
    got = [tuple(r) for r in df.select(*C.parse_barcode("b")).collect()]
    assert got == [("025X", 1, "5"), ("Z7", 2, "7"), ("02", 0, None), ("ZX", 0, None), ("9", 0, None), (None, 0, None), (None, 0, None)]


# --- search ----------------------------------------------------------------------------------------------------------


def test_pages_make_the_whole(spark, sf):
    rows = S.find_tasks(X.tasks(spark, sf), S.TaskFilter("1995-01-01", "1996-01-01")).select("id", "created_time", "shard_month").cache()
    order = [r.id for r in rows.orderBy(F.desc("created_time"), F.desc("id")).collect()]
    pages = [r.id for k in range(1, len(order) // 100 + 2) for r in S.page(rows, k, 100).collect()]
    assert pages == order and S.has_more(len(order), 1, 100) and not S.has_more(len(order), len(order), 100)
    after, keyset = None, []
    while True:
        got = rows.orderBy(F.desc("created_time"), F.desc("id")).limit(101).collect() if after is None else S.page_after(rows, after.created_time, after.id, 100).collect()
        keyset += [r.id for r in got[:100]]
        if len(got) <= 100:
            break
        after = got[99]
    assert keyset == order


def test_legacy_rows_come_last_and_the_newest_month_wins(spark):
    rows = tasks(spark, dict(id=1, task_code="old", created_time=datetime(2026, 6, 1)), dict(id=1, task_code="new"), dict(id=2, task_code="x"))
    both = tables.with_legacy(rows, tasks(spark, dict(id=1, task_code="legacy", created_time=datetime(2026, 8, 1))).drop("shard_month"))
    assert {r.id: r.task_code for r in S.by_newest_month(both).collect()} == {1: "new", 2: "x"}
    assert [r.task_code for r in S.page(both, 1, 10).collect()][-1] == "legacy"


def test_box_states(spark):
    found = tasks(spark, dict(), dict(is_exception=True), dict(target_chute_code="9"), dict(is_recirculated=True))
    seen = logs(spark, *((t, "b", "d", m, None, T0) for t, m in ((1, True), (2, True), (3, True), (4, True), (99, True), (None, True), (1, False))))
    got = [r.box_status for r in S.box_tracking(seen, found).orderBy("id").collect()]
    assert got == [V.BOX_SCANNED, V.BOX_EXCEPTION, V.BOX_RECIRCULATED, V.BOX_RECIRCULATED, V.BOX_MATCHED, V.BOX_MATCHED, V.BOX_UNMATCHED]
    assert S.box_tracking(seen, found, chute="9").count() == 1


# --- sync ------------------------------------------------------------------------------------------------------------

STATE = "business_key string, digest string, cursor timestamp_ntz, shard_month string, is_soft_deleted boolean, updated_time timestamp_ntz"


def incoming(spark, *rows):
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "business_key string, v string, cursor timestamp_ntz, seq int")
    return sync.with_digest(df, ["v"])


def test_merge_classification_and_idempotence(spark):
    state = spark.createDataFrame([], STATE)
    rows = incoming(spark, ("a", "1", T0), ("a", "1", T0), ("A", "2", T0), ("b", "1", T0), (" ", "1", T0), (None, "1", T0))
    seen = sync.classify(rows, state)
    assert [r.op for r in seen.orderBy("seq").collect()] == ["I", "S", "U", "I"]
    counts = sync.merge_counts(seen).first()
    assert (counts.read, counts.inserted, counts.updated, counts.skipped) == (4, 2, 1, 1)
    after = sync.merge_state(state, sync.last_rows(seen), T0).cache()
    assert {r.business_key for r in after.collect()} == {"A", "b"}
    again = sync.classify(incoming(spark, ("a", "2", T0), ("b", "1", T0)), after)
    assert {r.op for r in again.collect()} == {"S"} and sync.last_rows(again).isEmpty()
    log = sync.change_log(seen, ["business_key", "v"], T0).orderBy("seq").collect()
    assert [(r.business_key, r.op) for r in log] == [("a", "U"), ("a", "U"), ("A", "U"), ("b", "I")] and log[0].after == '{"business_key":"a","v":"1"}'


def test_months_of_cursors(spark):
    df = spark.createDataFrame([(datetime(2026, m, 3),) for m in (5, 6, 7, 8, 9)], "c timestamp_ntz")
    got = [r[0] for r in df.select(sync.month_for_cursor(F.col("c"), "2026-06-30 12:00:00", 2)).collect()]
    assert got == ["202606", "202606", "202607", "202608", "202606"]
    old = spark.createDataFrame([("a", "x", T0, "202605", False, datetime(2026, 5, 1))], STATE)
    new = sync.merge_state(old, sync.last_rows(sync.classify(incoming(spark, ("a", "2", datetime(2026, 7, 1))), old)), "2026-07-02 00:00:00")
    assert [tuple(r) for r in sync.moved_keys(old, new).collect()] == [("a", "202605", "202607")]
    assert sync.latest_state(old.unionByName(new)).first().shard_month == "202607"


def test_deletions(spark):
    state = spark.createDataFrame([(k, k, T0 + timedelta(days=d), "202607", False, T0) for k, d in (("a", 0), ("b", 1), ("c", 1), ("d", 9))], STATE)
    keys = spark.createDataFrame([("A",), ("C",)], "business_key string")
    gone = sync.deleted_keys(state, keys, T0, T0 + timedelta(days=5))
    assert [r.business_key for r in gone.collect()] == ["b"]
    soft = sync.apply_deletions(state, state, gone, sync.SOFT, T0)
    assert [r.business_key for r in soft.state.filter("is_soft_deleted").collect()] == ["b"] and soft.target.count() == 4
    hard = sync.apply_deletions(state, state, gone, sync.HARD, T0)
    assert hard.state.count() == hard.target.count() == 3 and hard.log.count() == 1
    assert sync.apply_deletions(state, state, gone, sync.HARD, T0, dry_run=True).target.count() == 4
    assert sync.apply_deletions(state, state, gone, sync.DISABLED, T0).log.isEmpty()
    assert not sync.deleted_keys(soft.state, keys, T0, T0 + timedelta(days=5)).isEmpty()  # found again


@pytest.mark.parametrize(
    ("cursor", "success", "now", "want"),
    [
        (None, None, "2026-07-06 10:00:00", ("2026-07-01 00:00:00", "2026-07-06 09:50:00")),
        ("2026-07-06 09:00:00", None, "2026-07-06 10:00:00", ("2026-07-06 09:00:00", "2026-07-06 09:50:00")),
        ("2026-07-06 09:55:00", None, "2026-07-06 10:00:00", ("2026-07-06 09:55:00", "2026-07-06 09:55:00")),
        ("2026-07-06 08:00:00", "2026-07-06 11:00:00", "2026-07-06 10:00:00", ("2026-07-06 08:00:00", "2026-07-06 10:50:00")),
    ],
)
def test_windows(spark, cursor, success, now, want):
    d = spark.createDataFrame([("t", 1, 10, "2026-07-01 00:00:00")], "table_code string, priority int, lag_minutes int, start_time string").withColumn("start_time", F.col("start_time").cast("timestamp_ntz"))
    c = spark.createDataFrame([("t", cursor, success)], "table_code string, last_cursor string, last_success string").selectExpr("table_code", "cast(last_cursor as timestamp_ntz) last_cursor", "cast(last_success as timestamp_ntz) last_success")
    r = sync.sync_window(d, c, now).first()
    assert (str(r.window_start), str(r.window_end)) == want


def test_run_twice_changes_nothing(spark, sf):
    source = X.incoming(spark, sf)
    columns = ["l_partkey", "quantity"]
    state = spark.createDataFrame([], STATE)
    target = source.select("business_key", *columns).limit(0)
    keys = source.select("business_key").distinct()
    first = sync.run_batch(source, state, target, keys, columns, "1900-01-01", "2100-01-01", T0)
    result = first.result.first()
    assert result.inserted == first.target.count() == keys.count() and result.deleted == 0
    last = source.groupBy("business_key").agg(F.max_by(F.struct(*(c for c in source.columns if c != "business_key")), "seq").alias("r")).select("business_key", "r.*")
    again = sync.run_batch(last, first.state, first.target, keys, columns, "1900-01-01", "2100-01-01", T0)
    assert (again.result.first().skipped, again.changes.count()) == (keys.count(), 0)
    assert sync.failed_checkpoint(first.checkpoint, "boom").first().last_error == "boom"


def test_projection_upsert_rules(spark):
    now = "2026-07-06 12:00:00"
    old = tasks(spark, dict(), dict(barcode="keep"), dict(status=V.DROPPED), dict(business_key="stay"))
    rows = spark.createDataFrame([("K1", T0, "w9", "new"), ("K2", T0, "w9", "new"), ("K3", T0, "w9", "new"), ("K9", T0, "w9", "new"), (" ", T0, "w", "b"), ("x" * 70, T0, "w", "b"), ("K8", None, "w", "b"), ("K7", T0, "w" * 65, "b")], "k string, t timestamp_ntz, w string, b string")
    p = P.Projection("T", V.SPLIT, "k", "t", {"wave_code": "w", "barcode": "b"})
    good, bad = P.project(rows, p, now)
    assert {(r.business_key[:2], r.reason) for r in bad.collect()} == {("xx", "key too long"), ("K8", "no creation time"), ("K7", "wave_code too long")}
    out = {r.business_key: r for r in P.upsert(old, good).collect()}
    assert [(out[k].barcode, out[k].wave_code, out[k].change) for k in ("K1", "K2", "K3", "stay", "K9")] == [("new", "w9", "U"), ("keep", "w9", "U"), (None, "w9", "U"), (None, "WAVE-001", None), ("new", "w9", "I")]
    assert out["K9"].status == V.CREATED and out["K9"].shard_month == "202607" and out["K3"].normalized_wave_code == "w9"
    assert P.project(rows, P.Projection("T", 0, "k", "t", {}), now)[0].isEmpty()


def test_consume_moves_the_cursor_only_if_all_is_marked(spark):
    rows = spark.createDataFrame([("K1", T0, "r1", 1), ("K1", T0, "r2", 2), (None, T0, "r3", 3)], "k string, t timestamp_ntz, rid string, n int")
    p = P.Projection("T", V.SPLIT, "k", "t", {})
    one = lambda df, wb=True: P.consume(df, tasks(spark, dict()), p, "rid", "n", "Y", "b", T0, wb)
    assert not one(rows).counts.first().moves_cursor and one(rows, False).counts.first().moves_cursor and one(rows.limit(2)).counts.first().moves_cursor
    assert one(rows).write_back.count() == 2 and one(rows, False).write_back.isEmpty()


# --- events ----------------------------------------------------------------------------------------------------------


def scan(spark, *rows):
    return spark.createDataFrame([(k, b, T0 + timedelta(minutes=m), "D1", w) for k, (b, m, w) in enumerate(rows)], "event_id long, barcode string, scan_time timestamp_ntz, device_code string, weight_gram decimal(18,3)")


def test_scans_fold(spark):
    rows = tasks(
        spark,
        dict(barcode="021x"),
        dict(barcode="022x", status=V.DROPPED, actual_chute_code="9", dropped_at=T0, feedback_status=V.COMPLETED, is_feedback_reported=True),
        dict(barcode="023x", status=V.EXCEPTION),
        dict(barcode="024x"),
    )
    events = scan(spark, ("021X ", 2, Decimal(5)), ("021x", 1, Decimal(7)), ("021x", 3, None), ("022x", 1, None), ("023x", 1, None), ("023x", 2, None), ("??", 1, None), ("029", 1, None))
    out = {r.id: r for r in E.apply_scans(rows, events, T0).collect()}
    assert (out[1].status, out[1].scan_count, out[1].weight_gram, out[1].scanned_at) == (V.SCANNED, 3, 5, T0 + timedelta(minutes=3))
    assert (out[2].status, out[2].actual_chute_code, out[2].dropped_at, out[2].feedback_status, out[2].resolved_dock_code) == (V.SCANNED, None, None, V.NOT_REQUIRED, "9")
    twice = E.apply_scans(rows, scan(spark, ("022x", 1, None), ("022x", 2, None)), T0).filter("id = 2").first()
    assert twice.resolved_dock_code == "2"  # as if applied one after the other
    assert (out[3].status, out[3].scan_retry_count, out[3].scan_count) == (V.EXCEPTION, 2, 0) and out[4].status == V.CREATED
    log = [(r.is_matched, r.failure_reason) for r in E.scan_log_rows(E.match_scans(events, rows)).orderBy("event_id").collect()]
    assert log == [(True, None)] * 4 + [(True, "not allowed in 异常")] * 2 + [(False, "barcode not supported"), (False, "no task")]


def test_scan_requests(spark):
    df = spark.createDataFrame([(1, ["021a", "Z1b"], Decimal(3)), (2, ["021", "022"], None), (3, [], None), (4, ["x"], None), (5, ["021"] * 101, None), (6, ["021" + "x" * 130], None), (7, None, None)], "request_id int, barcodes array<string>, weight_gram decimal(18,3)")
    good, bad = E.scan_requests(df)
    assert [(r.request_id, r.nth, r.weight_gram) for r in good.orderBy("nth").collect()] == [(1, 0, 3), (1, 1, 0)]
    assert {r.request_id: r.reason for r in bad.collect()} == {2: "barcodes of several chutes", 3: "no barcodes", 4: "barcode not supported", 5: "too many barcodes", 6: "barcode too long", 7: "no barcodes"}


def test_drops(spark):
    rows = tasks(spark, dict(status=V.SCANNED, barcode="021x"), dict(status=V.CREATED), dict(status=V.SCANNED), dict(status=V.DROPPED))
    drops = spark.createDataFrame(
        [(1, "T1", "021X", "7", True, None), (2, "T2", None, "7", True, None), (3, "T3", None, None, False, "jam"), (4, "T4", None, " ", True, None), (5, "T1", "other", "7", True, None), (6, None, None, "7", True, None), (7, "none", None, "7", True, None), (8, "T3", None, "5", True, None)],
        "event_id int, task_code string, barcode string, actual_chute_code string, is_success boolean, failure_reason string",
    ).withColumn("drop_time", F.lit(T0) + F.make_dt_interval(mins=F.col("event_id")))
    out = E.apply_drops(rows, drops, T0)
    assert {r.event_id: r.reason for r in out.judged.collect()} == {1: None, 2: V.DROP_STATUS, 3: None, 4: V.DROP_NO_CHUTE, 5: V.DROP_BARCODE, 6: V.DROP_INVALID, 7: V.DROP_NO_TASK, 8: V.DROP_STATUS}
    got = {r.id: (r.status, r.feedback_status, r.actual_chute_code, r.resolved_dock_code, r.is_exception) for r in out.tasks.collect()}
    assert got[1] == (V.DROPPED, V.PENDING, "7", "7", False) and got[3] == (V.EXCEPTION, 0, None, "1", True) and got[2][0] == V.CREATED
    assert out.log.count() == 2


def test_chutes_and_labels(spark):
    rows = tasks(spark, dict(status=V.SCANNED, target_chute_code=" ", barcode="Z4"), dict(status=V.CREATED, barcode="b"), dict(status=V.SCANNED, target_chute_code="", barcode=None), dict(status=V.SCANNED, target_chute_code=None, barcode="q"), dict(barcode="b", created_time=T0 + timedelta(hours=1)))
    asked = spark.createDataFrame([(1, "T1", None), (2, "T2", None), (3, "T3", None), (4, None, "q"), (5, "nope", "z4"), (6, "nope", None)], "request_id int, task_code string, barcode string")
    got = {r.request_id: (r.chute_code, r.reason) for r in E.resolve_chutes(asked, rows).collect()}
    assert got == {1: ("4", None), 2: (None, "status not allowed"), 3: (None, "no barcode"), 4: (None, "barcode without chute"), 5: ("4", None), 6: (None, "no task")}
    pick = lambda s: {r.label: (r.selected_task, r.n_discarded) for r in E.decide_labels(rows, s).collect()}
    assert pick(E.USE_FIRST)["b"] == ("T2", 1) and pick(E.USE_LATEST)["b"] == ("T5", 1) and pick(E.MARK_EXCEPTION)["b"] == (None, 2) and pick(E.USE_FIRST)["q"] == ("T4", 0)
    assert E.discarded_tasks(rows, E.MARK_EXCEPTION).count() == 2 and E.discarded_tasks(rows, E.USE_FIRST).first().task_code == "T5"
    ruled = {r.id: r for r in E.recirculation_rule(tasks(spark, dict(scan_retry_count=3), dict(scan_retry_count=2)), 3, T0).collect()}
    assert ruled[1].is_recirculated and ruled[1].status == V.EXCEPTION and ruled[2].status == V.CREATED
    assert E.recirculation_rule(tasks(spark, dict(scan_retry_count=3)), 3, T0, dry_run=True).first().status == V.CREATED


# --- maintenance, sinks, tables --------------------------------------------------------------------------------------


def test_months_are_written_read_and_dropped(spark, tmp_path):
    path = str(tmp_path / "tasks")
    rows = tasks(spark, *(dict(created_time=datetime(2026, m, 5)) for m in range(1, 8))).drop("shard_month")
    tables.append_by_month(rows, path, "created_time")
    tables.append_by_month(rows.limit(1), path, "created_time")
    june = tables.read_months(spark, path, "2026-06-01", "2026-07-01")
    plan = june._jdf.queryExecution().executedPlan().toString()
    assert june.count() == 1 and "shard_month" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert tables.months_between("2026-06-01", "2026-07-01") == ("202606", "202606")
    kept = M.drop_months(spark, path, "2026-07-15 00:00:00", 3, dry_run=True)
    assert kept.dropped == [] and kept.months.count() == 4
    assert M.drop_months(spark, path, "2026-07-15 00:00:00", 3, allowed=False).months.first().outcome == "not allowed"
    assert sorted(M.drop_months(spark, path, "2026-07-15 00:00:00", 3).dropped) == ["202601", "202602", "202603", "202604"]
    assert tables.read_months(spark, path).count() == 3


def test_seed_and_write_backs(spark):
    old = tasks(spark, dict(), dict(created_time=datetime(2026, 6, 1)))
    asked = spark.createDataFrame([(x,) for x in (" K1", "K2", "new", "new ", " ", None)], "business_key string")
    rows, counts = sinks.seed(old, asked, "business_key", "202607")
    assert tuple(counts.first()) == (6, 2, 1, 1, 2) and {r.business_key for r in rows.collect()} == {"K2", "new"}
    with pytest.raises(Exception, match="no target for source type"):
        sinks.feedback_write_back(tasks(spark, dict(source_type=0)), sinks.ROUTES, {}).collect()
    with pytest.raises(ValueError, match="protected"):
        scans.without(old, ["ID"], ["id"])
    seen = spark.sparkContext.accumulator(0)
    sinks.write_rows(old, lambda batch: seen.add(len(batch)), 1)
    assert seen.value == 2


def test_remote_tables(spark, sf):
    url, driver = "jdbc:derby:memory:remote;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = X.load(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("o_orderdate"))
    sinks.write_jdbc(rows, url, "orders", driver)
    source = scans.jdbc_source(spark, url, "orders", driver, "o_orderkey", 0, 2000, 4)
    some = scans.incremental(source, "O_ORDERDATE", "1997-01-01", "1998-01-01").select("o_orderkey")
    want = scans.incremental(rows, "o_orderdate", "1997-01-01", "1998-01-01")
    assert source.rdd.getNumPartitions() == 4 and some.count() == want.count() > 0
    scan = some._jdf.queryExecution().executedPlan().toString().split("JDBCRelation")[1]
    assert "PushedFilters" in scan and "O_CUSTKEY" not in scan.upper().split("READSCHEMA")[1]


def test_csv_report(spark, tmp_path):
    rows = tasks(spark, dict(wave_remark='a "b", c', wave_code="W,1"))
    path = str(tmp_path / "csv")
    W.write_csv(W.report(W.wave_list(rows, START, END), W.WAVE_LIST_COLUMNS, V.WAVE_LIST_HEADERS).coalesce(1), path)
    text = next(tmp_path.glob("csv/part-*")).read_bytes()
    assert text.startswith(b"\xef\xbb\xbf") and '"W,1","a ""b"", c",1,1,' in text.decode() and "2026-07-06 08:00:00," + V.WAVE_SORTING in text.decode()
    zones = W.report(W.wave_zones(rows, START, END, "w,1"), W.ZONE_COLUMNS, V.ZONE_HEADERS)
    assert zones.columns[0] == V.ZONE_HEADERS[0] and zones.count() == 5


def test_feedback_claims(spark):
    rows = tasks(spark, dict(feedback_status=V.PENDING), dict(feedback_status=V.PROCESSING, updated_time=T0 - timedelta(minutes=11)), dict(feedback_status=V.PROCESSING, updated_time=T0 - timedelta(minutes=9)), dict(feedback_status=V.COMPLETED))
    claimed = M.claim_feedback(rows, V.PENDING, 10, T0)
    assert M.claim_by_code(rows, "T1", V.PENDING, T0).count() == 1 and M.claim_by_code(rows, "T4", V.PENDING, T0).isEmpty()
    assert {r.id for r in claimed.collect()} == {1, 2}
    assert {r.id: r.feedback_status for r in M.finish_feedback(rows, claimed, 2, T0).collect()} == {1: V.COMPLETED, 2: V.COMPLETED, 3: V.PROCESSING, 4: V.COMPLETED}
    assert M.audit_failed(M.clean_wave(rows, "WAVE-001", V.EXCEPTION, T0)[1], "x\ny").first().outcome == "failed"


# --- snapshots -------------------------------------------------------------------------------------------------------

DAY = datetime(2026, 7, 6)


@pytest.mark.parametrize(
    ("start", "end", "coverage", "want"),
    [
        ((8, 0, 0), (9, 0, 0), None, None),
        ((8, 0, 0), (9, 0, 0), ((8, 0, 0), (9, 0, 0)), (((8, 0, 0), (9, 0, 0)), [])),
        ((8, 0, 30), (9, 0, 10), ((7, 0, 0), (10, 0, 0)), (((8, 1, 0), (9, 0, 0)), [((8, 0, 30), (8, 1, 0)), ((9, 0, 0), (9, 0, 10))])),
        ((7, 0, 0), (11, 0, 0), ((8, 0, 0), (10, 0, 0)), (((8, 0, 0), (10, 0, 0)), [((7, 0, 0), (8, 0, 0)), ((10, 0, 0), (11, 0, 0))])),
        ((8, 0, 10), (8, 0, 50), ((7, 0, 0), (10, 0, 0)), None),
        ((9, 0, 0), (8, 0, 0), ((7, 0, 0), (10, 0, 0)), None),
    ],
)
def test_snapshot_plans(start, end, coverage, want):
    at = lambda x: DAY.replace(hour=x[0], minute=x[1], second=x[2])
    got = SN.split_range(at(start), at(end), coverage and tuple(map(at, coverage)))
    assert got == (want and (tuple(map(at, want[0])), [tuple(map(at, e)) for e in want[1]]))


def test_hybrid_is_base_for_any_range(spark, sf):
    import random

    rows = X.tasks(spark, sf).cache()
    cover = (datetime(1996, 3, 1, 5, 7), datetime(1998, 2, 2, 3, 4))
    snap = SN.Snapshot(SN.task_snapshot(tables.in_months(rows, *cover)).cache(), cover)
    rnd = random.Random(2)
    for _ in range(3):
        a = datetime(1995, 6, 1) + timedelta(seconds=rnd.randrange(10**8))
        b = a + timedelta(seconds=rnd.randrange(10**8))
        for hybrid, base in (
            (SN.hybrid_wave_dashboard, A.wave_dashboard),
            (SN.hybrid_dock_dashboard, A.dock_dashboard),
            (SN.hybrid_recirculation, A.recirculation_summary),
            (SN.hybrid_feedback, A.feedback_totals),
            (SN.hybrid_wave_codes, A.wave_codes),
            (SN.hybrid_wave_options, A.wave_options),
        ):
            want = base(rows, a, b)
            assert sorted(map(repr, hybrid(rows, snap, a, b).select(*want.columns).collect())) == sorted(map(repr, want.collect()))
        want = W.current_wave(rows, a, b)
        waves = SN.Snapshot(SN.current_wave_snapshot(tables.in_months(rows, *cover)), cover)
        assert SN.hybrid_current_wave(rows, waves, a, b).select(*want.columns).collect() == want.collect()


def test_incremental_refresh_is_full_rebuild(spark):
    now = T0 + timedelta(hours=1)
    first = tasks(spark, *(dict(created_time=T0 - timedelta(minutes=k * 7)) for k in range(20)))
    old = SN.refresh(first, None, now)
    later = now + timedelta(minutes=30)
    changed = first.withColumns({"status": F.when(F.col("id") % 3 == 0, V.DROPPED).otherwise(F.col("status")), "updated_time": F.when(F.col("id") % 3 == 0, C.ntz(later)).otherwise(F.col("updated_time"))})
    changed = changed.unionByName(tasks(spark, dict(id=99, created_time=now + timedelta(minutes=5), updated_time=now + timedelta(minutes=5))))
    some, full = SN.refresh(changed, old, later, now), SN.refresh(changed, None, later)
    assert some.coverage == full.coverage
    assert sorted(map(repr, some.rows.select(*full.rows.columns).collect())) == sorted(map(repr, full.rows.collect()))
    assert SN.needs_full_refresh(now, None) and SN.needs_full_refresh(now, (now - timedelta(hours=1), now)) and SN.needs_full_refresh(now, (now - timedelta(days=9), now + timedelta(hours=1)))
    assert not SN.needs_full_refresh(now, (now - timedelta(days=9), now))


def test_runs_of_minutes_cross_midnight(spark):
    at = [datetime(2026, 7, 5, 23, 58), datetime(2026, 7, 5, 23, 59), datetime(2026, 7, 6, 0, 0), datetime(2026, 7, 6, 0, 2)]
    got = [tuple(r) for r in SN.bucket_ranges(spark.createDataFrame([(t,) for t in at + at[:1]], "bucket timestamp_ntz")).orderBy("start").collect()]
    assert got == [(at[0], datetime(2026, 7, 6, 0, 1)), (at[3], datetime(2026, 7, 6, 0, 3))]


# --- streaming -------------------------------------------------------------------------------------------------------


def test_scan_stream_is_the_batch(spark, sf, tmp_path):
    rows = X.tasks(spark, sf)
    events = X.scan_events(spark, sf).cache()
    src = str(tmp_path / "in")
    for k in range(3):
        events.filter(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(src)
    table = MonthTable(spark, f"file://{tmp_path}/tasks")
    table.write(rows, 0)
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src)
    run = lambda: stream.apply_scan_stream(source, table, str(tmp_path / "log"), str(tmp_path / "checkpoint"), lambda: T0)
    run().awaitTermination()
    run().awaitTermination()  # nothing new: nothing happens
    assert table.versions()[-1] == 3
    columns = ["id", "shard_month", "status", "actual_chute_code", "resolved_dock_code", "scan_retry_count"]
    want = E.apply_scans(rows, events, T0).select(*columns)
    assert sorted(map(repr, table.read().select(*columns).collect())) == sorted(map(repr, want.collect()))
    assert spark.read.parquet(str(tmp_path / "log")).count() == events.count()


def test_only_touched_months_are_rewritten(spark, tmp_path):
    day = lambda m: datetime(2026, m, 5, 8)
    rows = tasks(spark, *(dict(created_time=day(m), barcode=f"021{m}", task_code=f"T{m}") for m in (1, 2, 3, 4)))
    table = MonthTable(spark, f"file://{tmp_path}/tasks")
    table.write(rows, 0)
    first = table.months()
    src = str(tmp_path / "in")
    scan(spark, ("0212", 5, None), ("0214", 6, None), ("0219", 7, None)).coalesce(1).write.parquet(src)
    source = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    stream.apply_scan_stream(source, table, str(tmp_path / "log"), str(tmp_path / "c"), lambda: T0, keep=1).awaitTermination()
    after = table.months()
    assert {m for m in first if first[m] != after[m]} == {"202602", "202604"} and set(first) == set(after)
    assert {r.task_code: r.status for r in table.read().collect()} == {"T1": V.CREATED, "T2": V.SCANNED, "T3": V.CREATED, "T4": V.SCANNED}
    assert sorted(p.name for p in tmp_path.glob("tasks/data/0-*/rows/of_month=*")) == ["of_month=202601", "of_month=202603"]  # what no version names is gone
    assert all("of_month=202603" in f for f in table.read(["202603"]).inputFiles()) and table.read(["209901"]).count() == 0
    # a failed write changes nothing
    with pytest.raises(Exception):
        table.write(table.read().withColumn("status", F.raise_error(F.lit("broken")).cast("int")), 2)
    assert table.versions() == [1] and table.read().count() == 4


def test_keyed_merge_of_touched_months(spark, tmp_path):
    kinds = "business_key string, v string, shard_month string"
    target = spark.createDataFrame([("a", "1", "202601"), ("b", "1", "202602"), ("c", "1", "202603"), ("d", "1", "202604")], kinds)
    rows = spark.createDataFrame([("B", "2", "202602"), ("c", "2", "202605"), ("e", "2", "202605")], kinds)
    months, merged = sync.merge_months(target, rows)
    assert months == ["202602", "202603", "202605"]
    assert sorted(map(tuple, merged.collect())) == [("B", "2", "202602"), ("c", "2", "202605"), ("e", "2", "202605")]
    table = MonthTable(spark, f"file://{tmp_path}/t")
    table.write(target, 0)
    months, merged = sync.merge_months(table.read(), rows)
    table.write(merged, 1, months)
    whole = sync.merge_table(target, rows)
    assert sorted(map(tuple, table.read().select("business_key", "v", "shard_month").collect())) == sorted(map(tuple, whole.collect()))
    assert {m: p.split("/")[1].split("-")[0] for m, p in table.months().items()} == {"202601": "0", "202602": "1", "202604": "0", "202605": "1"}


def test_sync_of_touched_months_is_that_of_whole_tables(spark, tmp_path):
    day = lambda m, d=3: datetime(2026, m, d)
    old = incoming(spark, *((k, "1", day(m)) for k, m in (("a", 5), ("b", 6), ("c", 7), ("d", 7), ("e", 8))))
    empty = spark.createDataFrame([], STATE)
    known = sync.merge_state(empty, sync.last_rows(sync.classify(old, empty)), day(5), 3)
    held = known.select("business_key", "shard_month").withColumn("v", F.lit("1"))
    store = Store(spark, f"file://{tmp_path}/store")
    sync.open_sync(store, known, held)
    first = store.last()
    source = incoming(spark, ("A", "2", day(7, 10)), ("c", "1", day(7, 11)), ("n", "9", day(8, 1)), ("x", "7", day(9, 30)))
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("e",), ("n",)], "business_key string")
    args = (["v"], day(6, 30), day(9, 1), day(7, 20))
    for batch, mode in enumerate((sync.HARD, sync.SOFT, sync.DISABLED)):
        parts = {"state": ["business_key", "cursor", "shard_month", "is_soft_deleted"], "target": ["business_key", "v"], "changes": ["business_key", "op"], "deletions": ["business_key", "mode"]}
        shown = lambda b: {p: sorted(map(repr, getattr(b, p).select(*columns).collect())) for p, columns in parts.items()}
        want = sync.run_batch(source, store.read("state"), store.read("target").drop("shard_month"), keys, *args, deletion=mode)
        expected = shown(want)
        got = sync.sync_months(source, store, keys, *args, f"b{batch}", deletion=mode)
        assert shown(got) == expected
        assert tuple(got.result.first()) == tuple(want.result.first()) and tuple(got.checkpoint.first()) == tuple(want.checkpoint.first())
    for table in ("state", "target"):
        assert store.last().months(table)["202606"] == first.months(table)["202606"]  # never touched


def test_upsert_of_touched_months(spark):
    old = tasks(spark, *(dict(created_time=datetime(2026, m, 5), wave_code="old") for m in (1, 2, 3)))
    new = spark.createDataFrame([("T", "K2", datetime(2026, 6, 1), "new"), ("T", "K9", datetime(2026, 4, 1), "new")], "source_table_code string, business_key string, created_time timestamp_ntz, wave_code string")
    months, rows = P.upsert_months(old, new)
    assert months == ["202602", "202604", "202606"]
    whole = P.upsert(old, new).filter(F.col("shard_month").isin(months))
    assert sorted(map(repr, rows.collect())) == sorted(map(repr, whole.collect())) and rows.count() == 2


def test_late_scans_of_closed_minutes_are_dropped(spark, tmp_path):
    at = lambda m, s=0: datetime(2026, 7, 6, 8, m, s)
    src, kinds = str(tmp_path / "in"), "scan_time timestamp_ntz, is_matched boolean"
    q = lambda: (
        stream.minute_counts(spark.readStream.schema(kinds).parquet(src), "2 minutes")
        .writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "c"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    for rows in ([(at(0, 5), True), (at(1), False)], [(at(9), True)], [(at(0, 50), True), (at(8), True)], [(at(30), True)]):
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(src)
        q()
    got = {r.bucket.strftime("%H:%M"): (r.total, r.matched) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # 08:00 was final when its second scan came; 08:08 was still open
    assert got == {"08:00": (1, 1), "08:01": (1, 0), "08:08": (1, 1), "08:09": (1, 1)}


def test_minute_stream(spark, sf, tmp_path):
    seen = X.scan_logs(spark, sf)
    src = str(tmp_path / "in")
    seen.coalesce(1).write.parquet(src)
    q = stream.minute_counts(spark.readStream.schema(seen.schema).parquet(src), "0 seconds").writeStream.format("memory").queryName("minute_counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("minute_counts").select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "total", "matched")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, SN.scan_snapshot(seen).collect()))


def test_refresh_stream_goes_on_after_a_restart(spark, tmp_path):
    src, made = str(tmp_path / "in"), []
    store = lambda: stream.SnapshotStore(spark, f"file://{tmp_path}/store")
    rows = tasks(spark, *(dict(created_time=T0 - timedelta(minutes=k), scanned_at=T0) for k in range(5)))
    seen = logs(spark, *((None, "b", "d", True, None, T0 - timedelta(minutes=k)) for k in range(3)))

    def run(now, some, table, scans):
        some.select("created_time").coalesce(1).write.mode("append").parquet(src)
        stream.refresh_stream(spark.readStream.schema("created_time timestamp_ntz").parquet(src), lambda: made.append(1) or table, lambda: scans, store(), str(tmp_path / "c"), lambda: now).awaitTermination()

    first = T0 + timedelta(hours=1)
    run(first, rows, rows, seen)
    assert [store().read().tasks.count(), store().read().waves.count(), store().read().scans.count()] == [5, 5, 3] and store().read().coverage[1] == first
    # a new process: the coverage is read back, and what has changed, even without a sign of it, is made anew
    moved = rows.withColumn("status", F.when(F.col("id") == 2, V.DROPPED).otherwise(F.col("status")))
    later = first + timedelta(minutes=10)
    more = seen.unionByName(logs(spark, (None, "b", "d", False, None, first + timedelta(minutes=2))))
    run(later, rows.filter("id = 2"), moved, more)
    got, want = store().read(), SN.refresh_all(moved, more, None, later)
    for part in ("tasks", "waves", "scans"):
        assert sorted(map(repr, getattr(got, part).select(*getattr(want, part).columns).collect())) == sorted(map(repr, getattr(want, part).collect()))
    assert got.coverage == want.coverage and got.last_refresh == later and len(store().versions()) == 2 and len(made) == 2
    stale = SN.needs_full_refresh
    assert not stale(later, got.coverage) and stale(later + timedelta(days=8), got.coverage)


def test_ids_repeat_over_months(spark):
    """The same id in two months: only the task that is meant changes."""
    two = lambda **r: tasks(spark, dict(id=5, created_time=datetime(2026, 1, 5), task_code="A", barcode="021a", **r), dict(id=5, created_time=datetime(2026, 2, 5), task_code="B", barcode="021b", **r))
    shown = lambda df, c: {r.task_code: r[c] for r in df.collect()}
    rows = two()
    assert shown(E.apply_scans(rows, scan(spark, ("021a", 5, None)), T0), "status") == {"A": V.SCANNED, "B": V.CREATED}
    drops = spark.createDataFrame([(1, "B", None, "7", True, None, T0)], "event_id long, task_code string, barcode string, actual_chute_code string, is_success boolean, failure_reason string, drop_time timestamp_ntz")
    assert shown(E.apply_drops(two(status=V.SCANNED), drops, T0).tasks, "status") == {"A": V.SCANNED, "B": V.DROPPED}
    due = two(feedback_status=V.PENDING)
    claimed = M.claim_feedback(due, V.PENDING, 1, T0)
    assert shown(M.mark_claimed(due, claimed, T0), "feedback_status") == {"A": V.PROCESSING, "B": V.PENDING}
    assert shown(M.finish_feedback(due, claimed, 1, T0), "feedback_status") == {"A": V.COMPLETED, "B": V.PENDING}


def test_feedback_runs(spark):
    rows = tasks(spark, dict(feedback_status=V.PENDING), dict(feedback_status=V.FAILED), dict(feedback_status=V.PENDING, source_type=V.FULL_CASE), dict(feedback_status=V.PENDING, created_time=T0 + timedelta(hours=1)))
    sent = []

    def write(df):
        sent[:] = sorted((r.target, r.business_key) for r in df.collect())
        return len(sent)

    states = lambda f: {r.id: r.feedback_status for r in f.tasks.collect()}
    run = M.report_feedback(rows, write, T0, 2)
    assert sent == [("full_case_feedback", "K3"), ("split_feedback", "K1")]
    assert states(run) == {1: V.COMPLETED, 2: V.FAILED, 3: V.COMPLETED, 4: V.PENDING}
    assert tuple(run.result.first()) == (2, 2, 2, 0, 0, None)
    assert {r.id for r in run.tasks.filter("is_feedback_reported").collect()} == {1, 3}
    short = M.report_feedback(rows, lambda df: df.count() - 1, T0, 2)
    assert states(short) == {1: V.FAILED, 2: V.FAILED, 3: V.FAILED, 4: V.PENDING} and tuple(short.result.first()) == (2, 1, 0, 2, 0, "1 rows written, 2 claimed")
    retry = M.report_feedback(rows, write, T0, status=V.FAILED)
    assert states(retry)[2] == V.COMPLETED and sent == [("split_feedback", "K2")]

    def broken(df):
        raise OSError("no target")

    assert states(M.report_feedback(rows, broken, T0, task_code=" T2 ", status=V.FAILED))[2] == V.FAILED
    none = M.report_feedback(rows, write, T0, task_code="T1", status=V.FAILED)
    assert tuple(none.result.first()) == (0, 0, 0, 0, 1, None) and states(none) == {r.id: r.feedback_status for r in rows.collect()}


def test_source_page_sorts_only_the_page_in_one_task(spark):
    from sortline.operators.search import source_page

    page = source_page(spark.range(1000, numPartitions=7), ["id"], 3, 10)
    assert [(r.id, r.row_nr) for r in page.orderBy("id").collect()] == [(k, k + 1) for k in range(20, 30)]
    assert source_page(spark.range(5), ["id"], 2, 10).count() == 0
    plan = source_page(spark.range(1000, numPartitions=7), ["id"], 3, 10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "offset=20" in plan.replace(" ", "")

"""Commits, attempts that die, races, key filters, file bounds, stored claims and retention."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sortline.functions import columns as C
from sortline.functions import fixed as V
from sortline.operators import events as E
from sortline.operators import maintenance as M
from sortline.operators import search as S
from sortline.operators import sync
from sortline.sources import key_filters, versions
from sortline.sources.versions import Conflict, Files, MonthTable, Store
from sortline.streaming import scans as stream

from .test_warehouse import STATE, T0, incoming, scan, tasks

ROWS = "business_key string, v string, shard_month string"


def store_at(spark, path):
    return Store(spark, f"file://{path}")


def shown(df, *columns):
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=repr)


class Died(Exception):
    """Stands for a lost driver."""


def die_at(monkeypatch, step):
    """The driver is lost before its n-th change of a file or folder: writes of rows, creation and deletion of files."""
    left = [step]

    def guarded(f):
        def run(*a, **k):
            left[0] -= 1
            if left[0] < 0:
                raise Died
            return f(*a, **k)

        return run

    monkeypatch.setattr(versions.Attempt, "_write", guarded(versions.Attempt._write))
    monkeypatch.setattr(versions.Attempt, "stage", guarded(versions.Attempt.stage))
    monkeypatch.setattr(key_filters, "build", guarded(key_filters.build))
    monkeypatch.setattr(Files, "create", guarded(Files.create))
    monkeypatch.setattr(Files, "delete", guarded(Files.delete))


# --- commits ---------------------------------------------------------------------------------------------------------


def test_of_two_attempts_on_one_base_one_fails(spark, tmp_path):
    store = store_at(spark, tmp_path)
    first = store.attempt()
    first.replace("a", spark.createDataFrame([("x", "1", "202601"), ("y", "1", "202602")], ROWS))
    first.append("log", spark.createDataFrame([("x", "1", "202601")], ROWS), F.col("shard_month"))
    first.commit({"n": 1})
    one, two = store.attempt(), store.attempt()
    one.replace("a", spark.createDataFrame([("x", "one", "202601")], ROWS), ["202601"])
    two.replace("a", spark.createDataFrame([("x", "two", "202601")], ROWS), ["202601"])
    two.append("log", spark.createDataFrame([("z", "2", "202601")], ROWS), F.col("shard_month"))
    two.commit({"m": 2})
    with pytest.raises(Conflict):
        one.commit()
    assert shown(store.read("a"), "business_key", "v") == [("x", "two"), ("y", "1")]
    assert shown(store.read("log"), "business_key") == [("x",), ("z",)]
    assert store.last().info == {"n": 1, "m": 2} and store.versions() == [0, 1]
    # the first version is still there as it was
    assert shown(store.read("a", at=store.last(0)), "v") == [("1",), ("1",)]
    store.prune(1)
    assert store.versions() == [1] and shown(store.read("a"), "v") == [("1",), ("two",)]
    assert len(list(tmp_path.glob("data/1-*/a/of_month=*"))) == 1  # what the loser wrote is gone


def test_retried_changes_are_made_on_the_last_commit(spark, tmp_path):
    store = store_at(spark, tmp_path)
    one = store.attempt()
    one.replace("a", spark.createDataFrame([("x", "0", "202601")], ROWS))
    one.commit({"n": 0})
    raced = []

    def change(attempt):
        if not raced:  # another is faster once
            raced.append(1)
            versions.retried(store, lambda other: {"n": other.base.info["n"] + 10})
        return {"n": attempt.base.info["n"] + 1}

    assert versions.retried(store, change).info == {"n": 11}


def test_prune_leaves_what_may_still_be_committed(spark, tmp_path):
    store = store_at(spark, tmp_path)
    one = store.attempt()
    one.replace("a", spark.createDataFrame([("x", "0", "202601")], ROWS))
    one.commit()
    slow = store.attempt()
    slow.replace("a", spark.createDataFrame([("x", "1", "202601")], ROWS))
    store.prune(1)
    slow.commit()
    assert shown(store.read("a"), "v") == [("1",)]
    store.prune(1)
    assert shown(store.read("a"), "v") == [("1",)] and not list(tmp_path.glob("data/0-*/a/of_month=*"))


def test_empty_tables(spark, tmp_path):
    table = MonthTable(spark, f"file://{tmp_path}")
    table.write(spark.createDataFrame([], ROWS), 0)
    assert table.read().count() == 0 and table.read().columns == ["business_key", "v", "shard_month"] and table.months() == {}
    table.write(spark.createDataFrame([("x", "1", None)], ROWS), 1)
    assert shown(table.read()) == [("x", "1", None)] and list(table.months()) == [""]
    with pytest.raises(Conflict):
        table.write(spark.createDataFrame([], ROWS), 1)


# --- sync runs -------------------------------------------------------------------------------------------------------


def day(m, d=3):
    return datetime(2026, m, d)


def sync_store(spark, path):
    old = incoming(spark, *((k, "1", day(m)) for k, m in (("a", 5), ("b", 6), ("c", 7), ("d", 7), ("e", 8))))
    empty = spark.createDataFrame([], STATE)
    known = sync.merge_state(empty, sync.last_rows(sync.classify(old, empty)), day(5), 3)
    store = store_at(spark, path)
    sync.open_sync(store, known, known.select("business_key", "shard_month").withColumn("v", F.lit("1")))
    return store


def sync_args(spark):
    source = incoming(spark, ("A", "2", day(7, 10)), ("c", "1", day(7, 11)), ("n", "9", day(8, 1)), ("x", "7", day(9, 30)))
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("e",), ("n",)], "business_key string")
    return source, keys, ["v"], day(6, 30), day(9, 1), day(7, 20)


def sync_run(spark, store, batch="b1"):
    source, keys, *rest = sync_args(spark)
    return sync.sync_months(source, store, keys, *rest, batch, deletion=sync.HARD)


def state_of(store):
    tables = {t: shown(store.read(t), *c) for t, c in {"state": ["business_key", "cursor", "shard_month"], "target": ["business_key", "v"]}.items()}
    at = store.last()
    return tables | {t: shown(store.read(t), *c) for t, c in {"changes": ["business_key", "op", "batch_id"], "deletions": ["business_key"], "batches": ["batch_id", "status"]}.items() if t in at.tables}


def test_a_sync_run_that_dies_anywhere_changes_nothing_and_comes_again(spark, tmp_path, monkeypatch):
    want_store = sync_store(spark, tmp_path / "want")
    before = state_of(want_store)
    sync_run(spark, want_store)
    want = state_of(want_store)
    assert want != before and [r[1] for r in want["batches"]] == [V.BATCH_PENDING, V.BATCH_RUNNING, V.BATCH_COMPLETED]
    store = sync_store(spark, tmp_path / "store")
    step, died = 0, True
    while died:
        with monkeypatch.context() as m:
            die_at(m, step)
            try:
                sync_run(spark, store)
                died = False
            except Died:
                pass
        now = state_of(store)
        assert now in (before, want), step
        if now == want:
            break
        if step % 3 == 2:
            store.prune(1)  # leftovers go, what is named stays
            assert state_of(store) == before
        step += 1
    assert step > 8  # stages, two tables and a filter, three logs, the commit
    sync_run(spark, store)
    sync_run(spark, store)  # a committed batch does nothing
    assert state_of(store) == want and store.versions()[-1] == 1


def test_two_sync_runs_at_once(spark, tmp_path, monkeypatch):
    store = sync_store(spark, tmp_path)
    commit = versions.Attempt.commit

    def late(self, info=None):
        monkeypatch.setattr(versions.Attempt, "commit", commit)
        sync_run(spark, store, "faster")
        return commit(self, info)

    monkeypatch.setattr(versions.Attempt, "commit", late)
    with pytest.raises(Conflict):
        sync_run(spark, store, "slower")
    assert {r[0] for r in shown(store.read("batches"), "batch_id")} == {"faster"}


def definition(spark, lag=0):
    return spark.createDataFrame([("T", 1, lag, day(6, 30))], "table_code string, priority int, lag_minutes int, start_time timestamp_ntz")


def test_jobs_go_on_from_their_cursor_and_failures_keep_it(spark, tmp_path):
    store = sync_store(spark, tmp_path)
    source, keys, columns, *_ = sync_args(spark)
    broken = source.withColumn("v", F.raise_error(F.lit("no line\nto the source")).cast("string"))
    with pytest.raises(Exception):
        sync.sync_job(broken, store, keys, columns, definition(spark), day(9, 1), "b1")
    before = {t: shown(store.read(t)) for t in ("state", "target")}
    row = sync.checkpoints(store).first()
    assert row.last_cursor == day(6, 30) and row.last_success is None and "no line" in row.last_error and "\n" not in row.last_error
    assert [r[0] for r in shown(store.read("batches"), "status")] == [V.BATCH_PENDING, V.BATCH_RUNNING, V.BATCH_FAILED]
    assert before == {t: shown(store.read(t)) for t in ("state", "target")}
    got = sync.sync_job(source, store, keys, columns, definition(spark), day(9, 2), "b1")  # the same batch again
    assert got.result.first()["read"] == 3 and sync.checkpoints(store).first().last_error is None
    assert sync.checkpoints(store).first().last_cursor == day(8, 1)
    again = sync.sync_job(source, store, keys, columns, definition(spark), day(9, 3), "b1")
    assert tuple(again.result.first()) == tuple(got.result.first())
    later = sync.sync_job(source, store, keys, columns, definition(spark), day(10, 1), "b2")  # from the cursor on
    assert later.result.first()["read"] == 1 and sync.checkpoints(store).first().last_cursor == day(9, 30)
    assert sync.sync_job(source, store, keys, columns, definition(spark, lag=60 * 24 * 400), day(10, 1), "b3") is None
    ledger = sync.batch_ledger(store.read("batches").select("batch_id", "status", "at"))
    assert shown(ledger, "batch_id", "status") == [("b1", V.BATCH_COMPLETED), ("b2", V.BATCH_COMPLETED)]


def test_a_batch_opens_only_months_that_may_hold_its_keys(spark, tmp_path):
    months = [f"2025{m:02d}" for m in range(1, 13)]
    rows = [(f"k{m}-{i}", "d", datetime(2025, int(m[4:]), 3), m, False, day(1)) for m in months for i in range(200)]
    state = spark.createDataFrame(rows, "business_key string, digest string, cursor timestamp_ntz, shard_month string, is_soft_deleted boolean, updated_time timestamp_ntz")
    store = store_at(spark, tmp_path)
    sync.open_sync(store, state, state.select("business_key", "shard_month").withColumn("v", F.lit("1")))
    source = incoming(spark, ("K202503-7", "2", day(7, 10)), ("k202511-150", "1", day(7, 11)), ("new", "9", day(7, 12)))
    keys = state.select("business_key")
    batch = source.select(C.key_text("business_key"))
    assert store.months_that_may_hold("state", "key", batch) == ["202503", "202511"]
    sync.sync_months(source, store, keys, ["v"], day(6, 30), day(9, 1), day(7, 20), "b1")
    assert store.last().info["runs"]["T"]["months"] == ["202503", "202511", "202607"]
    opened = store.read("state", store.months_that_may_hold("state", "key", batch, store.last(0)), store.last(0)).inputFiles()
    assert {f.split("of_month=")[1][:6] for f in opened} == {"202503", "202511"}


# --- key filters -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(2))
def test_filters_have_no_false_negative_and_few_false_positives(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcÀé 0\n", k=rng.randrange(0, 9)))
    held = {m: {word() for _ in range(rng.choice([1, 30, 4000]))} for m in ("202601", "202602", "")}
    rows = spark.createDataFrame([(k, m or None) for m, own in held.items() for k in own] + [(None, "202601")], "k string, shard_month string")
    blocks = key_filters.build(rows, {"k": F.col("k")})
    asked = sorted({*held["202601"], *held["202602"], *held[""]}) + [f"absent {i}" for i in range(3000)]
    hit = {tuple(r) for r in key_filters.hits(blocks, spark.createDataFrame([(k,) for k in asked], "key string")).collect()}
    assert {(m, k) for m, own in held.items() for k in own} <= hit
    assert len([k for _, k in hit if k.startswith("absent")]) < 30
    assert key_filters.months_hit(blocks, spark.createDataFrame([(None,)], "key string")) == []


def test_scan_stream_opens_months_by_their_barcodes(spark, tmp_path):
    rows = tasks(spark, *(dict(created_time=datetime(2026, m, 5, 8), barcode=f"021{m}", task_code=f"T{m}") for m in range(1, 9)))
    table = stream.scanned_tasks(spark, f"file://{tmp_path}/tasks")
    table.write(rows, 0)
    src = str(tmp_path / "in")
    scan(spark, ("0212 ", 5, None), ("0217", 6, None), ("0219", 7, None), ("??", 8, None)).coalesce(1).write.parquet(src)
    source = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    run = lambda: stream.apply_scan_stream(source, table, str(tmp_path / "log"), str(tmp_path / "c"), lambda: T0).awaitTermination()
    run()
    told = table.store.last().info["streams"][str(tmp_path / "c")]
    assert told == {"batch": 0, "opened": ["202602", "202607"], "rewritten": ["202602", "202607"], "newest": None}
    want = E.apply_scans(rows, spark.read.parquet(src), T0)
    assert shown(table.read(), "id", "status", "scan_count") == shown(want, "id", "status", "scan_count")
    # rewritten months have filters again
    scan(spark, ("0217", 9, None)).coalesce(1).write.mode("append").parquet(src)
    run()
    assert table.store.last().info["streams"][str(tmp_path / "c")]["opened"] == ["202607"]
    assert {r.task_code: r.scan_count for r in table.read().collect()}["T7"] == 2


def test_a_scan_batch_that_dies_comes_again_once(spark, tmp_path, monkeypatch):
    rows = tasks(spark, *(dict(created_time=datetime(2026, m, 5, 8), barcode=f"021{m}", task_code=f"T{m}") for m in (1, 2)))
    table = stream.scanned_tasks(spark, f"file://{tmp_path}/tasks")
    table.write(rows, 0)
    src = str(tmp_path / "in")
    scan(spark, ("0212", 5, None)).coalesce(1).write.parquet(src)
    source = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    run = lambda: stream.apply_scan_stream(source, table, str(tmp_path / "log"), str(tmp_path / "c"), lambda: T0).awaitTermination()
    for step in (0, 1, 2):
        with monkeypatch.context() as m:
            die_at(m, step)
            with pytest.raises(Exception):
                run()
        assert table.versions() == [0]
    run()
    assert {r.task_code: r.scan_count for r in table.read().collect()} == {"T1": 0, "T2": 1} and spark.read.parquet(str(tmp_path / "log")).count() == 1


@pytest.mark.parametrize("seed", [1])
def test_any_split_of_scans_into_batches_gives_the_same_tasks(spark, tmp_path, seed):
    """Batches in any order of time, with scans delivered again, against all scans at once."""
    rng = random.Random(seed)
    status = [V.CREATED, V.SCANNED, V.DROPPED, V.FEEDBACK_PENDING, V.EXCEPTION]
    rows = tasks(spark, *(dict(created_time=datetime(2026, 1 + i % 3, 5), barcode=f"02{i % 10}b{i}", status=status[i % 5], actual_chute_code=rng.choice([None, "8"]), weight_gram=1) for i in range(20)))
    events = [
        (n, rng.choice([f"02{i % 10}b{i}", f"02{i % 10}B{i}"]), T0 + timedelta(minutes=rng.randrange(40)), rng.choice([None, f"D{n}"]), rng.choice([None, n]))
        for n, i in enumerate(rng.choices(range(22), k=60))
    ]
    kinds = "event_id long, barcode string, scan_time timestamp_ntz, device_code string, weight_gram int"
    made = lambda some: spark.createDataFrame(some, kinds).withColumn("weight_gram", F.col("weight_gram").cast("decimal(18,3)"))
    table = stream.scanned_tasks(spark, f"file://{tmp_path}/tasks")
    table.write(rows, 0)
    shuffled = events[:]
    rng.shuffle(shuffled)
    src = str(tmp_path / "in")
    schema = made(events[:1]).schema
    for k in range(3):
        part = shuffled[k::3] + rng.sample(shuffled, 8)  # some come again, also in other batches
        made(part).coalesce(1).write.mode("append").parquet(src)
        source = spark.readStream.schema(schema).parquet(src)
        stream.apply_scan_stream(source, table, str(tmp_path / "log"), str(tmp_path / "c"), lambda: T0, late="2 hours").awaitTermination()
    columns = ["id", "shard_month", "status", "scanned_at", "device_code", "target_chute_code", "actual_chute_code", "resolved_dock_code", "weight_gram", "scan_count", "scan_retry_count", "feedback_status"]
    assert shown(table.read(), *columns) == shown(E.apply_scans(rows, made(events), T0), *columns)
    assert spark.read.parquet(str(tmp_path / "log")).count() == len(events)


def test_scan_state_is_bounded_by_the_watermark(spark, tmp_path):
    rows = tasks(spark, *(dict(created_time=datetime(2026, m, 5), barcode=f"021{m}") for m in (1, 2, 3)))
    table = stream.scanned_tasks(spark, f"file://{tmp_path}/tasks")
    table.write(rows, 0)
    src = str(tmp_path / "in")
    held = []
    for minute, code in ((0, "0211"), (5, "0212"), (30, "0213"), (100, "0213")):
        spark.createDataFrame([(minute, code, T0 + timedelta(minutes=minute), "D")], "event_id long, barcode string, scan_time timestamp_ntz, device_code string").coalesce(1).write.mode("append").parquet(src)
        source = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
        stream.apply_scan_stream(source, table, str(tmp_path / "log"), str(tmp_path / "c"), lambda: T0, late="10 minutes").awaitTermination()
        held.append(shown(table.store.read(stream.SCAN_STATE), "state_id"))
    assert held == [[(1,)], [(1,), (2,)], [(3,)], [(3,)]]
    assert {r.id: r.scan_count for r in table.read().collect()} == {1: 1, 2: 1, 3: 2}


# --- claims ----------------------------------------------------------------------------------------------------------


def due(spark, path, n=6):
    table = MonthTable(spark, f"file://{path}")
    table.write(tasks(spark, *(dict(feedback_status=V.PENDING, created_time=T0 - timedelta(days=20 * k), actual_chute_code="1") for k in range(n))), 0)
    return table.store


def states(store):
    return {r.id: r.feedback_status for r in store.read("rows").collect()}


def test_a_stored_claim_is_there_before_the_write(spark, tmp_path):
    store, seen = due(spark, tmp_path), []

    def write(rows):
        seen.append((sorted(r.business_key for r in rows.collect()), sorted(i for i, s in states(store).items() if s == V.PROCESSING)))
        return 2

    row = M.feedback_run(store, write, lambda: T0, 2).first()
    assert tuple(row) == (2, 2, 2, 0, 0, None)
    assert seen == [(["K5", "K6"], [5, 6])] and states(store) == {1: 1, 2: 1, 3: 1, 4: 1, 5: V.COMPLETED, 6: V.COMPLETED}
    assert {r.id for r in store.read("rows").filter("is_feedback_reported").collect()} == {5, 6}
    short = M.feedback_run(store, lambda rows: rows.count() - 1, lambda: T0, 2).first()
    assert tuple(short) == (2, 1, 0, 2, 0, "1 rows written, 2 claimed") and states(store)[4] == V.FAILED

    def broken(rows):
        raise OSError("no target")

    assert tuple(M.feedback_run(store, broken, lambda: T0, 9).first()) == (2, 0, 0, 2, 0, "write-back failed: OSError")
    assert tuple(M.feedback_run(store, broken, lambda: T0, 9).first()) == (0, 0, 0, 0, 0, None)


def test_two_runs_never_share_a_row(spark, tmp_path):
    store, sent = due(spark, tmp_path), []

    def write(rows):
        keys = [r.business_key for r in rows.collect()]
        if len(sent) < 2:  # another run begins while this one writes
            sent.append(keys)
            M.feedback_run(store, write, lambda: T0, 2)
        else:
            sent.append(keys)
        return len(keys)

    M.feedback_run(store, write, lambda: T0, 2)
    flat = [k for keys in sent for k in keys]
    assert len(flat) == len(set(flat)) == 6 and set(states(store).values()) == {V.COMPLETED}


def test_claims_on_one_base_are_made_anew(spark, tmp_path, monkeypatch):
    store, sent = due(spark, tmp_path), []
    write = lambda rows: sent.extend(r.business_key for r in rows.collect()) or 2
    commit, raced = versions.Attempt.commit, []

    def late(self, info=None):
        if not raced:
            raced.append(1)
            M.feedback_run(store, write, lambda: T0, 2)
        return commit(self, info)

    monkeypatch.setattr(versions.Attempt, "commit", late)
    M.feedback_run(store, write, lambda: T0, 2)
    assert sorted(sent) == ["K3", "K4", "K5", "K6"]


def test_a_lost_driver_leaves_its_claim_until_it_is_stale(spark, tmp_path):
    store = due(spark, tmp_path, 2)

    class Lost(BaseException):
        pass

    def lost(rows):
        rows.count()
        raise Lost

    with pytest.raises(Lost):
        M.feedback_run(store, lost, lambda: T0)
    assert set(states(store).values()) == {V.PROCESSING}
    assert M.feedback_run(store, lambda rows: rows.count(), lambda: T0 + timedelta(minutes=9)).first().claimed == 0
    assert tuple(M.feedback_run(store, lambda rows: rows.count(), lambda: T0 + timedelta(minutes=11)).first()) == (2, 2, 2, 0, 0, None)


def test_a_stale_run_does_not_finish_what_another_has(spark, tmp_path):
    store, times = due(spark, tmp_path, 2), [T0]

    def slow(rows):
        n = rows.count()
        times[0] = T0 + timedelta(minutes=20)
        with pytest.raises(ZeroDivisionError):
            M.feedback_run(store, lambda rows: 1 // 0 if False else rows.count(), lambda: times[0], 1)
            raise ZeroDivisionError
        return n - 1  # this run failed, the other's row is complete

    row = M.feedback_run(store, slow, lambda: times[0], 2).first()
    assert row.failed == 1 and states(store) == {1: V.FAILED, 2: V.COMPLETED}


def test_the_newest_task_of_a_code_is_claimed_or_none(spark, tmp_path):
    rows = tasks(spark, dict(task_code="A", feedback_status=V.FAILED), dict(task_code="A", feedback_status=V.COMPLETED, created_time=T0 + timedelta(days=40)), dict(task_code="B", feedback_status=V.FAILED))
    assert M.claim_by_code(rows, "A", V.FAILED, T0).count() == 0
    assert [r.id for r in M.claim_by_code(rows, "B", V.FAILED, T0).collect()] == [3]
    table = MonthTable(spark, f"file://{tmp_path}")
    table.write(rows, 0)
    run = lambda code: tuple(M.feedback_run(table.store, lambda df: df.count(), lambda: T0, status=V.FAILED, task_code=code).first())
    assert run(" A ") == (0, 0, 0, 0, 1, None) and run("B") == (1, 1, 1, 0, 0, None)


# --- retention -------------------------------------------------------------------------------------------------------


def timed(spark, n=40, seed=1):
    rng = random.Random(seed)
    rows = [(i, None if rng.random() < 0.1 else datetime(2026, 1, 1) + timedelta(hours=rng.randrange(0, 4000)), f"2026{rng.randrange(1, 4):02d}") for i in range(n)]
    return spark.createDataFrame(rows, "id long, at timestamp_ntz, shard_month string")


@pytest.mark.parametrize("seed", range(2))
def test_rows_before_a_time_go_by_the_bounds_of_files(spark, tmp_path, seed):
    rows = timed(spark, seed=seed).repartitionByRange(6, "at")
    store = store_at(spark, tmp_path)
    one = store.attempt()
    one.replace("t", rows, time="at")
    one.append("u", rows, F.col("shard_month"))  # without bounds
    one.commit()
    for threshold in (datetime(2026, 1, 1), datetime(2026, 3, 20, 5), datetime(2027, 1, 1)):
        attempt = store.attempt()
        counts = {t: attempt.delete_before(t, "at", threshold) for t in ("t", "u")}
        old = store.last()
        attempt.commit()
        want = shown(M.delete_before(rows, "at", threshold))
        for t in ("t", "u"):
            assert shown(store.read(t)) == want
            assert counts[t]["rows_deleted"] == store.read(t, at=old).count() - len(want)
        bounds = [b for held in old.months("t").values() for b in held["files"].values()]
        at = versions._micros(threshold)
        old_files = [b for b in bounds if b[0] is not None and b[0] < at]
        assert counts["t"]["files_rewritten"] == sum(not (b[1] < at and not b[3]) for b in old_files) and counts["t"]["files_dropped"] + counts["t"]["files_rewritten"] == len(old_files)
        store.prune(2)
        assert shown(store.read("t")) == want and store.read("t", at=old).count() >= len(want)  # kept versions stay readable
    assert {r[1] for r in shown(store.read("t"))} == {None}


def test_retention_of_a_store(spark, tmp_path):
    store = store_at(spark, tmp_path)
    one = store.attempt()
    rows = tasks(spark, *(dict(created_time=datetime(2026, m, 5)) for m in (3, 4, 5, 6, 7)))
    one.replace("business_tasks", rows)
    one.replace("scan_logs", timed(spark), time="at")
    one.commit()
    first = store.last()
    targets = [
        M.Target("tasks", "business_tasks", 2),
        M.Target("dry", "business_tasks", 3, dry_run=True),
        M.Target("gone", "no_such_table"),
        M.Target("kept", "business_tasks", 1, allowed=False),
        M.Target("logs", "scan_logs", 4, M.DELETE_ROWS, "at"),
        M.Target("odd", "scan_logs", 4, "Melt"),
    ]
    old = M.delete_before(timed(spark), "at", datetime(2026, 4, 1)).count()
    audit = {r.target_code: (r.execution_stage, r.scanned_count, r.candidate_count, r.deleted_count, r.message) for r in M.retention_run(store, targets, "2026-07-06 08:00:00", "r1").collect()}
    assert audit["tasks"] == ("Completed", 5, 3, 3, "deleted: 3 months")
    assert audit["dry"] == ("Completed", 2, 0, 0, "dry run: 0 months")
    assert audit["kept"] == ("Completed", 2, 1, 0, "not allowed: 1 months")
    assert audit["logs"] == ("Completed", 1, 40 - old, 40 - old, f"deleted: {40 - old} rows")
    assert audit["gone"][0] == "Failed" and "no_such_table" in audit["gone"][4] and audit["odd"][0] == "Failed"
    assert sorted(store.last().months("business_tasks")) == ["202606", "202607"] and store.read("scan_logs").count() == old
    assert store.read("business_tasks", at=first).count() == 5  # what was there is readable until it is pruned
    store.prune(1)
    assert store.read("business_tasks").count() == 2 and not list(tmp_path.glob("data/*/business_tasks/of_month=202603"))
    log = store.read(M.AUDITS)
    assert log.filter("execution_stage = 'Started'").count() == 6 and M.retention_log(store).count() == 6


def test_a_retention_run_that_dies_has_its_audit(spark, tmp_path, monkeypatch):
    store = store_at(spark, tmp_path)
    one = store.attempt()
    one.replace("business_tasks", tasks(spark, dict(created_time=datetime(2026, 1, 5)), dict(created_time=datetime(2026, 7, 5))))
    one.commit()
    drop = versions.Attempt.drop

    class Lost(BaseException):
        pass

    def lost(self, *a):
        drop(self, *a)
        raise Lost

    monkeypatch.setattr(versions.Attempt, "drop", lost)
    with pytest.raises(Lost):
        M.retention_run(store, [M.Target("tasks", "business_tasks")], T0, "r1")
    assert [r.execution_stage for r in M.retention_log(store).collect()] == ["Started"] and store.read("business_tasks").count() == 2


def test_newest_is_found_in_hit_months_alone(spark):
    """A barcode in two months: scans go to the newer task also when only hit months are read."""
    rows = tasks(spark, dict(created_time=datetime(2026, 1, 5), barcode="021a"), dict(created_time=datetime(2026, 3, 5), barcode="021A"), dict(created_time=datetime(2026, 2, 5), barcode="021b"))
    some = rows.filter("shard_month <> '202602'")
    codes = scan(spark, ("021a", 5, None))
    assert shown(E.match_scans(codes, some), "task_id", "task_month") == shown(E.match_scans(codes, rows), "task_id", "task_month")
    assert S.newest_by(rows, "task_code").count() == 3

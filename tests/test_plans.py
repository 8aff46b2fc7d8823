"""Kept totals, ranked pages, reconciliation and updates by row id against the full computation."""

import random
import sqlite3
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sortline.functions import fixed as V
from sortline.operators import aggregates as A
from sortline.operators import reconcile as R
from sortline.operators import search as S
from sortline.operators import sync
from sortline.operators import views as W
from sortline.plans import rank_index as K
from sortline.plans import wave_totals as T
from sortline.sources import sinks
from sortline.sources.versions import Store, retried

from .test_store import shown
from .test_warehouse import STATE, T0, tasks


def random_task(rng, i):
    return dict(
        id=i,
        task_code=f"T{i}",
        business_key=f"K{i}",
        wave_code=rng.choice(["A", "a", " B", "B", "c", None, "  "]),
        wave_remark=rng.choice(["r1", "r2", " ", None]),
        status=rng.choice([V.CREATED, V.SCANNED, V.DROPPED, V.EXCEPTION]),
        source_type=rng.choice([V.SPLIT, V.FULL_CASE]),
        created_time=T0 + timedelta(hours=rng.randrange(6)),
        updated_time=T0 + timedelta(hours=rng.randrange(6)),
        scanned_at=rng.choice([None, T0]),
        resolved_dock_code=rng.choice(["3", "9", None]),
        is_exception=rng.random() < 0.2,
        volume_mm3=rng.choice([None, 5]),
    )


@pytest.mark.parametrize("seed", range(2))
def test_kept_wave_totals_are_those_of_all_tasks(spark, seed):
    rng = random.Random(seed)
    held = {i: random_task(rng, i) for i in range(30)}
    table = lambda: tasks(spark, *held.values()) if held else tasks(spark, random_task(rng, 1)).limit(0)
    before = table()
    totals = spark.createDataFrame(T.wave_totals(before).collect(), T.wave_totals(before).schema)
    for step in range(3):
        for i in rng.sample(sorted(held), min(len(held), 6)):
            if rng.random() < 0.4:
                del held[i]
            else:
                held[i] = held[i] | {k: v for k, v in random_task(rng, i).items() if rng.random() < 0.4 and k != "id"}
        if step == 1:
            held = {i: t for i, t in held.items() if (t["wave_code"] or "").strip().lower() != "a"}  # a whole wave goes
        for i in range(100 * step + 100, 100 * step + 104):
            held[i] = random_task(rng, i)
        after = table()
        changes = T.changes_between(before, after)
        kept = T.apply_changes(totals, changes, T.tasks_of_waves(after))
        totals = spark.createDataFrame(kept.totals.collect(), kept.totals.schema)
        assert shown(T.cleanable_waves(totals)) == shown(A.cleanable_waves(after).select(*T.cleanable_waves(totals).columns))
        before = after


def test_only_waves_that_lost_an_extreme_are_read_again(spark):
    rows = [dict(wave_code=w, created_time=T0 + timedelta(hours=h), updated_time=T0 + timedelta(hours=h), wave_remark=f"{w}{h}") for w in ("A", "B", "C", "D") for h in (0, 1, 2)]
    before = tasks(spark, *rows)
    asked = []

    def tasks_of(after):
        def read(waves):
            asked.extend(sorted(r.wave for r in waves.collect()))
            return T.tasks_of_waves(after)(waves)

        return read

    # A loses its first task, B its newest remark, C one in between, D's first task changes its status only
    after = before.filter("NOT (wave_code = 'A' AND wave_remark = 'A0')").filter("NOT (wave_code = 'B' AND wave_remark = 'B2')").filter("NOT (wave_code = 'C' AND wave_remark = 'C1')")
    after = after.withColumn("status", F.when(F.col("wave_remark") == "D0", V.DROPPED).otherwise(F.col("status")))
    kept = T.apply_changes(T.wave_totals(before), T.changes_between(before, after), tasks_of(after))
    assert shown(T.shown(kept.totals)) == shown(T.shown(T.wave_totals(after)))
    assert asked == ["A", "B"]
    same = T.apply_changes(T.wave_totals(before), T.changes_between(before, before), tasks_of(before))
    assert shown(T.shown(same.totals)) == shown(T.shown(T.wave_totals(before))) and asked == ["A", "B"]


# --- ranked pages ----------------------------------------------------------------------------------------------------


def ranked(spark, path, rows, size):
    store = Store(spark, f"file://{path}")
    retried(store, lambda a: K.write_ranked(a, "rows", rows, range_rows=size) or {})
    return store


@pytest.mark.parametrize("seed", [3])
def test_all_ranked_pages_are_pages(spark, tmp_path, seed):
    rng = random.Random(seed)
    # many ties in time, over three months; ids are unique
    rows = tasks(spark, *(dict(id=i, created_time=datetime(2026, rng.randrange(5, 8), 1 + rng.randrange(3)), status=rng.choice([1, 5])) for i in range(90)))
    store = ranked(spark, tmp_path, rows, 7)
    whole = [r.id for r in S.page(rows, 1, 1000).collect()]
    for size in (1, 10, 25, 1000):
        for number in range(1, 90 // size + 3) if size > 1 else (1, 45, 90, 91):
            got = K.page_at(store, "rows", number, size)
            assert [r.id for r in got.rows.collect()] == whole[(number - 1) * size : number * size] and got.total == 90
    hit = F.col("status") == 5
    some = [r.id for r in S.page(rows.filter(hit), 1, 1000).collect()]
    for number in range(1, len(some) // 10 + 3):
        got = K.page_at(store, "rows", number, 10, hit)
        assert [r.id for r in got.rows.collect()] == some[(number - 1) * 10 : number * 10] and got.total == len(some)
    june = K.page_at(store, "rows", 2, 5, months=["202606"])
    assert [r.id for r in june.rows.collect()] == [r.id for r in S.page(rows.filter("shard_month = '202606'"), 2, 5).collect()]


def test_a_deep_page_opens_two_ranges_at_most(spark, tmp_path):
    rows = tasks(spark, *(dict(id=i, created_time=T0 - timedelta(minutes=i)) for i in range(400)))
    store = ranked(spark, tmp_path, rows, 20)
    for number in (1, 2, 15, 39, 40):
        got = K.page_at(store, "rows", number, 10)
        assert len(got.opened) <= 2 and len(got.rows.inputFiles()) <= 2
    assert K.page_at(store, "rows", 41, 10).rows.count() == 0
    assert K.page_at(ranked(spark, tmp_path / "none", rows.limit(0), 20), "rows", 1, 10).rows.count() == 0


def test_a_month_that_is_not_ranked_is_told(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    retried(store, lambda a: a.replace("rows", tasks(spark, {}), time="created_time") or {})
    with pytest.raises(ValueError, match="isn't ranked"):
        K.page_at(store, "rows", 1, 10)


def test_rows_deleted_by_bounds_leave_no_ranking(spark, tmp_path):
    store = ranked(spark, tmp_path, tasks(spark, *(dict(id=i, created_time=T0 - timedelta(minutes=i)) for i in range(40))), 10)
    retried(store, lambda a: a.delete_before("rows", "created_time", T0 - timedelta(minutes=25)) and {})
    assert store.read("rows").count() == 26
    with pytest.raises(ValueError, match="isn't ranked"):
        K.page_at(store, "rows", 1, 10)


# --- reconciliation --------------------------------------------------------------------------------------------------


def state_of(spark, keys):
    rows = [(k, "d", datetime(2026, 1, 1 + d), "202601", False, T0) for k, d in keys]
    return spark.createDataFrame(rows, STATE)


@pytest.mark.parametrize("large", [0, 3, 1000])
def test_reconciled_deletions_are_those_of_all_keys(spark, large):
    rng = random.Random(large)
    ours = [(f"k{i}", rng.randrange(0, 9)) for i in range(400)] + [("K7", 1), ("k8", 2), ("k8", 2)]
    theirs = [k.upper() if rng.random() < 0.3 else k for k, _ in ours if rng.random() < 0.97] + ["new1", "new2", None]
    state, keys = state_of(spark, ours), spark.createDataFrame([(k,) for k in theirs + theirs[:50]], "business_key string")
    start, end = datetime(2026, 1, 2), datetime(2026, 1, 8)
    got = R.reconcile(state, keys, start, end, large=large)
    assert shown(got.gone, "business_key", "cursor") == shown(sync.deleted_keys(state, keys, start, end), "business_key", "cursor")


def test_keys_of_equal_buckets_are_never_fetched(spark):
    ours = [(f"k{i}", 3) for i in range(2000)]
    lacks = {"k77", "k1500"}
    keys = spark.createDataFrame([(k,) for k, _ in ours if k not in lacks], "business_key string")
    state = state_of(spark, ours)
    got = R.reconcile(state, keys, datetime(2026, 1, 1), datetime(2026, 2, 1))
    assert {r.business_key for r in got.gone.collect()} == lacks
    hashed = lambda df: df.withColumn("hash", R.key_hash()).select("business_key", R.bucket(0).alias("b"))
    buckets = {r.b for r in hashed(state).filter(F.col("business_key").isin(*lacks)).collect()}
    fetched = hashed(got.fetched).collect()
    assert {r.b for r in fetched} <= buckets and len(fetched) < 20
    # with one large bucket, its parts that agree aren't fetched either
    few = R.reconcile(state, keys, datetime(2026, 1, 1), datetime(2026, 2, 1), large=0)
    assert few.fetched.count() == 0 and {r.business_key for r in few.gone.collect()} == lacks
    same = R.reconcile(state, state.select("business_key"), datetime(2026, 1, 1), datetime(2026, 2, 1))
    assert same.fetched.count() == 0 and same.gone.count() == 0


def test_a_source_may_bring_its_own_digests(spark):
    ours = [(f"k{i}", 3) for i in range(50)]
    keys = spark.createDataFrame([(f"k{i}",) for i in range(1, 50)], "business_key string")
    asked = []

    def own(level):
        asked.append(level)
        return R.digests(keys, level)

    got = R.reconcile(state_of(spark, ours), keys, datetime(2026, 1, 1), datetime(2026, 2, 1), own)
    assert [r.business_key for r in got.gone.collect()] == ["k0"] and asked == [0]


# --- updates by row id, reports --------------------------------------------------------------------------------------


def test_rows_are_updated_by_id_with_their_number(spark, tmp_path):
    path = str(tmp_path / "source.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE lines (code TEXT, status TEXT, done TEXT, batch TEXT)")
        db.executemany("INSERT INTO lines VALUES (?, 'new', NULL, NULL)", [(f"c{i}",) for i in range(20)])
    rows = spark.createDataFrame([(str(i),) for i in [*range(1, 11), 99]] + [("3",), (" ",), (None,)], "rid string")
    back = sinks.status_write_back(rows, "rid", "DONE", T0, "b1")
    written = sinks.update_by_row_id(back, lambda: sqlite3.connect(path, timeout=30), "lines", "rowid", "status", "done", "batch", batch_rows=3)
    assert (written.requested, written.affected) == (11, 10)
    with sqlite3.connect(path) as db:
        assert db.execute("SELECT count(*), min(done), min(batch) FROM lines WHERE status = 'DONE'").fetchone() == (10, "2026-07-06 08:00:00", "b1")
    again = sinks.update_by_row_id(back.drop("done_at", "batch_id"), lambda: sqlite3.connect(path, timeout=30), "lines", "rowid", "status")
    assert again.affected == 10  # the same effect
    with pytest.raises(ValueError, match="identifier"):
        sinks.update_by_row_id(back, lambda: None, "lines; DROP TABLE lines", "rowid", "status")
    assert sinks.update_by_row_id(back.limit(0), lambda: sqlite3.connect(path), "lines", "rowid", "status", "done", "batch").affected == 0


def test_report_of_one_row_stands_on_end(spark):
    one = spark.sql("SELECT 3L AS a, CAST(12.500 AS DECIMAL(18,3)) AS b, CAST(NULL AS TIMESTAMP_NTZ) AS c")
    assert [tuple(r) for r in W.vertical_report(one, ("a", "b", "c"), ("总", "百分比(%)", "x.y"), V.PAIR_HEADERS).collect()] == [("总", "3"), ("百分比(%)", "12.5"), ("x.y", "")]

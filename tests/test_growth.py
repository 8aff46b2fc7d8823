"""What steps read, move and write as tables grow."""

import random
import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sortline.operators import events as E
from sortline.operators import reconcile as R
from sortline.operators import search as S
from sortline.operators import sync
from sortline.plans import rank_index as K
from sortline.plans import wave_totals as T
from sortline.queries import QUERIES
from sortline.sources import fixtures as X
from sortline.sources import key_filters
from sortline.sources import tables
from sortline.sources.versions import Store, retried
from sortline.streaming import scans as stream

from .test_plans import state_of
from .test_store import shown
from .test_warehouse import T0, scan, tasks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_ranges_of_a_large_month_make_few_files(spark, tmp_path):
    rows = tasks(spark, *(dict(id=i, created_time=T0 - timedelta(minutes=i)) for i in range(400)))
    store = Store(spark, f"file://{tmp_path}")
    retried(store, lambda a: K.write_ranked(a, "rows", rows, range_rows=2) or {})
    assert len(K.ranges(store.last(), "rows")) <= 32  # 200 of two rows before
    whole = [r.id for r in S.page(rows, 1, 1000).collect()]
    for number in (1, 17, 40):
        got = K.page_at(store, "rows", number, 10)
        assert [r.id for r in got.rows.collect()] == whole[(number - 1) * 10 : number * 10] and got.total == 400 and len(got.opened) <= 2


def test_keys_are_looked_up_only_in_months_that_others_leave_open(spark, monkeypatch):
    rows = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("k"), F.when(F.col("id") == 7, "202602").otherwise("202601").alias("shard_month"))
    filters = key_filters.build(rows, {"k": F.col("k")})
    assert "SortAggregate" not in plan(filters)
    asked, hits = [], key_filters.hits

    def counted(months, keys):
        asked.append((sorted(r[0] for r in months.select("shard_month").distinct().collect()), keys.count()))
        return hits(months, keys)

    monkeypatch.setattr(key_filters, "hits", counted)
    assert sorted(key_filters.months_hit(filters, rows.select("k"))) == ["202601", "202602"]
    assert asked[0][1] < 100 and asked[1][0] == ["202602"] and asked[0][1] + asked[1][1] == 4000


def test_upserts_move_only_columns_that_are_wanted(spark, sf):
    text = plan(QUERIES["projection_counts"](spark, sf))
    assert not any(c in text for c in ("l_extendedprice", "l_quantity", "o_totalprice", "o_custkey"))


def test_changes_of_columns_that_do_not_count_are_none(spark):
    before = tasks(spark, {}, dict(product_code="p"), dict(barcode="b", status=3))
    after = before.withColumn("product_code", F.lit("q")).withColumn("status", F.when(F.col("id") == 3, 1).otherwise(F.col("status")))
    images = T.changes_between(before, after, columns=T.READ)
    assert images.columns == [*T.READ, T.SIGN] and sorted((r.status, r.sign) for r in images.collect()) == [(1, 1), (3, -1)]
    staged = []
    kept = T.apply_changes(T.wave_totals(before), images, T.tasks_of_waves(after), lambda df: staged.append(df) or df.localCheckpoint())
    want = T.wave_totals(after)
    assert len(staged) == 1 and kept.totals.collect() == want.select(kept.totals.columns).collect()


def test_lines_are_sorted_once(spark, sf):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(X.tasks(spark, sf))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert text.count(" Sort [") == 2 and text.count("Exchange ") == 2  # lines and orders


def test_rows_of_an_order_stay_in_one_file(spark, tmp_path):
    rows = tasks(spark, *(dict(id=i, order_id=str(i // 5)) for i in range(100))).drop("shard_month")
    tables.append_by_month(rows, str(tmp_path / "t"), "created_time", ["order_id"])
    kept = tables.read_months(spark, str(tmp_path / "t")).withColumn("file", F.input_file_name())
    assert kept.count() == 100 and kept.groupBy("order_id").agg(F.countDistinct("file").alias("n")).filter("n > 1").isEmpty()


def ran(query, spark, sf):
    """The plan that a query ended with, without broadcasts by size."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = QUERIES[query](spark, sf)
        df.collect()
        return plan(df).split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_reconciliation_deals_state_and_source_once(spark, sf):
    text = ran("reconciled_deletions", spark, sf)
    assert text.count("FileScan parquet") == 2 and "ReusedExchange" in text  # one for the state and one for the source's keys
    assert not any(c in text for c in ("l_suppkey", "l_quantity", "sha2"))


def test_states_that_are_read_twice_are_made_once(spark, sf):
    assert ran("merge_state", spark, sf).count("FileScan parquet") == 3  # of the state one, of what comes in two


def test_a_bucket_whose_counts_are_far_apart_is_not_parted(spark, monkeypatch):
    monkeypatch.setattr(R, "BUCKETS", 4)
    monkeypatch.setattr(R, "PARTS", 8)
    ours, start, end = [(f"k{i}", 3) for i in range(40)], datetime(2026, 1, 1), datetime(2026, 2, 1)
    state, lacks = state_of(spark, ours), {"k7", "k15"}
    window = [k for k, _ in ours if k not in lacks]
    for more, least, most in ((400, 438, 438), (0, 0, 10)):  # with other keys than the window's all are compared at once, else few are
        keys = spark.createDataFrame([(k,) for k in window + [f"n{i}" for i in range(more)]], "business_key string")
        got = R.reconcile(state, keys, start, end, large=3)
        assert {r.business_key for r in got.gone.collect()} == lacks and least <= got.fetched.count() <= most


def test_deletions_are_the_same_however_buckets_are_parted(spark, monkeypatch):
    monkeypatch.setattr(R, "BUCKETS", 8)
    monkeypatch.setattr(R, "PARTS", 16)
    rng = random.Random(1)
    ours = [(f"k{i}", rng.randrange(0, 9)) for i in range(300)] + [("K7", 1), ("k8", 2), ("k8", 2)]
    theirs = [k.upper() if rng.random() < 0.3 else k for k, d in ours if 2 <= d < 8 and rng.random() < 0.9]
    state, start, end = state_of(spark, ours), datetime(2026, 1, 2), datetime(2026, 1, 8)
    for more in (0, 100, 1000):  # few, some and all buckets are apart by their parts
        keys = spark.createDataFrame([(k,) for k in theirs + theirs[:20] + [f"n{i}" for i in range(more)] + [None]], "business_key string")
        want = shown(sync.deleted_keys(state, keys, start, end), "business_key", "cursor")
        for large in (0, 20):
            assert shown(R.reconcile(state, keys, start, end, large=large).gone, "business_key", "cursor") == want


def test_scans_move_only_tasks_that_may_be_scanned(spark, tmp_path, monkeypatch):
    rows = tasks(spark, *(dict(created_time=datetime(2026, 1 + i % 2, 5), barcode=None if i % 50 == 0 else f"02{i % 10}b{i // 2}", task_code=f"T{i}") for i in range(600)))
    table = stream.scanned_tasks(spark, f"file://{tmp_path}/tasks")
    table.write(rows, 0)
    first = table.store.last().months("rows")
    src = str(tmp_path / "in")
    scan(spark, ("021B5", 5, None), ("021b5 ", 6, None), ("022b6", 7, None), ("02", 8, None), ("??", 9, None)).coalesce(1).write.parquet(src)
    source = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    moved, apply_folded = [], stream.apply_folded
    monkeypatch.setattr(stream, "apply_folded", lambda some, *rest: moved.append(some.count()) or apply_folded(some, *rest))
    stream.apply_scan_stream(source, table, str(tmp_path / "log"), str(tmp_path / "c"), lambda: T0).awaitTermination()
    assert 2 <= moved[0] < 20  # 600 before
    assert shown(table.read()) == shown(E.apply_scans(rows, spark.read.parquet(src), T0).select(table.read().columns))
    after = table.store.last().months("rows")
    assert all(after[m]["places"] != first[m]["places"] and after[m]["filter"] == first[m]["filter"] for m in first)  # rows are new, filters stay
    assert all(f.endswith(".zstd.parquet") for f in table.read().inputFiles())


def test_rows_are_split_by_a_batch_where_they_lie(spark, monkeypatch):
    rows = spark.range(3000).select(F.when(F.col("id") % 100 > 0, F.concat(F.lit("k"), "id")).alias("k"))
    every = [r.k for r in rows.collect()]
    for chunks, most in ((2048, 15), (1, 3000)):  # a filter that is too full tells less, and as rightly
        monkeypatch.setattr(key_filters, "MOST_CHUNKS", chunks)
        asked = {f"k{i}" for i in range(0, 3000, 7)}
        more = [f"other {i}" for i in range(0 if chunks > 1 else 20_000)]
        batch = key_filters.of_batch(spark.createDataFrame([(k,) for k in [*asked, *asked, *more, None]], "code string"))
        may, others = ([r.k for r in part.collect()] for part in key_filters.split(rows, F.col("k"), batch))
        assert sorted(may + others, key=str) == sorted(every, key=str) and None not in may and asked & set(every) <= set(may)
        assert len(set(may) - asked) <= most
    empty = key_filters.of_batch(spark.createDataFrame([(None,)], "code string"))
    assert [part.count() for part in key_filters.split(rows, F.col("k"), empty)] == [0, 3000]


def test_codes_of_orders_without_events_are_not_dealt(spark, sf):
    text = plan(X.scan_events(spark, sf))
    assert all(re.search(rf"{key}#\d+L < Subquery", text) for key in ("l_orderkey", "o_orderkey"))
    few = X.tasks(spark, sf, F.lit(40))
    assert few.count() > 0 and shown(few) == shown(X.tasks(spark, sf).filter("CAST(order_id AS BIGINT) < 40"))

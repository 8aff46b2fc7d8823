"""A remote table by its cursor, as batch and as stream, against the plain read of a window."""

import random
import sqlite3
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sortline.sources import cursor_source as K
from sortline.sources import scans

DAY = datetime(2026, 7, 1)
SCHEMA = "id bigint, code string, at timestamp_ntz"


def made(tmp_path, rows):
    path, clock = str(tmp_path / "source.db"), str(tmp_path / "clock")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE IF NOT EXISTS lines (id INTEGER, code TEXT, at TEXT)")
    add(path, rows)
    table = K.Table(lambda: sqlite3.connect(path, timeout=30), "lines", SCHEMA, "at", lambda t: t.isoformat(" ", "microseconds"), lambda: datetime.fromisoformat(open(clock).read()))
    return path, clock, table


def add(path, rows):
    with sqlite3.connect(path) as db:
        db.executemany("INSERT INTO lines VALUES (?, ?, ?)", [(i, c, t and t.isoformat(" ", "microseconds")) for i, c, t in rows])


@pytest.mark.parametrize("n", [1, 7])
def test_a_batch_is_the_window(spark, tmp_path, n):
    rng = random.Random(n)
    rows = [(i, rng.choice(["a", "b", None]), None if rng.random() < 0.05 else DAY + timedelta(seconds=rng.randrange(0, 86_400, 600))) for i in range(400)]
    _, _, table = made(tmp_path, rows)
    K.register(spark, "cursor_batch", table)
    start, end = DAY + timedelta(hours=2), DAY + timedelta(hours=20)
    got = spark.read.format("cursor_batch").options(start=str(start), end=str(end), partitions=n).load()
    want = scans.incremental(spark.createDataFrame(rows, SCHEMA), "at", start, end)
    assert got.rdd.getNumPartitions() == n
    shown = lambda df: sorted(map(repr, df.collect()))
    assert shown(got) == shown(want)
    some = (F.col("code") == "a") & (F.col("id") > 100) & (F.col("at") >= str(DAY + timedelta(hours=5))) & F.col("id").isin(*range(0, 400, 3)) & F.col("code").startswith("a")
    assert shown(got.filter(some)) == shown(want.filter(some)) and shown(got.filter("code IS NULL")) == shown(want.filter("code IS NULL"))


def test_conditions_go_to_the_source(spark, tmp_path):
    _, _, table = made(tmp_path, [(i, "ab"[i % 2], DAY + timedelta(hours=i)) for i in range(10)])
    reader = K.Batch(table, spark.createDataFrame([], SCHEMA).schema, {"start": str(DAY - timedelta(hours=1)), "end": str(DAY + timedelta(days=1))})
    from pyspark.sql.datasource import EqualTo, StringContains

    left = list(reader.pushFilters([EqualTo(("code",), "a"), StringContains(("code",), "a")]))
    assert left == [StringContains(("code",), "a")] and reader.more == [("code = ?", ["a"])]
    assert [r[0] for w in reader.partitions() for r in reader.read(w)] == [0, 2, 4, 6, 8]


def test_windows_meet():
    for n in (1, 3, 10):
        some = K.windows(DAY, DAY + timedelta(microseconds=7), n)
        assert some[0].start == DAY and some[-1].end == DAY + timedelta(microseconds=7) and all(a.end == b.start and a.start < a.end for a, b in zip(some, some[1:]))
    assert K.windows(DAY, DAY, 3) == []


def test_a_stream_restarts_without_loss_or_repeat(spark, tmp_path):
    path, clock, table = made(tmp_path, [])
    K.register(spark, "cursor_stream", table)
    at = lambda m: DAY + timedelta(minutes=m)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run(now):
        with open(clock, "w") as f:
            f.write(str(now))
        rows = spark.readStream.format("cursor_stream").options(start=str(at(0)), lag_minutes=10, partitions=3).load()
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.id for r in spark.read.schema(SCHEMA).parquet(out).collect())

    add(path, [(1, "a", at(5)), (2, "a", at(20)), (3, "a", at(25)), (0, "a", at(0))])
    assert run(at(30)) == [1, 2]  # up to minute 20; the start isn't read
    add(path, [(4, "late", at(21)), (5, "a", at(33))])  # late, but within the lag
    assert run(at(40)) == [1, 2, 3, 4]
    assert run(at(40)) == [1, 2, 3, 4]
    assert run(at(35)) == [1, 2, 3, 4]  # a clock that went back reads nothing again
    add(path, [(6, "too late", at(2))])
    assert run(at(60)) == [1, 2, 3, 4, 5]
    batch = spark.read.format("cursor_stream").options(start=str(at(0)), end=str(at(50))).load()
    assert sorted(r.id for r in batch.filter("code <> 'too late'").collect()) == [1, 2, 3, 4, 5]

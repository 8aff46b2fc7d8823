"""Tables split by month: reading with pruning, and appending."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C

LEGACY = "legacy"


def months_between(start, end) -> tuple[str, str]:
    """First and last month key that [start, end) touches."""
    first, last = (datetime.fromisoformat(str(t)) for t in (start, end))
    return f"{first:%Y%m}", f"{last - timedelta(microseconds=1):%Y%m}"


def in_months(df: DataFrame, start, end, time: str = "created_time") -> DataFrame:
    """Rows of [start, end). A filter on the time alone prunes no months, so their bounds are added; rows of the legacy month stay."""
    first, last = months_between(start, end)
    month = F.col("shard_month")
    return df.filter(C.in_range(time, start, end) & (month.between(first, last) | (month == LEGACY)))


def read_months(spark: SparkSession, path: str, start=None, end=None, time: str = "created_time") -> DataFrame:
    """A month-partitioned table, of a range if given. shard_month stays a text."""
    df = spark.read.option("basePath", path).parquet(path)
    df = df.withColumn("shard_month", F.col("shard_month").cast("string"))
    return df if start is None else in_months(df, start, end, time)


def with_legacy(months: DataFrame, legacy: DataFrame) -> DataFrame:
    """All months and the table from before there were months."""
    return months.unionByName(legacy.withColumn("shard_month", F.lit(LEGACY)), allowMissingColumns=True)


def append_by_month(df: DataFrame, path: str, time: str, near: list[str] | None = None) -> None:
    """Append rows to the months of their time. Rows are dealt by month and hash, so a month makes few files and a large month isn't one task. near: columns that are hashed, all if None; rows
    that agree in them stay together, so that what they share is moved and kept compressed. No value of them should have many rows."""
    routed = df.withColumn("shard_month", C.month_key(time))
    routed.repartition("shard_month", F.pmod(F.xxhash64(*(near or df.columns)), F.lit(8))).write.partitionBy("shard_month").mode("append").parquet(path)


def month_counts(df: DataFrame, time: str) -> DataFrame:
    """What append_by_month() would add to each month."""
    return df.groupBy(C.month_key(time).alias("shard_month")).agg(F.count("*").cast("long").alias("rows"))

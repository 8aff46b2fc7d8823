"""Reads of a remote source. Sources are DataFrames (spark.read.jdbc or Parquet): filters and columns given here reach the source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C

EQUALS, IS_NULL, IGNORE = "equals", "is_null", "ignore"


def jdbc_source(
    spark: SparkSession, url: str, table: str, properties: dict[str, str], column: str | None = None, low=None, high=None, partitions: int = 1, fetch_rows: int = 5000
) -> DataFrame:
    """A remote table. Filters and columns that are asked for later run there. With a numeric or time column and its bounds the read is dealt into partitions, which take
    the place of pages; rows outside the bounds are read too."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=fetch_rows, **properties)
    if column is not None:
        reader = reader.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=partitions)
    return reader.load()


def incremental(source: DataFrame, cursor: str, start, end) -> DataFrame:
    """Rows whose cursor is in (start, end]."""
    return source.filter((F.col(cursor) > C.ntz(start)) & (F.col(cursor) <= C.ntz(end)))


def keys_of_window(source: DataFrame, keys: list[str], cursor: str, start, end) -> DataFrame:
    """Distinct keys of (start, end]; no other columns are read."""
    return incremental(source, cursor, start, end).select(*keys).distinct()


def rows_of_keys(source: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of the rows whose keys are listed. Spark broadcasts the list if its size allows."""
    return source.join(keys, keys.columns, "left_semi").select(*columns)


def by_status(source: DataFrame, status: str, mode: str, value=None, cursor: str | None = None, start=None, end=None) -> DataFrame:
    """Rows in a state, of the closed window [start, end] if given."""
    if mode == EQUALS:
        source = source.filter(F.col(status) == value)
    elif mode == IS_NULL:
        source = source.filter(F.col(status).isNull())
    elif mode != IGNORE:
        raise ValueError(f"unknown mode: {mode}")
    return source if cursor is None else source.filter(F.col(cursor).between(C.ntz(start), C.ntz(end)))


def without(source: DataFrame, columns: list[str], protected: list[str]) -> DataFrame:
    """Leave columns out. Keys, the cursor and the soft-delete flag are protected."""
    kept = {c.lower() for c in protected}
    if bad := [c for c in columns if c.lower() in kept]:
        raise ValueError(f"protected columns can't be left out: {', '.join(bad)}")
    return source.drop(*columns)

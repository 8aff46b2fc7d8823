"""A remote table by its cursor as a data source of Spark, for batches and for streams.

A batch reads a window (start, end] of the cursor, dealt into partitions that are read where the tasks are; conditions on columns go along with the query. A stream's offsets are cursors: a micro-batch is
the window from the last offset to the present less a lag, so rows that come late, but within the lag, are read, and a restart goes on where the last offset stands. Windows meet end to start, so
nothing is read twice or left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.types import StructType, TimestampNTZType, TimestampType

FETCH = 5_000
SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


@dataclass(frozen=True)
class Table:
    """A remote table. connect() gives a connection of Python's database interface, in the task that reads; schema: columns as a DDL text, of a type that its values have; cursor: a column of times
    (or a text that sorts as they do); stored(): a time as the table has it; clock(): the time at the source; mark: the interface's sign for a value."""

    connect: Callable[[], object]
    name: str
    schema: str
    cursor: str
    stored: Callable[[datetime], object] = lambda t: t
    clock: Callable[[], datetime] = datetime.now
    mark: str = "?"


@dataclass
class Window(InputPartition):
    """Rows with a cursor in (start, end]."""

    start: datetime
    end: datetime


def windows(start: datetime, end: datetime, n: int) -> list[Window]:
    """(start, end] as n windows that meet end to start."""
    if not start < end:
        return []
    n = max(1, min(n, (end - start) // timedelta(microseconds=1)))
    cuts = [start + (end - start) * k // n for k in range(n)] + [end]
    return [Window(a, b) for a, b in zip(cuts, cuts[1:])]


def _condition(f: Filter, table: Table, times: set[str]) -> tuple[str, list] | None:
    """A filter as the source tells it, with its values; None if it can't."""
    if type(f) not in (*SIGNS, In, IsNull, IsNotNull) or len(f.attribute) != 1:
        return None
    (column,) = f.attribute
    if isinstance(f, IsNull | IsNotNull):
        return f"{column} IS {'NOT ' * isinstance(f, IsNotNull)}NULL", []
    given = list(f.value) if isinstance(f, In) else [f.value]
    if not all(isinstance(v, str | int | datetime) and not isinstance(v, bool) for v in given):
        return None
    values = [table.stored(v.replace(tzinfo=None)) if isinstance(v, datetime) or column in times else v for v in given]
    if isinstance(f, In):
        return f"{column} IN ({', '.join([table.mark] * len(values))})", values
    return f"{column} {SIGNS[type(f)]} {table.mark}", values


def _read(table: Table, schema: StructType, window: Window, more: list[tuple[str, list]]) -> Iterator[tuple]:
    conditions = [(f"{table.cursor} > {table.mark} AND {table.cursor} <= {table.mark}", [table.stored(window.start), table.stored(window.end)]), *more]
    statement = f"SELECT {', '.join(schema.names)} FROM {table.name} WHERE {' AND '.join(c for c, _ in conditions)}"
    times = [isinstance(f.dataType, TimestampNTZType | TimestampType) for f in schema.fields]
    connection = table.connect()
    try:
        cursor = connection.cursor()
        cursor.execute(statement, [v for _, values in conditions for v in values])
        while rows := cursor.fetchmany(FETCH):
            for row in rows:
                yield tuple(datetime.fromisoformat(v) if t and isinstance(v, str) else v for v, t in zip(row, times))
    finally:
        connection.close()


class Batch(DataSourceReader):
    def __init__(self, table: Table, schema: StructType, options: dict):
        self.table, self.schema, self.more = table, schema, []
        time = datetime.fromisoformat
        self.windows = windows(time(options["start"]), time(options["end"]), int(options.get("partitions", "1")))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        times = {f.name for f in self.schema.fields if isinstance(f.dataType, TimestampNTZType | TimestampType)}
        for f in filters:
            told = _condition(f, self.table, times)
            if told is None:
                yield f
            else:
                self.more.append(told)

    def partitions(self) -> list[Window]:
        return self.windows

    def read(self, partition: Window) -> Iterator[tuple]:
        return _read(self.table, self.schema, partition, self.more)


class Stream(DataSourceStreamReader):
    def __init__(self, table: Table, schema: StructType, options: dict):
        self.table, self.schema = table, schema
        self.start = options["start"]
        self.lag, self.n = timedelta(minutes=float(options.get("lag_minutes", "0"))), int(options.get("partitions", "1"))

    def initialOffset(self) -> dict:
        return {"cursor": self.start}

    def latestOffset(self) -> dict:
        """The present less the lag, and never before the start."""
        return {"cursor": str(max(self.table.clock() - self.lag, datetime.fromisoformat(self.start)))}

    def partitions(self, start: dict, end: dict) -> list[Window]:
        return windows(datetime.fromisoformat(start["cursor"]), datetime.fromisoformat(end["cursor"]), self.n)

    def read(self, partition: Window) -> Iterator[tuple]:
        return _read(self.table, self.schema, partition, [])

    def commit(self, end: dict) -> None:
        """The checkpoint of the query holds the offset; the source keeps none."""


def register(spark: SparkSession, name: str, table: Table) -> None:
    """Make the table a format of the session. spark.read.format(name) takes options start and end, spark.readStream.format(name) start and lag_minutes, both partitions."""

    class CursorSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return table.schema

        def reader(self, schema: StructType) -> DataSourceReader:
            return Batch(table, schema, self.options)

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:
            return Stream(table, schema, self.options)

    spark.dataSource.register(CursorSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

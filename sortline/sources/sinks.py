"""Rows as they go to the outside, and writers for them."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed as V


def status_write_back(rows: DataFrame, row_id: str, done: str, now=None, batch_id: str | None = None) -> DataFrame:
    """Updates that mark source rows as done: row_id, new_status and, if given, done_at and batch_id. Rows without an id are left out."""
    out = rows.filter(C.blank_to_null(row_id).isNotNull()).select(F.col(row_id).alias("row_id"), F.lit(done).alias("new_status")).distinct()
    if now is not None:
        out = out.withColumn("done_at", C.ntz(now))
    return out if batch_id is None else out.withColumn("batch_id", F.lit(batch_id))


def feedback_write_back(tasks: DataFrame, targets: dict[int, str], columns: dict[str, str]) -> DataFrame:
    """Feedback rows with the target that their source type goes to. columns: output name -> task column. An unknown source type fails the job."""
    unknown = ~F.col("source_type").isin(*targets)
    target = C.mapped("source_type", targets, "")
    checked = F.when(unknown, F.raise_error(F.concat(F.lit("no target for source type "), F.col("source_type")))).otherwise(target)
    return tasks.select(checked.alias("target"), "business_key", *(F.col(c).alias(n) for n, c in columns.items()))


def write_rows(df: DataFrame, write_batch, batch_rows: int = 500) -> None:
    """Hand rows to write_batch(list of rows) where they are, some at a time. write_batch must bear being called again with the same rows."""

    def run(rows) -> None:
        held = []
        for r in rows:
            held.append(r)
            if len(held) == batch_rows:
                write_batch(held)
                held = []
        if held:
            write_batch(held)

    df.foreachPartition(run)


@dataclass(frozen=True)
class Updated:
    requested: int
    affected: int


IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_$#]*(\.[A-Za-z_][A-Za-z0-9_$#]*)?")


def update_by_row_id(
    updates: DataFrame, connect: Callable[[], object], table: str, row_id: str, status: str, done_at: str | None = None, batch_id: str | None = None, batch_rows: int = 500, mark: str = "?"
) -> Updated:
    """Mark rows of a remote table by row id with what status_write_back() gives, and tell how many were there to be marked. connect() gives a connection of Python's database interface
    where the rows are; names are those of the remote columns, `mark` its sign for a value. Each task commits for itself, in batches; a task that runs again marks the same rows."""
    given = {status: "new_status"} | ({done_at: "done_at"} if done_at else {}) | ({batch_id: "batch_id"} if batch_id else {})
    for name in (table, row_id, *given):
        if not IDENTIFIER.fullmatch(name):
            raise ValueError(f"not a safe identifier: {name}")
    statement = f"UPDATE {table} SET {', '.join(f'{c} = {mark}' for c in given)} WHERE {row_id} = {mark}"
    wanted = updates.select(*(F.col(c).cast("string") for c in given.values()), F.col("row_id").cast("string"))

    def run(batches):
        requested = affected = 0
        connection = None
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            for at in range(0, len(rows), batch_rows):
                connection = connection or connect()
                cursor = connection.cursor()
                cursor.executemany(statement, rows[at : at + batch_rows])
                connection.commit()
                requested, affected = requested + len(rows[at : at + batch_rows]), affected + max(0, cursor.rowcount)
        if connection:
            connection.close()
        yield pa.RecordBatch.from_arrays([pa.array([requested]), pa.array([affected])], names=["requested", "affected"])

    done = wanted.mapInArrow(run, "requested long, affected long").agg(F.coalesce(F.sum("requested"), F.lit(0)), F.coalesce(F.sum("affected"), F.lit(0))).first()
    return Updated(*done)


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str]) -> None:
    df.write.jdbc(url, table, mode="append", properties=properties | {"batchsize": "500"})


def seed(existing: DataFrame, requested: DataFrame, key: str, month: str) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, counts of requested, blank, duplicate, skipped and inserted). Keys count once, trimmed; those that the target month has already are skipped."""
    keyed = requested.withColumn(key, C.blank_to_null(key))
    distinct = keyed.filter(F.col(key).isNotNull()).dropDuplicates([key])
    there = existing.filter(F.col("shard_month") == month).select(key).distinct()
    marked = distinct.join(there.withColumn("there", F.lit(True)), key, "left")
    n = F.count("*").cast("long")
    counts = (
        keyed.agg(n.alias("requested"), F.count_if(F.col(key).isNull()).cast("long").alias("blank"))
        .crossJoin(marked.agg(n.alias("distinct"), F.count_if(F.col("there")).cast("long").alias("skipped")))  # one row each
        .select("requested", "blank", (F.col("requested") - F.col("blank") - F.col("distinct")).alias("duplicate"), "skipped", (F.col("distinct") - F.col("skipped")).alias("inserted"))
    )
    return marked.filter(F.col("there").isNull()).drop("there").withColumn("shard_month", F.lit(month)), counts


ROUTES = {V.SPLIT: "split_feedback", V.FULL_CASE: "full_case_feedback"}

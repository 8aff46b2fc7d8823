"""Pages at any depth by counts of sorted ranges.

A ranked table keeps each month as files that are ranges of its rows, the newest first, and the commit lists rows and bounds of each. Running sums of these tell which files a page lies in, so a
page opens one or two ranges however deep it is. For a filtered search the rows of each range that pass are counted first, by the columns of the filter alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.search import newest_first
from ..sources.tables import LEGACY
from ..sources.versions import Attempt, Commit, Store

RANGE_ROWS = 100_000


def write_ranked(attempt: Attempt, table: str, rows: DataFrame, months: list[str] | None = None, time: str = "created_time", range_rows: int = RANGE_ROWS) -> None:
    """Replace the months of a ranked table, of rows with `time` and id. Months follow each other as their times do. Ranges have `range_rows` rows, and more in a table whose
    months would have more than 16 of fewer than 100,000 rows: else their number would grow with the table."""
    attempt.replace(table, rows, months, time=time, rows_per_file=range_rows)


@dataclass(frozen=True)
class Range:
    month: str
    file: str
    rows: int


def ranges(at: Commit, table: str, months: list[str] | None = None) -> list[Range]:
    """All ranges of a table, the newest first; the legacy month comes last."""
    out = []
    known = at.months(table)
    for month in sorted((m for m in known if months is None or m in months), key=lambda m: (m != LEGACY, m), reverse=True):
        held = known[month]
        if not held.get("ranked"):
            raise ValueError(f"month {month} of {table} isn't ranked")
        low = -math.inf
        order = lambda b: (low if b[1] is None else b[1], low if b[4] is None else b[4])
        out += [Range(month, f, b[2]) for f, b in sorted(held["files"].items(), key=lambda x: order(x[1]), reverse=True)]
    return out


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    total: int
    opened: list[Range]


def page_at(store: Store, table: str, number: int, size: int, where: Column | None = None, months: list[str] | None = None, time: str = "created_time", at: Commit | None = None) -> Page:
    """Page `number` (from 1) of a ranked table, newest first, of the rows for which `where` holds; total: how many those are."""
    at = at or store.last()
    known = ranges(at, table, months)
    root = store.files.root
    every = store.read(table, at=at)
    if where is not None and known:
        counted = every.sparkSession.read.schema(every.schema).parquet(*(f"{root}/{r.file}" for r in known)).filter(where).groupBy(F.col("_metadata.file_path").alias("f")).count().collect()  # a row for each range
        passing = {"data/" + row["f"].rsplit("/data/", 1)[1]: row["count"] for row in counted}
        known = [Range(r.month, r.file, passing[r.file]) for r in known if r.file in passing]
    first, before, opened, skipped = (number - 1) * size, 0, [], 0
    for r in known:
        if before + r.rows > first and before < first + size:
            if not opened:
                skipped = before
            opened.append(r)
        before += r.rows
    if not opened:
        return Page(every.limit(0), before, [])
    rows = every.sparkSession.read.schema(every.schema).parquet(*(f"{root}/{r.file}" for r in opened))
    rows = rows if where is None else rows.filter(where)
    return Page(rows.orderBy(*newest_first(time)).offset(first - skipped).limit(size), before, opened)

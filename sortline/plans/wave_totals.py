"""Totals of waves kept up by signed changes.

A change is a task as it was (sign -1) or as it is from now on (sign 1). Counts and sums move by their signed sums. The first creation time and the newest remark can't be taken back that way: where
a change takes away what holds one of them, and brings nothing as good, the wave is marked, and its tasks alone are read again.

Totals are kept for codes as they are written; those that are equal ignoring case are put together when they are shown.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed as V
from ..operators import aggregates as A

SUMS = ("volume_mm3", "weight_gram")
DECIMAL = "decimal(28,3)"
#: Task columns that totals are made of.
READ = ("wave_code", "wave_remark", "source_type", "status", "scanned_at", "resolved_dock_code", "is_exception", "created_time", "updated_time", *SUMS)
SIGN = "sign"


def _counted() -> dict[str, Column]:
    """What each count of a wave counts."""
    full, split, unsorted = F.col("source_type") == V.FULL_CASE, F.col("source_type") == V.SPLIT, ~C.is_sorted()
    return {
        "total": F.lit(True),
        "unsorted": unsorted,
        "full_case_total": full,
        "full_case_unsorted": full & unsorted,
        "split_total": split,
        "split_unsorted": split & unsorted,
        "recognised": F.col("scanned_at").isNotNull(),
        "recirculated": C.is_recirculated_dock(),
        "exceptions": C.is_exceptional(),
        "cleanable": C.is_cleanable(),
    }


COUNTS = ("total", "unsorted", "full_case_total", "full_case_unsorted", "split_total", "split_unsorted", "recognised", "recirculated", "exceptions", "cleanable")


def _remark() -> Column:
    """(updated_time, remark) of a task that has one."""
    remark = C.blank_to_null("wave_remark")
    return F.when(remark.isNotNull(), F.struct(F.col("updated_time").alias("at"), remark.alias("remark")))


def _signed(changes: DataFrame) -> DataFrame:
    """Changes summed up by wave: each count and sum, and of either sign the first creation time and the newest remark."""
    plus, minus = F.col(SIGN) > 0, F.col(SIGN) < 0
    return (
        changes.filter(C.normalized_wave().isNotNull())
        .groupBy(C.normalized_wave().alias("wave"))
        .agg(
            *(F.sum(F.when(F.coalesce(c, F.lit(False)), F.col(SIGN)).otherwise(0)).cast("long").alias(n) for n, c in _counted().items()),
            *(F.coalesce(F.sum(F.col(n) * F.col(SIGN)), F.lit(0)).cast(DECIMAL).alias(n) for n in SUMS),
            F.min(F.when(plus, F.col("created_time"))).alias("first_in"),
            F.min(F.when(minus, F.col("created_time"))).alias("first_out"),
            F.max(F.when(plus, _remark())).alias("remark_in"),
            F.max(F.when(minus, _remark())).alias("remark_out"),
        )
    )


def wave_totals(tasks: DataFrame) -> DataFrame:
    """Totals of all waves: wave, counts, sums, earliest_created and newest (updated_time and remark)."""
    made = _signed(tasks.withColumn(SIGN, F.lit(1)))
    return made.select("wave", *COUNTS, *SUMS, F.col("first_in").alias("earliest_created"), F.col("remark_in").alias("newest"))


@dataclass(frozen=True)
class Kept:
    """totals after the changes; reread: the waves whose tasks had to be read again."""

    totals: DataFrame
    reread: DataFrame


def apply_changes(totals: DataFrame, changes: DataFrame, tasks_of: Callable[[DataFrame], DataFrame], stage: Callable[[DataFrame], DataFrame] = lambda df: df) -> Kept:
    """Totals after signed changes. tasks_of(waves): tasks after the changes of the waves listed (column wave), which are few; it is asked once. stage: keeps the moved totals, a row for each
    wave, as they are read twice; else totals and changes are made twice."""
    delta = _signed(changes)
    both = totals.select("wave", *(F.col(c).alias(f"o_{c}") for c in (*COUNTS, *SUMS, "earliest_created", "newest"))).join(delta, "wave", "full")
    summed = lambda n, zero: (F.coalesce(f"o_{n}", zero) + F.coalesce(n, zero)).alias(n)
    # gone: what held the extreme was taken away, and nothing as good came
    late = F.col("first_in").isNull() | (F.col("first_in") > F.col("o_earliest_created"))
    old_news = F.col("remark_in").isNull() | (F.col("remark_in") < F.col("o_newest"))
    gone = (F.coalesce(F.col("first_out") <= F.col("o_earliest_created"), F.lit(False)) & late) | (F.coalesce(F.col("remark_out") >= F.col("o_newest"), F.lit(False)) & old_news)
    moved = stage(both.select(
        "wave",
        *(summed(n, F.lit(0).cast("long")) for n in COUNTS),
        *(summed(n, F.lit(0).cast(DECIMAL)).cast(DECIMAL).alias(n) for n in SUMS),
        F.least("o_earliest_created", "first_in").alias("earliest_created"),
        F.greatest("o_newest", "remark_in").alias("newest"),
        gone.alias("gone"),
    ).filter("total > 0"))
    marked = moved.filter("gone").select("wave")
    again = wave_totals(tasks_of(marked)).select("wave", F.struct("earliest_created", "newest").alias("found"))
    out = moved.join(again, "wave", "left")
    kept = lambda c: F.when(F.col("gone"), F.col(f"found.{c}")).otherwise(F.col(c)).alias(c)
    return Kept(out.select("wave", *COUNTS, *SUMS, kept("earliest_created"), kept("newest")), marked)


def tasks_of_waves(tasks: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Reader of the tasks of some waves, of a table at hand."""
    return lambda waves: tasks.join(waves.select(F.col("wave").alias("__wave")), C.normalized_wave() == F.col("__wave"), "left_semi")


def changes_between(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ("id", "shard_month"), columns: tuple[str, ...] | None = None) -> DataFrame:
    """Signed images of the rows that two states of a table, or of its touched months, don't share. Rows are held against each other by key, and those that are equal left out. columns: those
    that count and that images have, all if None; totals want READ."""
    columns = columns or before.columns
    old = before.select(*(F.col(k).alias(f"k_{k}") for k in keys), F.struct(*columns).alias("old"))
    new = after.select(*(F.col(k).alias(f"k_{k}") for k in keys), F.struct(*columns).alias("new"))
    both = old.join(new, [f"k_{k}" for k in keys], "full").filter(~F.col("old").eqNullSafe(F.col("new")))
    images = F.array(F.struct(F.lit(-1).alias(SIGN), F.col("old").alias("row")), F.struct(F.lit(1).alias(SIGN), F.col("new").alias("row")))
    return both.select(F.explode(images).alias("i")).filter("i.row IS NOT NULL").select("i.row.*", f"i.{SIGN}")


def shown(totals: DataFrame) -> DataFrame:
    """Totals as A.by_code() shows them: codes that are equal ignoring case together, under the least."""
    one = totals.groupBy(C.key_text("wave").alias("key")).agg(
        F.min("wave").alias("wave_code"),
        *(F.sum(n).cast("long").alias(n) for n in COUNTS),
        *(F.sum(n).cast(DECIMAL).alias(n) for n in SUMS),
        F.min("earliest_created").alias("earliest_created"),
        F.max("newest").alias("newest"),
    )
    return one.select("wave_code", *(n for n in A.measures()), "cleanable", F.col("newest.remark").alias("wave_remark"))


def cleanable_waves(totals: DataFrame) -> DataFrame:
    """A.cleanable_waves() of kept totals."""
    return shown(totals).filter("cleanable > 0")

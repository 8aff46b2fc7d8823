"""Deletions by set reconciliation.

Both sides deal their keys into buckets by hash and sum each bucket up in an order-free digest. Buckets whose digests agree hold the same keys and are left alone; large ones that differ are
parted once more, unless their counts alone tell that most parts would differ too; of what is left the keys themselves are compared. The source's keys are dealt by their text once, for
digests and comparison alike.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

#: Buckets at the first level, and into which a large one is parted, powers of two; a bucket of more keys is large. Two partings tell 2^30 buckets apart.
BUCKETS, PARTS, LARGE, LEVELS = 1 << 12, 1 << 9, 1_000, 3


def key_hash() -> Column:
    return F.xxhash64(C.key_text("business_key"))


def bucket(level: int) -> Column:
    """The bucket of a key hash at a level, as one number. Buckets of the next level part those of this."""
    return F.col("hash").bitwiseAND(F.lit(BUCKETS * PARTS**level - 1))  # never null, so no join asks and what it reads stays the same for all


def texts(keys: DataFrame) -> DataFrame:
    """business_key: the distinct texts by which keys are compared."""
    return keys.select(C.key_text("business_key").alias("business_key")).distinct()


def digests(keys: DataFrame, level: int = 0) -> DataFrame:
    """bucket, n, crossed and summed of distinct keys, ignoring case; a key that repeats counts once. Two hashes of 64 bits agree for sets that differ about once in 2^128 buckets."""
    return _digests(texts(keys), level)


def _digests(distinct: DataFrame, level: int) -> DataFrame:
    """digests() of texts()."""
    hashed = distinct.select(F.xxhash64("business_key").alias("hash"), F.xxhash64("business_key", F.lit("second")).alias("other"))
    return hashed.groupBy(bucket(level).alias("bucket")).agg(F.count("*").alias("n"), F.bit_xor("hash").alias("crossed"), F.sum(F.col("other").cast("decimal(38,0)")).alias("summed"))


def differing(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """bucket, n (keys of ours) and apart (so many keys at least are on one side alone) of the digests that differ."""
    both = ours.join(theirs.select("bucket", *(F.col(c).alias(f"t_{c}") for c in ("n", "crossed", "summed"))), "bucket", "full")
    same = F.col("n").eqNullSafe(F.col("t_n")) & F.col("crossed").eqNullSafe(F.col("t_crossed")) & F.col("summed").eqNullSafe(F.col("t_summed"))
    n, of_theirs = F.coalesce("n", F.lit(0)), F.coalesce("t_n", F.lit(0))
    return both.filter(~same).select("bucket", n.alias("n"), F.abs(n - of_theirs).alias("apart"))


@dataclass(frozen=True)
class Reconciled:
    """gone: rows of ours whose key theirs lacks; fetched: the keys of theirs that were looked at."""

    gone: DataFrame
    fetched: DataFrame


def _within(rows: DataFrame, level: int, wanted: DataFrame, hashed: Column, how: str) -> DataFrame:
    """Rows whose key, by its hash, falls into one of the buckets."""
    at = wanted.select(F.col("bucket").alias("at"))
    at = at if level else F.broadcast(at)  # BUCKETS at most, and rows needn't be dealt by bucket first
    return rows.withColumn("hash", hashed).withColumn("at", bucket(level)).join(at, "at", how).drop("at", "hash")


def _held(rows: DataFrame, level: int, wanted: DataFrame) -> DataFrame:
    """Rows of ours in the buckets."""
    return _within(rows, level, wanted, key_hash(), "left_semi")


def _fetched(distinct: DataFrame, level: int, wanted: DataFrame) -> DataFrame:
    """Those of texts() in the buckets. A bucket is wanted once, so an inner join does; a semi join would be made before the texts are distinct, and they would be dealt anew for each use."""
    return _within(distinct, level, wanted, F.xxhash64("business_key"), "inner")


def reconcile(state: DataFrame, source_keys: DataFrame, start, end, source_digests: Callable[[int], DataFrame] | None = None, large: int = LARGE) -> Reconciled:
    """deleted_keys() by digests: state rows with a cursor in (start, end] whose key the source lacks. source_keys are the source's keys of the window or of more than it.

    source_digests(level): digests() as the source has them, if it keeps or computes its own of just the window's keys; else they are made of source_keys. Keys of the source
    that the state lacks make their buckets differ too, so a source with more than the window's keys costs fetches, not results. A bucket that has a key on one side alone for each
    of its parts isn't parted, as most parts would be fetched all the same."""
    ours = state.filter((F.col("cursor") > C.ntz(start)) & (F.col("cursor") <= C.ntz(end)))
    theirs, gone, fetched = texts(source_keys), None, None
    for level in range(LEVELS):
        found = differing(digests(ours, level), source_digests(0) if source_digests and not level else _digests(theirs, level))
        last = level == LEVELS - 1
        parted = F.lit(False) if last else (F.col("n") > large) & (F.col("apart") < PARTS)
        small = found.filter((F.col("n") > 0) & ~parted)  # where we have none, none can be gone
        keys = _fetched(theirs, level, small)
        there = keys.select(F.col("business_key").alias("there"))
        some = _held(ours, level, small).join(there, C.key_text("business_key") == F.col("there"), "left_anti")
        gone, fetched = (some, keys) if gone is None else (gone.unionByName(some), fetched.unionByName(keys))
        if not last:
            big = found.filter(parted)
            ours, theirs = _held(ours, level, big), _fetched(theirs, level, big)
    return Reconciled(gone, fetched)

"""Mixing sources to target weights by weighted fair queueing.

Every source offers its documents as one stream in shuffled order, whole and again until it is past its target. A document's virtual finish time is
(words its source has offered up to its end) / (target of the source). The documents of all sources are sorted by that time, which interleaves the sources in proportion to
their targets, and the mix is the first words of that order, up to the budget. A document that its source is in the midst of when the targets are met, at virtual time 1, is
offered in packets, each with its own finish time; so the cut meets all sources at near the same time, however long their documents are.

No step holds a source together: running sums are taken inside slices of the shuffled order (a hash prefix), and
slice totals are added up apart. The global order is dealt by equal ranges of virtual time, which hold near equal words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, materialize

WEIGHTS = (5, 2, 1)
#: Packets that a document is offered in if the targets are met in its midst: a source is that part of one document from its target at most.
PACKETS = 256
FINER = 64
#: Rows that one slice of a source or of virtual time holds about.
SLICE_ROWS = 20_000


def source_targets(sizes: DataFrame, budget: int, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """sizes (source, source_size) with weight and target: shares of the budget by weight, where a target stops at `most`
    times its source and the excess is shared anew by weight. Sources take the weights in turn by code point, null last.

    In order of most * size / weight, sources stop as long as the level of the rest, (budget - stopped) / (weights left), is above.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(F.lit(0))
    turn = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    cap, weight = F.col("cap"), F.col("weight")
    level = (F.lit(budget) - (F.sum(cap).over(by_cap) - cap)).cast("double") / (F.sum(weight).over(every) - (F.sum(weight).over(by_cap) - weight)).cast("double")
    return (
        sizes.withColumn("weight", turn.cast("long"))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("ratio", cap.cast("double") / weight)
        .withColumn("own_level", level)
        .withColumn("level", F.max(F.when(F.col("ratio") >= F.col("own_level"), F.col("own_level"))).over(every))
        .withColumn("target", F.when((F.col("source_size") == 0) | F.col("level").isNull() | (F.col("ratio") < F.col("level")), cap.cast("double")).otherwise(weight * F.col("level")))
        .select("source", "source_size", "weight", "target")
    )


def mix(
    docs: DataFrame,
    budget: int | None = None,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = 3,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """For every row: doc_id, text_key (xxhash64 of the text), source, size, source_size, target, taken, and parts, a list of
    (at, words) for each copy that the mix takes: its place in the mix, counted in words, and how many words of it there are, which is all but for the last
    copies of a source. taken <= most * size. The budget is all words unless another is given; the mix has as many, or all that `most` copies of all documents have.

    Null and blank texts have size 0 and are taken 0 times. A null source is a source of its own. Repeated rows are
    separate documents with equal rank. Null ids are shuffled by their text. No rows give no rows. Other columns are ignored.
    """
    rows = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.xxhash64(text_col).alias("text_key"),
            F.col(source_col).cast("string").alias("source"),
            count_words(F.col(text_col)).alias("size"),
            F.md5(F.concat_ws("#", F.coalesce(F.col(id_col).cast("string"), F.md5(F.col(text_col).cast("string"))), F.lit(str(seed)))).alias("turn"),
        ).withColumn("turn", F.when(F.col("size") > 0, F.col("turn")).otherwise(F.md5(F.monotonically_increasing_id().cast("string")))),  # without words no turn matters
        "sizes",
    )
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    budget = total if budget is None else budget
    digits = max(2, math.ceil(math.log(max(n / SLICE_ROWS, 1), 16)))
    rows = rows.withColumn("slice", F.substring("turn", 1, digits)).withColumn("stream", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    sliced = materialize(rows.groupBy("stream", "source", "slice").agg(F.sum("size").alias("words")), "slices")
    targets = source_targets(sliced.groupBy("source").agg(F.sum("words").alias("source_size")), budget, weights, most)
    before = Window.partitionBy("stream").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sliced = sliced.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))).select("stream", "slice", "before")
    targets = targets.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("stream"), "source_size", "target")
    order = Window.partitionBy("stream", "slice").orderBy("turn", "doc_id", "size", "text_key")
    offered = (
        rows.withColumn("nth", F.row_number().over(order))
        .withColumn("inside", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
        .join(sliced.join(targets, "stream"), ["stream", "slice"])
        .withColumn("start", F.col("before") + F.col("inside"))
    )
    copies = F.flatten(F.array(*(_offers(k, F.col("start") + k * F.col("source_size")) for k in range(most))))
    key = ["stream", "slice", "nth", "doc_id", "text_key", "source", "size", "source_size", "target"]
    copies = offered.select(*key, F.explode_outer(copies).alias("copy")).select(*key, "copy.k", "copy.words", "copy.upto", "copy.finish")
    placed = _range_sort(materialize(copies, "copies"), max(256, math.ceil(n / SLICE_ROWS)))
    kept = F.greatest(F.lit(0), F.least("words", F.lit(budget) - F.col("at"))).cast("long")
    packets = F.collect_list(F.when(kept > 0, F.struct("k", "at", kept.alias("words"))))
    of = lambda k: F.filter("packets", lambda x: x.k == k)
    words = lambda k: F.aggregate(of(k), F.lit(0).cast("long"), lambda n, x: n + x.words)
    parts = F.filter(F.array(*(F.struct(F.array_min(F.transform(of(k), lambda x: x["at"])).alias("at"), words(k).alias("words")) for k in range(most))), lambda x: x.words > 0)
    return (
        placed.groupBy(*key)
        .agg(F.coalesce(F.sum(kept), F.lit(0)).cast("long").alias("taken"), packets.alias("packets"))
        .withColumn("parts", parts)
        .drop("stream", "slice", "nth", "packets")
    )


def _offers(k: int, start: Column) -> Column:
    """What a source offers of a document's copy k, which begins at `start` in its stream: nothing if its target is met by then, the whole copy if it isn't before its end,
    else packets."""
    size, target = F.col("size"), F.col("target")
    entry = lambda words, upto: F.struct(F.lit(k).alias("k"), words.cast("long").alias("words"), upto.cast("long").alias("upto"), F.try_divide(upto.cast("double"), target).alias("finish"))
    n = F.least(size, F.lit(PACKETS))
    cut = lambda i: F.floor(size * i / n)
    packets = F.transform(F.sequence(F.lit(0), n - 1), lambda i: entry(cut(i + 1) - cut(i), start + cut(i + 1)))
    none = F.array().cast("array<struct<k:int,words:bigint,upto:bigint,finish:double>>")
    return F.when((size == 0) | (start >= target), none).when(start + size <= target, F.array(entry(size, start + size))).otherwise(packets)


def _range_sort(copies: DataFrame, ranges: int) -> DataFrame:
    """copies with at: the words before each in the order of finish. Rows without words have none. Packets, of one document of each source, are many around time 1: there
    the ranges are `FINER` times as fine."""
    spot = F.col("finish") * ranges
    range_ = F.when(spot < ranges - 1, F.floor(spot) * FINER).otherwise(F.floor(F.least(spot, F.lit(4.0 * ranges)) * FINER))
    copies = copies.withColumn("range", F.when(F.col("words").isNull(), -1 - F.col("nth") % ranges).otherwise(range_).cast("long"))
    sums = copies.filter("range >= 0").groupBy("range").agg(F.sum("words").alias("all"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("range", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("before"))
    order = Window.partitionBy("range").orderBy("finish", "stream", "slice", "nth", "upto").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return copies.withColumn("upto", F.sum("words").over(order)).join(sums, "range", "left").withColumn("at", F.col("before") + F.col("upto") - F.col("words"))

"""Sharding by a minimax contiguous partition of atomic groups.

Equal texts form a group, which no shard boundary parts. Groups stand in one order: first those above their fair share (all bytes left / shards left), largest first,
as each would raise the capacity of all, then the others by the hash of their text. Shards are contiguous in that order. A group above its share is a shard of its own; for the others
the smallest capacity is searched for which a greedy walk needs no more than the shards there are, and at that capacity they are cut, as evenly as it allows.

Groups and their running sums stay in a table. The search knows it by cells, ranges of running sums of which there are a bounded number, walks with what they tell for sure, and
opens only the cells that a walk ends in: one or two jobs for all capacities.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SHARDS = 8
#: Cells that the search knows the groups by at the start, and that it opens one into; it opens so many at once.
CELLS = 1 << 14
OPENED = 16
#: Rows that one cell of a shard, or one range of groups, holds about.
CELL_ROWS = 20_000


def _running(groups: DataFrame, rows: int) -> DataFrame:
    """groups in the order of key with upto: the bytes up to and with each. Sums inside ranges of the key, then over ranges."""
    digits = max(1, math.ceil(math.log(max(rows / CELL_ROWS, 1), 16)))
    ranged = groups.withColumn("range", F.substring("key", 1, digits))
    inside = Window.partitionBy("range").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("range").agg(F.sum("bytes").alias("all"))
    sums = sums.select("range", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("before"))
    out = ranged.withColumn("inside", F.sum("bytes").over(inside)).join(sums, "range")
    return out.select("key", "bytes", (F.col("before") + F.col("inside")).alias("upto")).sortWithinPartitions("upto")


class Ends:
    """Where groups end, in bytes of the order, by cells (least end, greatest end) that are sorted and don't overlap. A cell of one end is known."""

    def __init__(self, sums: DataFrame, total: int):
        self.sums, self.total = sums, total
        self.least, self.most = [0], [0]  # before the first group
        self._add(self._cells([(1, total)]))

    def _cells(self, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Finer cells of spans of ends."""
        end, spot = F.col("upto"), F.lit(None)
        for n, (low, high) in enumerate(spans):
            spot = F.when(end.between(low, high), n * 2 * CELLS + F.floor((end - low) / max(1, -(-(high - low + 1) // CELLS)))).otherwise(spot)
        got = self.sums.withColumn("spot", spot).filter(F.col("spot").isNotNull()).groupBy("spot").agg(F.min(end).alias("least"), F.max(end).alias("most"))
        return sorted((r["least"], r["most"]) for r in got.collect())

    def _add(self, cells: list[tuple[int, int]]) -> None:
        for name, i in (("least", 0), ("most", 1)):
            setattr(self, name, sorted([*getattr(self, name), *(c[i] for c in cells)]))

    def open(self, at: set[int]) -> None:
        """Open the cells of these numbers."""
        some = sorted(at)[:OPENED]
        spans = [(self.least[k], self.most[k]) for k in some]
        self.least = [x for k, x in enumerate(self.least) if k not in some]
        self.most = [x for k, x in enumerate(self.most) if k not in some]
        self._add(self._cells(spans))

    def upto(self, x: int) -> tuple[int, int, int | None]:
        """Bounds of the last end up to x, and the cell to open to tell more."""
        k = bisect_right(self.least, x) - 1
        if x >= self.most[k]:
            return self.most[k], self.most[k], None
        return self.least[k], x, k

    def last(self, x: int) -> int:
        """The last end up to x."""
        while True:
            low, high, cell = self.upto(x)
            if cell is None:
                return high
            self.open({cell})

    def first(self, x: int) -> int:
        """The first end from x on."""
        while True:
            k = bisect_left(self.most, x)
            if x <= self.least[k]:
                return self.least[k]
            self.open({k})

    def feasible(self, capacity: int, shards: int) -> tuple[bool | None, set[int]]:
        """Whether a greedy walk reaches all groups, or None and the cells to open."""
        low, high, unknown = 0, 0, set()
        for _ in range(shards):
            low, _, a = self.upto(min(self.total, low + capacity))
            _, high, b = self.upto(min(self.total, high + capacity))
            unknown |= {a, b} - {None}
        return (True if low == self.total else False if high < self.total else None), unknown


def capacity_of(ends: Ends, shards: int, largest: int) -> int:
    """The smallest capacity for which a greedy walk needs no more than the shards."""
    fair = -(-ends.total // shards)
    low, high = max(fair, largest), fair + largest  # the latter is always enough
    while low < high:
        # below `sure` no capacity is enough, from `enough` on all are; what is between depends on unopened cells
        sure, enough, unknown = low, high, set()
        for bound in ("sure", "enough"):
            a, b = (low, high) if bound == "sure" else (sure, high)
            while a < b:
                mid = (a + b) // 2
                answer, cells = ends.feasible(mid, shards)
                unknown |= cells if answer is None else set()
                if answer is False or bound == "enough" and answer is None:
                    a = mid + 1
                else:
                    b = mid
            sure, enough = (a, enough) if bound == "sure" else (sure, a)
        low, high = sure, enough
        if low < high:
            ends.open(unknown)
    return low


def cuts_of(ends: Ends, shards: int, largest: int) -> list[int]:
    """Where the shards end at the smallest capacity. The greedy walk leaves what is short to the last shard; here each ends as near to an equal share of what is left as
    the capacity, its own and of those after it, allows."""
    capacity, total = capacity_of(ends, shards, largest), ends.total
    early = [total]  # from the back: the first places where the shards may be cut
    for _ in range(shards - 1):
        early.insert(0, ends.first(early[0] - capacity) if early[0] > capacity else 0)
    cuts = [0]
    for k, least in enumerate(early[:-1], 1):
        share = cuts[-1] + (total - cuts[-1]) // (shards - k + 1)
        fits = [c for c in (ends.last(share), ends.first(share), least) if max(least, cuts[-1]) <= c <= cuts[-1] + capacity]
        cuts.append(min(fits, key=lambda c: (abs(c - share), c)))
    return [*cuts[1:], total]


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: doc_id, size (UTF-8 bytes of the text + 1), text_crc32, shard (from 0), slot (from 0 in its shard, without gaps).

    Null and empty texts have size 1 and the checksum 0, and are a group each. Repeated rows stay rows, in the same shard.
    With fewer groups than shards some shards are empty. No rows give no rows. Other columns are ignored.
    """
    text = F.col(text_col).cast("string")
    rows = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(F.sha2(text, 256), F.lit("0" * 64)).alias("key"),
        ),
        "rows",
    )
    groups = materialize(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "groups")
    n, total, all_rows = groups.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    top = groups.orderBy(F.desc("bytes"), "key").limit(shards).collect()
    own, left = [], total
    while len(own) < min(len(top), shards - 1) and top[len(own)]["bytes"] * (shards - len(own)) > left:
        left -= top[len(own)]["bytes"]
        own.append(top[len(own)]["key"])
    cuts = []
    if left:
        sums = materialize(_running(groups.filter(~F.col("key").isin(own)) if own else groups, n), "sums")
        ends = sorted(set(cuts_of(Ends(sums, left), shards - len(own), top[len(own)]["bytes"])) - {0, left})
        cuts = [r["key"] for r in sums.filter(F.col("upto").isin(ends)).select("key").collect()] if ends else []
    past = sum((F.when(F.col("key") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    where = past + len(own)
    for k, key in enumerate(own):
        where = F.when(F.col("key") == key, k).otherwise(where)
    return _slots(rows.withColumn("shard", where.cast("int")), all_rows)


def _slots(placed: DataFrame, rows: int) -> DataFrame:
    """placed with slot. Rows are numbered in cells of their shard, dealt by hash, and cells are counted apart, so
    neither a shard nor a group of equal texts stands in one task."""
    cells = max(1, rows // CELL_ROWS)
    spot = F.conv(F.substring(F.md5(F.concat_ws("#", F.col("doc_id").cast("string"), "key")), 1, 8), 16, 10).cast("long")
    placed = placed.withColumn("cell", spot % cells)
    counts = placed.groupBy("shard", "cell").count()
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    order = Window.partitionBy("shard", "cell").orderBy("doc_id", "key")
    return (
        placed.withColumn("nth", F.row_number().over(order))
        .join(counts, ["shard", "cell"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("nth") - 1).cast("long").alias("slot"))
    )

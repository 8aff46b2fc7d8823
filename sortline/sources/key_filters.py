"""Filters of keys: which months may hold a key, told without reading their rows, and which rows may have a key of a batch, told before they are moved.

A month has a Bloom filter of the texts in a column, in blocks of 32,768 bits. A key has one block and a few bits in it, so looking it up in a month reads one block. Blocks are made by
aggregates of words and looked into by column functions; nothing leaves Spark but the months that are hit.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a block, and of the words that it is kept as.
BLOCK_BITS, WORD_BITS = 32_768, 64
WORDS = BLOCK_BITS // WORD_BITS
#: Bits for each key, and how many of them it sets: about one in 10,000 keys that a month lacks is found in it.
KEY_BITS, HASHES = 24, 12
#: Bits of a place in a block, and how many places one hash gives.
PLACE_BITS, PLACES = 15, 4
#: A hash share of one in so many keys is looked up in all months, the others only in those that it doesn't hit.
SHARES = 256
#: A batch's own filter: words of a chunk, how many chunks at most (16 MiB), for how many keys there is a word, and how many of its bits a key sets. Few other rows are taken for one of the
#: batch, and more than few only if it has more than four million keys.
CHUNK, MOST_CHUNKS, KEYS_OF_WORD, SET_BITS = 1024, 2048, 2, 5


def _hash(key: Column) -> Column:
    return F.xxhash64(key)


def _block(hashed: Column, blocks: Column) -> Column:
    return F.pmod(hashed, blocks)


def _bits(hashed: Column) -> list[Column]:
    """Places of a key's bits in its block."""
    return [F.shiftrightunsigned(F.xxhash64(hashed, F.lit(k // PLACES)), k % PLACES * PLACE_BITS).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int") for k in range(HASHES)]


def build(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Blocks of the filters of each month and column: shard_month, of_column, blocks (how many there are), block, bits (its words). Null keys aren't held. rows has shard_month.

    Hashes of keys are dealt by block, some 1,300 in each, before they become bits, so no bits are moved or sorted."""
    out = None
    for name, key in columns.items():
        keyed = rows.select(F.coalesce("shard_month", F.lit("")).alias("shard_month"), key.cast("string").alias("key"))
        sizes = keyed.groupBy("shard_month").agg(F.ceil(F.count("key") * KEY_BITS / BLOCK_BITS).alias("wanted"))  # one row for each month
        sized = keyed.filter("key IS NOT NULL").join(F.broadcast(sizes.withColumn("blocks", F.greatest("wanted", F.lit(1))).drop("wanted")), "shard_month")
        hashed = sized.select("shard_month", "blocks", _hash(F.col("key")).alias("hash")).withColumn("block", _block(F.col("hash"), F.col("blocks")))
        dealt = hashed.repartition("shard_month", "blocks", "block")
        placed = dealt.select("shard_month", "blocks", "block", F.explode(F.array(*_bits(F.col("hash")))).alias("bit"))
        of_word = placed.groupBy("shard_month", "blocks", "block", F.floor(F.col("bit") / WORD_BITS).cast("int").alias("word"))
        words = of_word.agg(F.bit_or(F.expr(f"shiftleft(1L, bit % {WORD_BITS})")).alias("bits"))
        part = words.groupBy("shard_month", "blocks", "block").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("set"))
        filled = F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda w: F.coalesce(F.try_element_at(F.map_from_entries("set"), w), F.lit(0).cast("long")))
        bits = F.when(F.size("set") == WORDS, F.col("set.bits")).otherwise(filled)  # full but in small months
        part = part.select("shard_month", "blocks", "block", bits.alias("bits"), F.lit(name).alias("of_column"))
        out = part if out is None else out.unionByName(part)
    return out


def _is_set(bits: Column, bit: Column) -> Column:
    return F.getbit(F.get(bits, F.floor(bit / WORD_BITS).cast("int")), bit % WORD_BITS) == 1


def hits(filters: DataFrame, keys: DataFrame) -> DataFrame:
    """shard_month and key of the keys (one column) that a month's filter holds."""
    sizes = filters.select("shard_month", "blocks").distinct()  # one row for each month
    asked = keys.select(F.col(keys.columns[0]).cast("string").alias("key")).filter("key IS NOT NULL").distinct().withColumn("hash", _hash(F.col("key")))
    placed = asked.join(F.broadcast(sizes)).withColumn("block", _block(F.col("hash"), F.col("blocks")))
    found = placed.join(filters.select("shard_month", "block", "bits"), ["shard_month", "block"])
    return found.filter(reduce(and_, (_is_set(F.col("bits"), bit) for bit in _bits(F.col("hash"))))).select("shard_month", "key")


def months_hit(filters: DataFrame, keys: DataFrame) -> list[str]:
    """Months whose filter holds one of the keys. A month that a share of the keys hits is told by these, so that keys of a large batch aren't looked up in every month; in the months that it
    doesn't hit all others are."""
    first = F.pmod(F.xxhash64(F.col(keys.columns[0]).cast("string"), F.lit("share")), F.lit(SHARES)) == 0
    found = lambda rows, some: [r[0] for r in hits(rows, some).select("shard_month").distinct().collect()]  # noqa: E731  a table has few months
    told = found(filters, keys.filter(first))
    left = filters.filter(~F.col("shard_month").isin(told)) if told else filters
    return told if left.isEmpty() else told + found(left, keys.filter(~first))


def _nth(hashed: Column, words: Column) -> Column:
    """The word of a key in the filter of a batch. Their number is a power of two, and the hash's last bits tell."""
    return F.pmod(hashed, words)


def _mask(hashed: Column) -> Column:
    """The bits that a key sets in its word, told by the hash's first bits."""
    place = lambda k: F.shiftrightunsigned(hashed, 34 + 6 * k).bitwiseAND(F.lit(WORD_BITS - 1)).cast("int")
    return reduce(Column.bitwiseOR, (F.call_function("shiftleft", F.lit(1).cast("long"), place(k)) for k in range(SET_BITS)))


def of_batch(keys: DataFrame) -> DataFrame:
    """One row, the filter of all keys of a batch (one column of texts): bits (words). It is of bounded size, however many the keys. Nulls aren't held."""
    asked = keys.select(F.col(keys.columns[0]).cast("string").alias("key")).filter("key IS NOT NULL")
    wanted = asked.agg(F.approx_count_distinct("key")).first()[0]
    chunks = 1
    while chunks < MOST_CHUNKS and chunks * CHUNK * KEYS_OF_WORD < wanted:
        chunks *= 2
    words = F.lit(chunks * CHUNK)
    hashed = asked.select(_hash(F.col("key")).alias("hash"))
    blank = keys.sparkSession.range(chunks * CHUNK).select(F.col("id").alias("nth"), F.lit(0).cast("long").alias("mask"))
    masks = hashed.select(_nth(F.col("hash"), words).alias("nth"), _mask(F.col("hash")).alias("mask")).unionByName(blank).groupBy("nth").agg(F.bit_or("mask").alias("mask"))
    ordered = lambda *of: F.array_sort(F.collect_list(F.struct(*of)))[of[-1]]
    dealt = masks.groupBy(F.floor(F.col("nth") / CHUNK).alias("chunk")).agg(ordered("nth", "mask").alias("masks"))
    return dealt.agg(F.flatten(ordered("chunk", "masks")).alias("bits"))


def split(rows: DataFrame, key: Column, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be of the batch, the others), told where they lie. All that are of the batch are among the first, and few others."""
    # a function of one element, so that a key is made in one place
    held = F.array(F.struct(key.cast("string").alias("key"), F.col("bits").alias("bits")))
    is_set = lambda hashed, bits: F.get(bits, _nth(hashed, F.size(bits)).cast("int")).bitwiseAND(_mask(hashed)) == _mask(hashed)
    of_it = F.exists(held, lambda x: x["key"].isNotNull() & is_set(_hash(x["key"]), x["bits"]))
    one = F.broadcast(batch)  # of bounded size
    return rows.join(one, of_it, "left_semi"), rows.join(one, of_it, "left_anti")

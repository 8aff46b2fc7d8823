"""WARC records and the Merkle fixity audit of two replicas.

A leaf of the tree is an ordered range of archive offsets: the hash of the hashes of the records that start in it, with their offsets.
Every higher node hashes the nodes of `fanout` ranges below it. The audit compares the roots and then descends: at each
level it reads only the children of nodes that differ, and at the end only the records of the ranges that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Bytes of offsets in a leaf, nodes below a node, and offsets that one archive holds.
RANGE = 1 << 14
FANOUT = 16
ARCHIVES = 64
NO_DATE = "1970-01-01T00:00:00Z"


def record(url: Column, body: Column, name: Column, date: str = NO_DATE) -> Column:
    """A WARC/1.1 resource record as bytes. Line ends in the url are percent-encoded, as they would end its header."""
    body = F.encode(F.coalesce(body, F.lit("")), "UTF-8")
    line = lambda c: F.replace(F.replace(c, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        line(name),
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        line(F.coalesce(url, F.lit(""))),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def to_records(pages: DataFrame, archives: int = ARCHIVES, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", date: str = NO_DATE) -> DataFrame:
    """Pages as WARC records: archive, offset, length, page_id, record. Archives are dealt by hash, so no host or other hot key fills one;
    `archives` should grow with the pages. Records stand in the order of page_id (then of their hash) without gaps. Records are named by page_id and a number that tells
    repeated rows apart. Pages without a time of their own get `date`.

    Null urls and bodies are empty fields; a null id is written as "null". Repeated rows are separate records.
    """
    read = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(body_col).cast("string").alias("body"))
    read = read.withColumn("key", F.sha2(F.to_json(F.struct("url", "body")), 256)).withColumn("archive", F.pmod(F.xxhash64("page_id", "key"), F.lit(archives)).cast("int"))
    order = Window.partitionBy("archive").orderBy("page_id", "key")  # one order for both steps, so that pages are dealt and sorted once
    name = F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), "copy")
    made = read.withColumn("copy", F.row_number().over(order) - F.rank().over(order)).withColumn("record", record(F.col("url"), F.col("body"), name, date))
    made = made.withColumn("length", F.octet_length("record").cast("long")).select("archive", "length", "page_id", "key", "record")
    upto = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return made.withColumn("offset", upto).select("archive", "offset", "length", "page_id", "record")


def read_records(records: DataFrame) -> DataFrame:
    """What the bytes of records say: archive, offset, record_id, date, url, body (bytes), and is_whole: the version line is there, and the stated length of the body is
    that of the bytes between header and end. Other columns are ignored; a null record isn't whole."""
    text = F.decode("record", "UTF-8")
    head = F.substring_index(text, "\r\n\r\n", 1)
    value = lambda name: F.regexp_extract(head, rf"\r\n{name}: ([^\r\n]*)", 1)
    stated = F.coalesce(F.nullif(F.regexp_extract(head, r"\r\nContent-Length: (\d{1,18})", 1), F.lit("")).cast("long"), F.lit(-1))
    begin = F.octet_length(F.encode(head, "UTF-8")) + 4
    whole = head.startswith("WARC/1.1\r\n") & (stated >= 0) & (begin + stated + 4 == F.octet_length("record"))
    return records.select(
        "archive",
        "offset",
        F.regexp_extract(value("WARC-Record-ID"), "^<(.*)>$", 1).alias("record_id"),
        value("WARC-Date").alias("date"),
        value("WARC-Target-URI").alias("url"),
        F.when(whole, F.substr("record", (begin + 1).cast("int"), stated.cast("int"))).alias("body"),
        F.coalesce(whole, F.lit(False)).alias("is_whole"),
    )


def record_hashes(records: DataFrame) -> DataFrame:
    """archive, offset, length, digest (SHA-256) of each record: all that the tree needs."""
    return records.select("archive", "offset", "length", F.sha2("record", 256).alias("digest"))


def merkle_levels(hashes: DataFrame, span: int = RANGE, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels of the trees of all archives, leaves first: archive, node, hash. The last level has the roots alone."""
    entry = F.struct("offset", "length", "digest")
    leaves = (
        hashes.groupBy("archive", F.floor(F.col("offset") / span).alias("node"))
        .agg(F.array_sort(F.collect_list(entry)).alias("all"))
        .select("archive", "node", F.sha2(F.array_join(F.transform("all", lambda x: F.concat_ws(":", x.offset, x.length, x.digest)), ","), 256).alias("hash"))
    )
    levels = [materialize(leaves, "level")]
    top = levels[0].agg(F.coalesce(F.max("node"), F.lit(0))).first()[0]
    while top:
        below = levels[-1].groupBy("archive", F.floor(F.col("node") / fanout).alias("up")).agg(F.array_sort(F.collect_list(F.struct("node", "hash"))).alias("all"))
        text = F.array_join(F.transform("all", lambda x: F.concat_ws(":", x.node, x.hash)), ",")
        levels.append(materialize(below.select("archive", F.col("up").alias("node"), F.sha2(text, 256).alias("hash")), "level"))
        top //= fanout
    return levels


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes whose hashes differ, or that one tree lacks."""
    both = a.join(b.withColumnRenamed("hash", "other"), ["archive", "node"], "full")
    return both.filter(~F.col("hash").eqNullSafe(F.col("other"))).select("archive", "node")


def audit(first: DataFrame, second: DataFrame, span: int = RANGE, fanout: int = FANOUT) -> DataFrame:
    """Records (archive, offset, length, digest, as record_hashes() gives them) that two replicas don't share.

    archive, offset, length and digest in the first replica, other_length and other_digest in the second, fault: changed (both have a record
    at that offset), missing or added (the second has none, or one more). Equal replicas give no rows, empty ones too. Repeated
    records at one offset are compared as a list. Rows whose archive or offset is null aren't records; audit ignores them.
    """
    keep = lambda df: materialize(df.filter(F.col("archive").isNotNull() & F.col("offset").isNotNull()), "hashes")
    first, second = keep(first), keep(second)
    trees = [merkle_levels(x, span, fanout) for x in (first, second)]
    while len(trees[0]) != len(trees[1]):  # the shorter tree gets roots above its own
        low = min(trees, key=len)
        up = low[-1].select("archive", F.floor(F.col("node") / fanout).alias("node"), F.sha2(F.concat_ws(":", "node", "hash"), 256).alias("hash"))
        low.append(materialize(up, "level"))
    bad = materialize(_differing(trees[0][-1], trees[1][-1]), "differing")
    for level in range(len(trees[0]) - 2, -1, -1):
        up = bad.select("archive", F.col("node").alias("up"))
        a, b = (t[level].join(up, (t[level]["archive"] == up["archive"]) & (F.floor(t[level]["node"] / fanout) == up["up"]), "left_semi") for t in trees)
        bad = materialize(_differing(a, b), "differing")
    own = [x.withColumn("node", F.floor(F.col("offset") / span)).join(bad, ["archive", "node"], "left_semi") for x in (first, second)]
    at = lambda df, n, d: df.groupBy("archive", "offset").agg(
        F.sum("length").alias(n), F.array_join(F.sort_array(F.collect_list("digest")), ",").alias(d)
    )
    both = at(own[0], "length", "digest").join(at(own[1], "other_length", "other_digest"), ["archive", "offset"], "full")
    fault = F.when(F.col("other_digest").isNull(), "missing").when(F.col("digest").isNull(), "added").otherwise("changed")
    return both.filter(~F.col("digest").eqNullSafe(F.col("other_digest"))).withColumn("fault", fault)


def damage(records: DataFrame, every: int = 50) -> DataFrame:
    """A replica with known faults: a byte is overwritten in records whose id is divisible by `every`; where the id is divisible by
    4 * every, the record is lost."""
    hit = F.col("page_id") % every == 0
    spoilt = F.concat(F.substring("record", 1, 40), F.encode(F.lit("#"), "UTF-8"), F.expr("substring(record, 42)"))
    kept = records.filter(~F.coalesce(F.col("page_id") % (4 * every) == 0, F.lit(False)))
    return kept.withColumn("record", F.when(hit, spoilt).otherwise(F.col("record")))

"""Benchmark decontamination by a prefix-filtered containment join.

Containment asks that a document hold all tokens of a window in a row. So the prefix that a
window must share with a document is one token; the rarest token (by its count over all documents) makes
the fewest candidates. Candidates pass length and positional bounds, then an exact comparison of
the window's words with the document's words at that place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialize

#: What parts words; a word is any run of other characters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows of this many bytes in all (words, item ids and what rows take) are broadcast; more are joined by shuffle.
BROADCAST_BYTES = 64 << 20
#: Slices that the places of a word are dealt into there, so that a frequent one's are in no task alone.
SLICES = 16


def words_of(c):
    return F.array_remove(F.split(lower_ascii(c), BETWEEN), "")


def item_windows(items: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows: w_id, w_words, w_len, w_items (ids of the items that hold it, as strings; a null id is "")."""
    n = F.size("ws")
    spread = (
        items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words_of(F.col(text_col)).alias("ws"))
        .filter(n > 0)
        .select("item", "ws", F.explode(F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1)))).alias("at"))
        .select("item", F.slice("ws", F.col("at"), F.lit(window)).alias("w_words"))
    )
    return (
        spread.groupBy("w_words")
        .agg(F.collect_set("item").alias("w_items"))
        .select(F.md5(F.array_join("w_words", " ")).alias("w_id"), "w_words", F.size("w_words").alias("w_len"), "w_items")
    )


def rarest_token(docs: DataFrame, windows: DataFrame, small: bool) -> DataFrame:
    """windows with w_token and w_at: the token of each that is rarest in the documents, and its first place."""
    tokens = windows.select("w_id", F.posexplode("w_words").alias("w_at", "w_token"))
    vocab = tokens.select("w_token").distinct()
    said = docs.select(F.explode_outer("words").alias("w_token"))  # explode() would split each text three times, for its null and size filters
    code = F.xxhash64("w_token").alias("code")  # a long is much cheaper to count by, and any order of tokens gives right results
    if small:
        freq = said.join(F.broadcast(vocab), "w_token", "left_semi").groupBy(code).count()
    else:
        freq = said.groupBy(code).count().join(vocab.select(code).distinct(), "code", "left_semi")
    first = (
        tokens.withColumn("code", code)
        .join(freq, "code", "left")
        .groupBy("w_id")
        .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "w_token", "w_at")).alias("p"))
    )
    return windows.join(first, "w_id").select("w_id", "w_words", "w_len", "w_items", "p.w_token", "p.w_at")


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    window: int = 13,
    least_share: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """For every row: doc_id, n_words, n_hit, items (ids sorted as strings), spans (word ranges, end
    exclusive), contaminated (n_hit > 0 and least_share * n_hit >= n_words), text_key (xxhash64 of the text).

    Null and wordless texts have no words and no hits; null or wordless items have no windows. Items without an id count as one with the id "". Repeated rows give
    a row each. Other columns of either table are ignored, whatever their names.
    """
    docs = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.coalesce(words_of(F.col(text_col)), F.array().cast("array<string>")).alias("words")
    )
    windows = materialize(item_windows(items, window, item_id_col, item_text_col), "windows")
    entry = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x) + 16)
    small = windows.agg(F.coalesce(F.sum(entry(F.col("w_words")) + entry(F.col("w_items")) + 128), F.lit(0))).first()[0] <= broadcast_bytes
    prefix = materialize(rarest_token(docs, windows, small), "prefix")
    join = _broadcast_hits if small else _shuffled_hits
    start = F.col("start")
    spans = F.array_sort(F.collect_set(F.when(start.isNotNull(), F.struct("start", "end"))))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, s: F.struct(
            (a.n + F.greatest(F.lit(0), s.end - F.greatest(s.start, a.to))).alias("n"), F.greatest(a.to, s.end).alias("to")
        ),
        lambda a: a.n,
    ).cast("long")
    items_of = F.array_sort(F.array_distinct(F.flatten(F.collect_set("w_items"))))
    return (
        join(docs, prefix)
        .groupBy("doc_id", "text_key")
        .agg(F.max("n_words").cast("long").alias("n_words"), spans.alias("spans"), items_of.alias("items"), F.count_if("is_row").cast("int").alias("rows"))
        .withColumn("row", F.explode(F.array_repeat(F.lit(0), F.col("rows"))))
        .drop("rows", "row")
        .withColumn("n_hit", covered)
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * least_share >= F.col("n_words")))
    )


def _broadcast_hits(docs: DataFrame, prefix: DataFrame) -> DataFrame:
    """A row for each verified window of a document, and one, with is_row, for each row of docs.

    One pass over the texts; words stay in their row, and the join makes rows only where a window is verified. The first of the places that are
    spread is that of no word, which no window has.
    """
    places = F.posexplode_outer(F.concat(F.array(F.lit("")), F.col("words"))).alias("pos", "word")  # posexplode() would split each text anew for its filters
    spread = docs.select("doc_id", "text_key", "words", places)
    start = F.col("pos") - 1 - F.col("w_at")
    held = (
        (F.col("word") == F.col("w_token"))
        & (start >= 0)
        & (start + F.col("w_len") <= F.size("words"))
        & (F.slice("words", F.greatest(start + 1, F.lit(1)), F.col("w_len")) == F.col("w_words"))
    )
    hit = F.col("w_id").isNotNull()
    return (
        spread.join(F.broadcast(prefix), held, "left")
        .filter(hit | (F.col("pos") == 0))
        .select(
            "doc_id",
            "text_key",
            F.size("words").alias("n_words"),
            F.when(hit, start).alias("start"),
            F.when(hit, start + F.col("w_len")).alias("end"),
            "w_items",
            (F.col("pos") == 0).alias("is_row"),
        )
    )


def _shuffled_hits(docs: DataFrame, prefix: DataFrame) -> DataFrame:
    """The same rows for windows too many to broadcast: tokens are joined without the words, which are read again to verify. Places are dealt into slices, each with all windows."""
    start = F.col("pos") - F.col("w_at")
    spread = docs.select("doc_id", "text_key", F.size("words").alias("n"), F.posexplode("words").alias("pos", "word"))
    dealt = prefix.select("w_token", "w_at", "w_len", "w_id", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice"))
    candidates = (
        spread.join(dealt, (F.col("word") == F.col("w_token")) & (F.pmod(F.xxhash64("text_key", "pos"), F.lit(SLICES)) == F.col("slice")))
        .filter((start >= 0) & (start + F.col("w_len") <= F.col("n")))
        .select(F.col("doc_id").alias("c_id"), F.col("text_key").alias("c_key"), start.alias("start"), "w_id")
        .distinct()
    )
    hits = (
        candidates.join(prefix.select("w_id", "w_words", "w_len", "w_items"), "w_id")
        .join(docs.dropDuplicates(["doc_id", "text_key"]), F.col("c_id").eqNullSafe(F.col("doc_id")) & (F.col("c_key") == F.col("text_key")))
        .filter(F.slice("words", F.col("start") + 1, F.col("w_len")) == F.col("w_words"))
        .select("doc_id", "text_key", F.size("words").alias("n_words"), "start", (F.col("start") + F.col("w_len")).alias("end"), "w_items", F.lit(False).alias("is_row"))
    )
    kinds = {f.name: f.dataType for f in hits.schema}
    rest = docs.select(
        "doc_id", "text_key", F.size("words").alias("n_words"), *(F.lit(None).cast(kinds[c]).alias(c) for c in ("start", "end", "w_items")), F.lit(True).alias("is_row")
    )
    return hits.unionByName(rest)

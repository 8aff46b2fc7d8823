"""Secret scan with corpus-wide ownership frequency.

Candidate values are counted over the whole corpus by distinct repositories (texts, so that copies of a document are one) and owners (sources; a text that several have
is that of the first of them). A value of many owners is a widely copied example, and so is one that an owner has in a notable share of its own repositories, as a template
has; one in few of them, of a single owner, that looks random is a live-looking credential of that owner, however many texts a large owner leaks it in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Fixed values of the scan: kind, pattern, group that holds the value, least length of that group.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"(AKIA[A-Z0-9]{16,})", 0, 20),
    ("hex", r"([0-9a-f]{24,})", 0, 24),
)
#: Kind of the spans that this method adds: values judged live-looking.
LIVE = "live"
#: Owners from which on a value is an example; and of a single owner, repositories, if they are one in so many of the owner's at least.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES, EXAMPLE_PART = 2, 10, 100
#: A value is joined apart from the rest if this many repositories have it, and all such together are so few that they can be broadcast.
HOT_REPOSITORIES, MOST_HOT = 2_000, 100_000


def _found(text: Column, pattern: str) -> Column:
    """Gaps and matches of a pattern, in order: the gap before each match and the match. No match: an empty list."""
    p = F.lit(pattern)
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("hit"))
    return F.when(text.rlike(pattern), F.slice(zipped, 1, F.size(zipped) - 1))


def looks_random(value: Column) -> Column:
    """Whether a value looks drawn at random, by its make alone: twelve characters or more, of at least three bits of collision entropy (two characters picked at random are the same one
    time in eight at most); letters and digits in four runs or more, where words and numbers put together have few; and less than half of its characters next in
    the alphabet, or equal, to the one before, as in 123456 and abcdef."""
    chars = F.split(value, "")
    times = lambda c: F.size(F.filter(chars, lambda x: x == c)).cast("long")
    same = F.aggregate(F.array_distinct(chars), F.lit(0).cast("long"), lambda n, c: n + times(c) * times(c))
    n = F.length(value).cast("long")
    runs = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[^0-9A-Za-z]", ""), "[0-9]+", "0"), "[A-Za-z]+", "a")
    next_to = F.size(F.filter(F.arrays_zip(F.slice(chars, 2, F.size(chars)).alias("b"), chars.alias("a")), lambda x: F.abs(F.ascii(x.b) - F.ascii(x.a)) <= 1)).cast("long")
    return (n >= 12) & (same * 8 <= n * n) & (F.length(runs) >= 4) & (next_to * 2 < n)


def scan_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """A row for each base span: doc_id, text_key, owner, kind, rank (of the kind), start, end (code points, end exclusive), value_start, value_key.
    Documents without a span keep one row whose kind is null. Equal (id, text, owner) rows come once, with their number as copies."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lists = [F.transform(F.coalesce(_found(F.col("text"), p), F.array()), lambda x, k=k: F.struct(F.lit(k).alias("rank"), x.gap.alias("gap"), x.hit.alias("hit"))) for k, (_, p, _, _) in enumerate(KINDS)]
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(owner_col).cast("string").alias("owner"), text.alias("text"))
    by_kind = base.select("doc_id", "text_key", "owner", F.explode_outer(F.array(*(F.struct(F.lit(k).alias("rank"), x.alias("found")) for k, x in enumerate(lists)))).alias("k"))
    hits = by_kind.select("doc_id", "text_key", "owner", "k.rank", F.posexplode_outer("k.found").alias("nth", "m"))
    value = F.coalesce(*(F.when(F.col("rank") == k, F.regexp_extract("m.hit", p, g)) for k, (_, p, g, _) in enumerate(KINDS)))
    hits = (
        hits.filter(F.col("nth").isNotNull() | (F.col("rank") == 0))
        .select("doc_id", "text_key", "owner", "rank", "nth", F.length("m.gap").alias("gap"), F.length("m.hit").alias("len"), value.alias("value"))
        .select("doc_id", "text_key", "owner", "rank", "nth", "gap", "len", F.length("value").alias("value_len"), F.sha2("value", 256).alias("value_key"), looks_random(F.col("value")).alias("random"))
    )
    hits = hits.groupBy(*hits.columns).agg(F.count("*").alias("copies"))
    upto = Window.partitionBy("doc_id", "text_key", "owner", "rank").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("len")).over(upto)
    least = F.element_at(F.array(*(F.lit(n) for *_, n in KINDS)), F.col("rank") + 1)
    kind = F.element_at(F.array(*(F.lit(k) for k, *_ in KINDS)), F.col("rank") + 1)
    good = F.col("nth").isNotNull() & (F.col("value_len") >= least)
    return (
        hits.withColumn("end", end)
        .withColumn("good", good)
        .filter(F.col("good") | F.col("nth").isNull() | (F.col("nth") == 0))
        .select(
            "doc_id",
            "text_key",
            "owner",
            "copies",
            *(F.when(F.col("good"), c).alias(a) for a, c in (("kind", kind), ("rank", F.col("rank")), ("start", F.col("end") - F.col("len")), ("end", F.col("end")), ("value_start", F.col("end") - F.col("value_len")), ("value_key", F.col("value_key")), ("random", F.col("random")))),
        )
        .withColumns({c: F.col(c).cast("long") for c in ("start", "end", "value_start")})
    )


def ownership(spans: DataFrame) -> DataFrame:
    """value_key with owners and repositories that hold it, and all repositories that its only owner has (null of several). A null owner is an owner of its own.

    Counted in steps that each combine before the shuffle, so a value copied everywhere stands in no task alone.
    """
    owner = F.coalesce(F.concat(F.lit("="), "owner"), F.lit(""))
    texts = spans.filter(F.col("kind").isNotNull()).groupBy("value_key", "text_key").agg(F.min(owner).alias("owner"))
    by_owner = texts.groupBy("value_key", "owner").agg(F.count("*").alias("repositories"))
    found = by_owner.groupBy("value_key").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.min("owner").alias("only"))
    every = spans.groupBy("text_key").agg(F.min(owner).alias("only")).groupBy("only").agg(F.count("*").alias("of_owner"))
    return found.join(every, "only").select("value_key", "owners", "repositories", F.when(F.col("owners") == 1, F.col("of_owner")).alias("of_owner"))


def _with_counts(spans: DataFrame, counts: DataFrame) -> DataFrame:
    """spans with the counts of their values. Values that very many texts have are few, and are broadcast if they are: the spans of one stay where they are."""
    hot = counts.filter(F.col("repositories") >= HOT_REPOSITORIES)
    if not 0 < hot.count() <= MOST_HOT:
        return spans.join(counts, "value_key")
    marked = spans.join(F.broadcast(hot), "value_key", "left")
    rest = marked.filter(F.col("owners").isNull()).select(*spans.columns).join(counts, "value_key")
    return marked.filter(F.col("owners").isNotNull()).select(*rest.columns).unionByName(rest)


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    example_owners: int = EXAMPLE_OWNERS,
    example_repositories: int = EXAMPLE_REPOSITORIES,
    example_part: int = EXAMPLE_PART,
) -> DataFrame:
    """For each row: doc_id, text_key, owner and secrets, a list of (start, rank, end, kind, value_key, owners, repositories, verdict) in order of start. verdict: example
    (`example_owners` owners or more hold the value, or one holds it in `example_repositories` repositories or more that are one in `example_part` of its own at least), live (else, if it
    looks random) or weak. Live values get a further entry of kind live, which spans the value alone.

    Null texts count as empty and have no secrets. Null ids and owners are values like others. Repeated rows give a row each, and count as one repository.
    """
    spans = materialize(scan_spans(docs, id_col, text_col, owner_col), "spans")
    counts = materialize(ownership(spans), "owners")
    some = _with_counts(spans.filter(F.col("kind").isNotNull()), counts)
    template = (F.col("repositories") >= example_repositories) & (F.col("repositories") * example_part >= F.col("of_owner"))
    verdict = F.when((F.col("owners") >= example_owners) | F.coalesce(template, F.lit(False)), "example").when(F.col("random"), LIVE).otherwise("weak")
    entry = lambda start, rank, kind: F.struct(start.alias("start"), rank.alias("rank"), F.col("end"), kind.alias("kind"), "value_key", "owners", "repositories", F.col("verdict"))
    base = entry(F.col("start"), F.col("rank"), F.col("kind"))
    added = F.when(F.col("verdict") == LIVE, F.array(base, entry(F.col("value_start"), F.lit(len(KINDS)), F.lit(LIVE)))).otherwise(F.array(base))
    key = ["doc_id", "text_key", "owner", "copies"]
    listed = some.withColumn("verdict", verdict).select(*key, added.alias("entries"))
    none = spans.filter(F.col("kind").isNull()).select(*key).distinct().withColumn("entries", F.array().cast(listed.schema["entries"].dataType))
    out = listed.unionByName(none).groupBy(*key).agg(F.array_sort(F.flatten(F.collect_list("entries"))).alias("secrets"))
    return out.select("doc_id", "text_key", "owner", "secrets", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy")

"""The corpus pipeline: documents that pass the quality classifier, without near copies and benchmark passages, mixed to target weights and dealt into shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sortline.llm.common import BLANK, materialize, table
from sortline.llm.decontaminate import decontaminate
from sortline.llm.mix import mix
from sortline.llm.quality import fit, score
from sortline.llm.shards import shard
from sortline.llm.simhash import near_duplicates

#: Words of the columns that the stages add for themselves; no column of documents may have them.
OWN = "__pipeline_"


def _same(docs: DataFrame, rows: DataFrame) -> Column:
    """Row of docs is meant by a row of `rows`, by id (null equals null) and text."""
    return docs["doc_id"].eqNullSafe(rows[OWN + "id"]) & (F.xxhash64(docs["text"]) == rows[OWN + "key"])


def _rows(df: DataFrame, *more) -> DataFrame:
    """df (doc_id, text_key, ...) as a table that docs can be joined with."""
    return materialize(df.select(F.col("doc_id").alias(OWN + "id"), F.col("text_key").alias(OWN + "key"), *more), "decided")


def _joined(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs with the columns of `rows`, which has a row for each distinct (id, text) and its count in docs; of repeated rows one is taken."""
    both = docs.join(rows, _same(docs, rows))
    count = F.col(OWN + "n")
    if rows.filter(count > 1).isEmpty():
        return both
    return both.filter(count == 1).unionByName(both.filter(count > 1).dropDuplicates([OWN + "id", OWN + "key"]))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts. Every row is judged; null and empty texts are judged as empty, and repeated rows alike."""
    mark = OWN + "score"
    return score(docs, fit(docs, table(spark, sf_dir, "labels")), mark).filter(F.col(mark)["accepted"]).select(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: the one with the least id (null ids last), of repeated rows any one. Blank texts are one component."""
    found = materialize(near_duplicates(docs), "components")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    kept = found.groupBy("doc_id", "text_key", "root").agg(F.count("*").alias("n")).groupBy("root").agg(F.min(F.struct(first.alias("first"), "n")).alias("k"))
    rows = _rows(kept.select("k.first.doc_id", "k.first.text_key", "k.n"), F.col("n").alias(OWN + "n"))
    return _joined(docs, rows).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark. Wordless and null texts stay."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("contaminated")
    rows = _rows(found)
    return docs.join(rows, _same(docs, rows), "left_anti").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every copy that the mix takes; the text of a copy that the mix cuts ends with its last word taken, and n_chars follows.
    Documents that the mix doesn't take go, those without words too."""
    mixed = mix(docs).groupBy("doc_id", "text_key", "size").agg(F.flatten(F.collect_list("parts")).alias("parts"), F.count("*").alias("n"))
    rows = _rows(mixed.filter(F.size("parts") > 0), F.col("n").alias(OWN + "n"), F.col("size").alias(OWN + "size"), F.col("parts").alias(OWN + "parts"))
    copies = _joined(docs, rows).withColumn(OWN + "part", F.explode(OWN + "parts"))
    words = F.col(OWN + "part")["words"]
    upto = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"[{BLANK}]*[^{BLANK}]+"), F.lit(0)), F.lit(1), words.cast("int")), "")
    cut = words < F.col(OWN + "size")
    kinds = dict(docs.dtypes)
    changed = {"text": F.when(cut, upto).otherwise(F.col("text")), "n_chars": F.when(cut, F.length(upto)).otherwise(F.col("n_chars")).cast(kinds["n_chars"])}
    return copies.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns))


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    return shard(docs)


STAGES = [
    ("quality", quality_stage),
    ("simhash_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: SQL can express neither the classifier nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

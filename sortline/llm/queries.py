"""The registered queries of this subpackage. Their SQL is in sql.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import rotate
from .collocations import collocations
from .common import materialize, table
from .decontaminate import decontaminate
from .maxent import score_texts
from .media import digests
from .mix import mix
from .quality import fit, score
from .repair import repair
from .secrets import KINDS, scan_secrets
from .shards import shard
from .simhash import near_duplicates
from .sql import SQL
from .warc import audit, damage, record_hashes, to_records
from .wrappers import extract_text


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of every document by 13-word windows of the benchmark."""
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 5, 2, 1 with at most three copies of each: words taken, where the first of them stands in the mix, and of how many copies they are."""
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.array_min("parts.at").alias("first_at"), F.size("parts").cast("long").alias("copies"))


def op3_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes, equal texts together."""
    placed = shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _listed(entries):
    return F.array_join(F.transform(entries, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; values of one owner that look live are added as spans of their own."""
    found = scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("secrets", lambda x: x["rank"] < len(KINDS))
    of = lambda kind: F.size(F.filter("secrets", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    judged = lambda verdict: F.size(F.filter(base, lambda x: x.verdict == verdict)).cast("long").alias(f"n_judged_{verdict}")
    return found.select(
        "doc_id",
        *(of(kind) for kind, *_ in KINDS),
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed("secrets").alias("spans"),
        *(judged(v) for v in ("example", "live", "weak")),
    )


def op6_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by the wrapper of its host."""
    return extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, by classifiers co-trained on the labels."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")), "q").select("doc_id", "q.p_text", "q.p_meta", "q.score", "q.accepted")


def op8_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an MPEG audio stream, read back."""
    return digests(table(spark, sf_dir, "documents"))


def op9_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation rendered for each of its participants."""
    return rotate(table(spark, sf_dir, "conversations"))


def op10_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages stored as WARC records, and the faults of a damaged replica found by its trees."""
    pages = table(spark, sf_dir, "pages")
    stored = materialize(to_records(pages, archives=pages.count() // 1000 + 1), "records")
    faults = audit(record_hashes(stored), record_hashes(damage(stored)))
    where = stored.select("archive", "offset", "page_id")
    return faults.join(where, ["archive", "offset"]).select("page_id", "fault", "length", "other_length")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language by the score of their worst cut."""
    return collocations(table(spark, sf_dir, "documents"))


def op12_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of all documents by counts, and by a hashed maximum-entropy model."""
    return score_texts(table(spark, sf_dir, "documents"))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of all conversations after damage, and their cheapest repair."""
    return repair(table(spark, sf_dir, "conversations"))


__all__ = ["QUERIES", "SQL"]

QUERIES = {f.__name__: f for f in (op1_decontamination, op2_mixing, op3_simhash_neardup, op4_sharding, op5_secret_scan, op6_html_wrappers, op7_quality, op8_mpeg_audio, op9_perspective_rotation, op10_warc_fixity, op11_collocations, op12_maxent, op13_structure_repair)}

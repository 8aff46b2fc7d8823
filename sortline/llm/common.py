"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: White space that parts words in the size and shingle rules.
BLANK = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, one of our own in local mode, as in tests; a cluster has to name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    kept = spark.sparkContext._jsc.sc().getCheckpointDir()
    if kept.isDefined():
        return str(kept.get()).rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    spark.sparkContext.setCheckpointDir(own)
    return shared_dir(spark)


def materialize(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write df as Parquet in the shared folder, in folders by the columns `by`, and read it again: lineage is cut, lost executors cost no recomputation. The files go when the
    application ends."""
    spark = df.sparkSession
    out_path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(out_path)
    path, fs = _file(spark, out_path)
    fs.deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(out_path)
    out._written_at = out_path
    return out


def _file(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    path, fs = _file(df.sparkSession, df._written_at)
    fs.delete(path, True)


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z, nothing else. lower() has a fast way for ASCII texts, where it does just that."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def count_words(c: Column) -> Column:
    """Runs of characters other than space and \\t to \\r; null has none."""
    return F.coalesce(F.regexp_count(c, F.lit(f"[^{BLANK}]+")), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""Folders for tables that live as long as the application."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share: spark.checkpoint.dir, or in local mode, where that is unset, one of our own. It goes when the application ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    kept = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not shared and kept.isDefined():
        shared = str(kept.get())
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(shared)
    out = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return out

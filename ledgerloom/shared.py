"""Folders that all executors share, and lineage cut off there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset: with a local master, as in tests, a temporary one; else a folder of the warehouse, which must not be a disk of this machine."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found and re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        found = tempfile.mkdtemp(prefix="ledgerloom-")
    if not found:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if warehouse.startswith("file:") or "://" not in warehouse:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"{warehouse.rstrip('/')}/_ledgerloom-{uuid.uuid4().hex}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def own_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the shared folder, so that a lost executor costs a read. Its files go once nothing refers to it any more."""
    spark = df.sparkSession
    shared_dir(spark)
    spark.sparkContext._jsc.sc().conf().setIfMissing("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return df.checkpoint()


def arrow_store(uri: str):
    """(file system, path) of a URI, or of a path without scheme, as Arrow knows them."""
    from pyarrow import fs

    if re.match(r"[a-z0-9]+://", uri):
        return fs.FileSystem.from_uri(uri)
    return fs.FileSystem.from_uri("file://" + uri.removeprefix("file:"))

"""Lineage cuts and shared files, in the folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.  Where none is set, a new one is set on a local master; a cluster has to name one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^-]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="shared-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder, so that a lost executor costs no recomputation upstream."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def publish(spark: SparkSession, content: bytes, suffix: str) -> str:
    """Write bytes to the shared folder and have Spark hand them to every executor; gives the name for ``SparkFiles.get``."""
    name = f"{uuid.uuid4().hex}{suffix}"
    target = f"{shared_dir(spark)}/{name}"
    if target.startswith(("file:", "/")):
        path = target.removeprefix("file:")
        path = "/" + path.lstrip("/")
        with open(path + ".part", "wb") as f:
            f.write(content)
        os.replace(path + ".part", path)
    else:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(target)
        out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
        for i in range(0, len(content), 1 << 20):
            out.write(bytearray(content[i : i + (1 << 20)]))
        out.close()
    spark.sparkContext.addFile(target)
    return name

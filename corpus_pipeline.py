"""A corpus in four stages: quality classifier, language identification, near duplicates, packing.

Each stage reads all that its predecessor wrote.  The first three give documents with their own columns; the last gives
windows.  The classifier's and the languages' models are trained here, so SQL cannot express the stages; the tests hold
each against a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quirefold.llm import gam, langid, nearjoin, packing
from quirefold.llm.store import remove, shared_dir

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", gam.stage),
    ("language identification", langid.stage),
    ("near duplicates", nearjoin.stage),
    ("packing", packing.stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of all stages in turn; what lies between is written as Parquet to the shared folder, and deleted once read."""
    import uuid

    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs

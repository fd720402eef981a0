"""Output by kind: a folder of text files a kind, one row a line, overwritten as a whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_kinds(path: str, **kinds: DataFrame) -> None:
    """Write tables (doc_id, one string) as Parquet partitioned by ``kind``; documents without output leave none."""
    parts = [df.select("doc_id", F.col(next(c for c in df.columns if c not in ("doc_id", "table_id"))).alias("value"), F.lit(k).alias("kind")).where("value IS NOT NULL AND value <> ''") for k, df in kinds.items()]
    reduce(DataFrame.unionByName, parts).write.mode("overwrite").partitionBy("kind").parquet(path)

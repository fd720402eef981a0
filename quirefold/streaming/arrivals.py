"""Layout of text files as they arrive: the batch operators on each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import lines
from ..sources import text_layout


def watch_texts(spark: SparkSession, path: str) -> DataFrame:
    """A stream (doc_id, source, text) of whole text files under a path."""
    files = spark.readStream.format("text").option("wholetext", "true").load(path)
    source = F.input_file_name()
    return files.select(F.xxhash64(source).alias("doc_id"), source.alias("source"), F.col("value").alias("text"))


def structure_stream(documents: DataFrame, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write each batch's page structure under ``target``; a batch that is run again overwrites its own folder."""

    def put(batch: DataFrame, number: int) -> None:
        lines.page_structure(text_layout.text_elements(batch)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = documents.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

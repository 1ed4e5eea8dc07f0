"""A folder of arriving documents as a stream of entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexmill.operators.mapping import Mapping
from lexmill.plans.dictionary import dictionary_to_tei
from lexmill.sources.store import stored
from lexmill.sources.xml import shred


def documents_stream(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, raw of each file that arrives."""
    files = spark.readStream.format("text").option("wholetext", True).load(path)
    return files.select(F.xxhash64(F.col("_metadata.file_path")).alias("doc_id"), F.col("value").alias("raw"))


def entries_stream(spark: SparkSession, path: str, mapping: Mapping, out: str, checkpoint: str, title: str = "dict") -> StreamingQuery:
    """Appends each batch's entries to a Parquet table, a folder for each batch: one that is run again replaces its own. Headwords are numbered within a batch."""

    def write(batch: DataFrame, number: int) -> None:
        dictionary_to_tei(stored(shred(batch)), mapping, title).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return documents_stream(spark, path).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

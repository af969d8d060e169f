"""Incremental indexing: each micro-batch appends a segment of postings; a reader adds segments up.

Frequencies and lengths add up over segments; idf and average length depend on the whole corpus and
are worked out when segments are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.analysis import Analyzer, analyze
from ..operators.index import document_frequencies, document_lengths, positional_postings


def append_segments(docs: DataFrame, path: str, checkpoint: str, analyzer: Analyzer = Analyzer(), **trigger):
    """Start a stream from (doc_id, text) to segments under `path`. A batch that is run again replaces its own segment."""

    def write(batch: DataFrame, number: int) -> None:
        tokens = analyze(batch.select("doc_id", "text"), analyzer)
        positional_postings(tokens).write.mode("overwrite").parquet(f"{path}/postings/segment={number}")
        document_lengths(tokens).write.mode("overwrite").parquet(f"{path}/docs/segment={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_segments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings with tf, term frequencies, documents) of all segments so far. A document is in one segment."""
    postings = spark.read.parquet(f"{path}/postings").select("term", "doc_id", F.size("positions").cast("long").alias("tf"), "positions")
    return postings, document_frequencies(postings), spark.read.parquet(f"{path}/docs").select("doc_id", "dl")

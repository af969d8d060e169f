"""A file of stop words, one a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stop words go into every plan that uses them, so there is a bound on how many a file may hold.
MOST = 100_000


def stop_word_table(spark: SparkSession, path: str) -> DataFrame:
    """(word): the distinct lines of the file, as they stand; empty lines are none."""
    return spark.read.text(path).select(F.col("value").alias("word")).where("word <> ''").distinct()


def read_stop_words(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The words in order, for an Analyzer. A file of more than MOST words is refused."""
    words = sorted(r.word for r in stop_word_table(spark, path).limit(MOST + 1).collect())
    if len(words) > MOST:
        raise ValueError(f"{path} holds more than {MOST} words")
    return tuple(words)

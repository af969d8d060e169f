"""Relevance judgments: a line 'Q:<query>' opens a block of lines '<ext_id><TAB><grade>'; blank lines part blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query, ord, ext_id, grade), ord from 0 within a query.

    A judgment file is small and made by hand; its lines are numbered in file order within one task.
    A later block of the same query replaces an earlier one.
    """
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    is_query = F.col("value").contains("Q:")
    by_line = Window.orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = lines.select("line", "value", is_query.alias("opens"), F.last(F.when(is_query, F.struct(F.col("line").alias("at"), F.trim(F.get(F.split("value", ":"), F.lit(1))).alias("query"))), True).over(by_line).alias("block"))
    rows = marked.where("not opens and trim(value) <> '' and block is not null")
    parts = F.split(F.trim("value"), "\t")
    rows = rows.select(F.col("block.query").alias("query"), F.col("block.at").alias("at"), "line", F.get(parts, F.lit(0)).alias("ext_id"), F.get(parts, F.lit(1)).cast("int").alias("grade"))
    last = F.max("at").over(Window.partitionBy("query"))
    rows = rows.withColumn("last", last).where("at = last")
    place = F.row_number().over(Window.partitionBy("query").orderBy("line")) - 1
    return rows.select("query", place.cast("long").alias("ord"), "ext_id", "grade")

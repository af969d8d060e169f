"""Postings as lines of text, term first, and back: the exchange format of the three layouts and of weighted postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entry_text(layout: str, weighted: bool = False) -> Column:
    """One posting: d | d:tf | d:p,p,p, with /w for a weight."""
    doc = F.col("doc_id").cast("string")
    tail = {
        "boolean": F.lit(""),
        "frequency": F.concat(F.lit(":"), F.col("tf").cast("string")) if layout == "frequency" else F.lit(""),
        "positional": F.concat(F.lit(":"), F.array_join(F.transform("positions", lambda p: p.cast("string")), ",")) if layout == "positional" else F.lit(""),
    }[layout]
    weight = F.concat(F.lit("/"), F.round("w", 3).cast("string")) if weighted else F.lit("")
    return F.concat(doc, tail, weight)


#: Bytes of text whose postings meet in one task when they become lines.
TASK_TEXT = 8 << 20


def parts_for(docs: DataFrame, text: str = "text") -> int:
    """Parts in which the postings of a table of documents are to be made lines: the session's shuffle partitions, and more for more text."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_TEXT))


def to_lines(postings: DataFrame, layout: str, weighted: bool = False, parts: int | None = None) -> DataFrame:
    """(term, line) with postings in the order of doc_id. Meant for export: one term's postings become one line.

    parts: over how many tasks terms are dealt, in place of the session's number.
    """
    entries = postings.select("term", F.struct("doc_id", entry_text(layout, weighted).alias("e")).alias("x"))
    if parts:
        entries = entries.repartition(parts, "term")
    return entries.groupBy("term").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["e"]), " ").alias("rest")).select("term", F.concat_ws(" ", "term", "rest").alias("line"))


def from_lines(lines: DataFrame, layout: str, weighted: bool = False) -> DataFrame:
    """Postings of lines; a trailing '#idf' is accepted and dropped."""
    # a line is cut once, below the rows that it becomes: none of them carries it
    cut = lines.select(F.substring_index("line", " ", 1).alias("term"), F.split("line", " ").alias("parts"))
    cut = cut.select("term", (F.size("parts") - 1).alias("n"), F.slice("parts", 2, F.size("parts")).alias("parts"))
    rows = cut.select("term", "n", F.posexplode_outer("parts").alias("at", "e")).where("at is not null")
    rows = rows.select("term", F.when(F.col("at") + 1 == F.col("n"), F.regexp_replace("e", "#[^#]*$", "")).otherwise(F.col("e")).alias("e"))
    body, w = F.split_part("e", F.lit("/"), F.lit(1)), F.split_part("e", F.lit("/"), F.lit(2)).cast("double").alias("w")
    doc, value = F.split_part(body, F.lit(":"), F.lit(1)).cast("long").alias("doc_id"), F.split_part(body, F.lit(":"), F.lit(2))
    more = {"boolean": [], "frequency": [value.cast("long").alias("tf")], "positional": [F.transform(F.split(value, ","), lambda p: p.cast("int")).alias("positions")]}[layout]
    return rows.select("term", doc, *more, *([w] if weighted else []))

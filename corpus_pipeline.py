"""The corpus pipeline over the documents table: toxicity, quality rules, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlode.llm import jaccard_join, packing, quality_rules, toxicity
from textlode.llm.common import park, ship, table

#: Rejected rows up to this many are broadcast as two numbers each; more are joined by exchange.
BROADCAST_REJECTS = 500_000


def without(docs: DataFrame, rejects: DataFrame, keys: list[str]) -> DataFrame:
    """docs whose keys are not among the rejects."""
    return docs.join(F.broadcast(rejects) if rejects.count() <= BROADCAST_REJECTS else rejects, keys, "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. The model is learnt from the labels of the documents at hand; without labels all stay.

    A null text is scored as an empty one; repeated rows are scored each; an empty table stays empty; other
    columns pass through, whatever their names.
    """
    ship(spark)
    model = toxicity.train_on(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_table(docs, model, score="_tl_score").where("_tl_score < 0.5").drop("_tl_score")


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. A verdict depends on text and source only, and is keyed by two digests of them.

    Null and empty texts have no words and go; a null source is a host of its own; repeated rows share their
    verdict; an empty table stays empty; other columns pass through, whatever their names.
    """
    ship(spark)
    keys = {"_tl_a": F.xxhash64("source", "text"), "_tl_b": F.xxhash64(F.lit(1), "text", "source")}
    keyed = docs.withColumns(keys)
    verdicts = quality_rules.judge(keyed, list(keys))
    rejects = park(verdicts.where(~F.col("kept")).select(*keys).distinct(), "rejects")
    return without(keyed, rejects, list(keys)).drop(*keys)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: the smallest doc_id, of equal ones the smallest digest of its text.

    So the table's files and their order do not matter. Null texts are near nothing and stay; texts without words
    are copies of each other; of rows with the same doc_id and text one stays (any: only other columns could tell
    them apart); an empty table stays empty; other columns pass through, whatever their names.
    """
    ship(spark)
    numbered = park(docs.withColumn("_tl_row", F.monotonically_increasing_id()), "numbered")
    found = park(jaccard_join.near_duplicates(numbered, row="_tl_row"), "near")
    first = found.groupBy("class_row").agg(F.count("*").alias("n"), F.min(F.struct("doc", "th", "row")).alias("first")).where("n > 1").select("class_row", F.col("first.row").alias("first"))
    rejects = found.join(jaccard_join.few(park(first, "first")), "class_row").where("row <> first").select(F.col("row").alias("_tl_row"))
    return without(numbered, park(rejects, "rejects"), ["_tl_row"]).drop("_tl_row")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, in sequences of at most 4096 tokens.

    A null text is empty: its piece is the end identifier alone. Repeated rows are packed each; an empty table
    gives no pieces; columns other than doc_id and text are not read.
    """
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("quality_rules", drop_poor), ("ngram_jaccard", drop_copies), ("best_fit_packing", pack)]

#: SQL can express neither the scores nor the token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = park(stage(spark, docs, sf_dir), name)
    return docs

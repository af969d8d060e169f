"""Retrieval quality against relevance judgments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import park


def in_order(qrels: DataFrame) -> DataFrame:
    """qrels with ord, the place of a judgment from 0 in the order of doc_id within its query.

    Rows are dealt in ranges of (query_id, doc_id) and numbered there; each range tells how many rows of each query it has, so
    that the judgments of one query are spread over tasks.
    """
    n = int(qrels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["query_id", "doc_id"]
    rows = park(qrels.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "judgments")
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    counts = rows.groupBy("query_id", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))  # a row for each range and query in it
    before = Window.partitionBy("query_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")
    starts = counts.select(F.col("query_id").alias("_query"), F.col("_part").alias("_range"), shift)
    same = (F.col("_part") == F.col("_range")) & F.col("query_id").eqNullSafe(F.col("_query"))
    return rows.join(starts, same).select(*qrels.columns, (F.col("_at") + F.col("_shift")).alias("ord"))


def judged_hits(results: DataFrame, qrels: DataFrame) -> DataFrame:
    """Rows of a result that the judgments of its query name. results: query_id, doc_id; qrels: query_id, doc_id."""
    return results.join(qrels.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi")


def precision_recall(results: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, precision, recall, f_score) of judged queries. A query without results has precision 0; one without judgments is left out."""
    judged = qrels.groupBy("query_id").agg(F.count("*").alias("n_judged"))
    returned = results.groupBy("query_id").agg(F.count("*").alias("n_returned"))
    hits = judged_hits(results, qrels).groupBy("query_id").agg(F.count("*").alias("n_hits"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    rows = judged.join(returned, "query_id", "left").join(hits, "query_id", "left")
    rows = rows.select("query_id", F.when(n("n_returned") > 0, n("n_hits") / n("n_returned")).otherwise(0.0).alias("precision"), (n("n_hits") / n("n_judged")).alias("recall"))
    both = F.col("precision") + F.col("recall")
    return rows.withColumn("f_score", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def discounted(gain, place):
    """2 ** gain - 1 over log2(place + 1), places from 1."""
    return (F.pow(F.lit(2.0), gain) - 1) / F.log2(place + 1.0)


def ndcg_reference(results: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, ndcg): gains are the model's scores, and the ideal sums all judgments in file order; not bounded by 1.

    results: query_id, rank, score; qrels: query_id, ord (from 0), grade.
    """
    dcg = results.groupBy("query_id").agg(F.sum(discounted(F.col("score"), F.col("rank"))).alias("dcg"))
    ideal = qrels.groupBy("query_id").agg(F.sum(discounted(F.col("grade").cast("double"), F.col("ord") + 1)).alias("idcg"))
    return ideal.join(dcg, "query_id", "left").select("query_id", F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def ndcg(results: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg) in the usual sense: gains are grades, the ideal is the best possible k."""
    gains = results.where(F.col("rank") <= k).join(qrels.select("query_id", "doc_id", "grade"), ["query_id", "doc_id"])
    dcg = gains.groupBy("query_id").agg(F.sum(discounted(F.col("grade").cast("double"), F.col("rank"))).alias("dcg"))
    best = qrels.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id"))).where(F.col("place") <= k)
    ideal = best.groupBy("query_id").agg(F.sum(discounted(F.col("grade").cast("double"), F.col("place"))).alias("idcg"))
    return ideal.join(dcg, "query_id", "left").select("query_id", F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def summary(metrics: DataFrame, latencies: DataFrame | None = None) -> DataFrame:
    """One row: mean precision, recall and F-score; with latencies (query_id, seconds, n_results) also the exact median and results per second."""
    out = metrics.agg(*[F.avg(c).alias(f"mean_{c}") for c in ("precision", "recall", "f_score")])
    if latencies is not None:
        out = out.crossJoin(latencies.agg(F.percentile("seconds", F.lit(0.5)).alias("median_seconds"), (F.sum("n_results") / F.sum("seconds")).alias("results_per_second")))
    return out


def loop(results: DataFrame, qrels: DataFrame, sizes: list[int]) -> DataFrame:
    """(n, query_id, n_results, precision, recall, f_score, ndcg) for every n of sizes, each over the first n results of a query.

    results: query_id, doc_id, rank, score, at least as deep as the largest n; qrels: query_id, doc_id, ord, grade.
    ndcg is that of `ndcg_reference`. Judged queries only; one without results has zeros.
    """
    out = None
    for n in sizes:
        first = results.where(F.col("rank") <= n)
        counts = first.groupBy("query_id").agg(F.count("*").alias("n_results"))
        rows = precision_recall(first, qrels).join(ndcg_reference(first, qrels), "query_id").join(counts, "query_id", "left")
        rows = rows.select(F.lit(n).alias("n"), "query_id", F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), "precision", "recall", "f_score", "ndcg")
        out = rows if out is None else out.unionByName(rows)
    return out


def loop_summary(metrics: DataFrame) -> DataFrame:
    """One row for each n of `loop`: means over its queries, and the results of all of them."""
    means = [F.avg(c).alias(f"mean_{c}") for c in ("precision", "recall", "f_score", "ndcg")]
    return metrics.groupBy("n").agg(F.count("*").alias("n_queries"), F.sum("n_results").alias("n_results"), *means)

"""Search: query analysis, lookup, unranked, TF-IDF and BM25 scores, proximity, top-k.

A query matches every document that has one of its terms. Scores are columns over the postings of
the query terms; those are picked by a pushed-down IN when the terms are few, and by a join when not.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from enum import Enum

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.analysis import Analyzer, analyze, positions
from .index import Hooks, Index, PostingType, half_even, register_hooks

#: Query terms up to this many go to the scan as a list.
PUSHED_TERMS = 2000
#: Fixed values of the proximity measure: how far apart positions may be, its largest logarithm, the weight of what lies beyond, and of the boost in each ranker.
REACH, CEILING, BEYOND, BM25_BOOST, TFIDF_BOOST = 10, math.log10(15), 0.8, 0.01, 0.1


class RankingMethod(Enum):
    TF_IDF = "tf-idf"
    TF_IDF_OPTIMIZED = "tf-idf-optimized"
    BM25 = "bm25"
    BM25_OPTIMIZED = "bm25-optimized"


def query_table(spark: SparkSession, queries: list[tuple[int, str]]) -> DataFrame:
    return local(spark, {"query_id": ("long", [i for i, _ in queries]), "query": ("string", [q for _, q in queries])})


#: Query tokens up to this many are kept as a local table, so that a search analyses its queries once.
LOCAL_TOKENS = 20_000


def query_tokens(queries: DataFrame, analyzer: Analyzer) -> DataFrame:
    """(query_id, pos, term), positions from 0, by the analyzer of the index."""
    return positions(analyze(queries, analyzer, "query_id", "query"), "query_id").select("query_id", "pos", "term")


def local(spark: SparkSession, columns: dict[str, tuple[str, list]]) -> DataFrame:
    """A small table from the driver: a local relation, whose size the planner knows."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return spark.createDataFrame(pa.table({c: pa.array(v, kinds[t]) for c, (t, v) in columns.items()}))


class Asked:
    """What a table of queries asks for: counts (query_id, term, qtf) and pairs (query_id, i, j, t1, t2), terms i before j and different.

    Few query tokens are worked on once, on the driver; many stay a plan.
    """

    def __init__(self, queries: DataFrame, analyzer: Analyzer) -> None:
        spark, tokens = queries.sparkSession, query_tokens(queries, analyzer)
        rows = tokens.limit(LOCAL_TOKENS + 1).collect()
        self.wanted: list[str] | None = None
        if len(rows) <= LOCAL_TOKENS:
            counts = sorted(Counter((r.query_id, r.term) for r in rows).items())
            self.counts = local(spark, {"query_id": ("long", [k[0] for k, _ in counts]), "term": ("string", [k[1] for k, _ in counts]), "qtf": ("long", [n for _, n in counts])})
            by_query = defaultdict(list)
            for r in sorted(rows):
                by_query[r.query_id].append((r.pos, r.term))
            if sum(len(x) ** 2 for x in by_query.values()) <= LOCAL_TOKENS:
                pairs = [(q, i, j, a, b) for q, found in by_query.items() for i, a in found for j, b in found if i < j and a != b]
                self.pairs = local(spark, {c: (t, [x[k] for x in pairs]) for k, (c, t) in enumerate((("query_id", "long"), ("i", "int"), ("j", "int"), ("t1", "string"), ("t2", "string")))})
                tokens = None
            terms = {r.term for r in rows}
            self.wanted = sorted(terms) if len(terms) <= PUSHED_TERMS else None
        else:
            self.counts = tokens.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
        if tokens is not None:
            a = tokens.select("query_id", F.col("pos").alias("i"), F.col("term").alias("t1"))
            b = tokens.select("query_id", F.col("pos").alias("j"), F.col("term").alias("t2"))
            self.pairs = a.join(b, "query_id").where("i < j and t1 <> t2")

    def lookup(self, table: DataFrame) -> DataFrame:
        """Rows of a term-sorted table for the queries' terms."""
        if self.wanted is not None:
            return table.where(F.col("term").isin(self.wanted))
        return table.join(self.counts.select("term").distinct(), "term", "left_semi")


def asked_of(queries, analyzer: Analyzer) -> Asked:
    return queries if isinstance(queries, Asked) else Asked(queries, analyzer)


def unranked(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): every match of every distinct query term with score 0, a document once for each of its terms."""
    asked = asked_of(queries, index.analyzer)
    return asked.lookup(index.postings).join(asked.counts, "term").select("query_id", "doc_id", F.lit(0.0).alias("score"))


def idf(n_docs: int, df: Column, letter: str) -> Column:
    """n: 1; t: ln(N/df); p: ln((N-df)/df), 0 at least; to three places."""
    if letter == "n":
        return F.lit(1.0)
    n, df = F.lit(float(n_docs)), df.cast("double")
    if letter == "t":
        return half_even(F.log(n / df))
    return F.when(df >= n, 0.0).otherwise(half_even(F.greatest(F.lit(0.0), F.log((n - df) / df))))


def damp(tf: Column, letter: str) -> Column:
    """n: tf; l: 1 + ln tf; b: 1."""
    tf = tf.cast("double")
    return {"n": tf, "l": 1 + F.log(tf), "b": F.lit(1.0)}[letter]


def check_schema(schema: str) -> tuple[str, str]:
    """The document and query triples of a schema ddd.qqq."""
    ok = len(schema) == 7 and schema[3] == "." and all(schema[i] in "nlb" and schema[i + 1] in "ntp" and schema[i + 2] in "nc" for i in (0, 4))
    if not ok:
        raise ValueError(f"{schema!r} is no schema ddd.qqq of letters [nlb][ntp][nc]")
    return schema[:3], schema[4:]


def need(index: Index, kinds: tuple[PostingType, ...]) -> None:
    if index.kind not in kinds:
        raise ValueError(f"this ranker needs {' or '.join(k.value for k in kinds)} postings, not {index.kind.value}")


COUNTED = (PostingType.FREQUENCY, PostingType.POSITIONAL)


def document_weight(triple: str) -> Column:
    """The weight of a posting: its damped frequency over the document's norm (c), or 1 for every posting (n); to three places."""
    if triple[2] == "n":
        return F.lit(1.0)
    return half_even(damp(F.col("tf"), triple[0]) / F.sqrt(f"sq_{triple[0]}"))


def document_weights(index: Index, triple: str) -> DataFrame:
    check_schema(f"{triple}.nnn")
    need(index, COUNTED)
    return index.postings.select("doc_id", "term", document_weight(triple).alias("w"))


def tfidf(index: Index, queries: DataFrame, schema: str = "lnc.ltc") -> DataFrame:
    """(query_id, doc_id, score). The document side's idf multiplies after its norm; a query's norm is over the terms that the index has."""
    doc, query = check_schema(schema)
    need(index, COUNTED)
    asked = asked_of(queries, index.analyzer)
    known = asked.lookup(index.terms)
    weights = asked.counts.join(known, "term").select("query_id", "term", (damp(F.col("qtf"), query[0]) * idf(index.n_docs, F.col("df"), query[1])).alias("raw"), idf(index.n_docs, F.col("df"), doc[1]).alias("idf"))
    if query[2] == "c":
        norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("query_id")))
        weights = weights.withColumn("qw", F.when(norm > 0, F.col("raw") / norm).otherwise(0.0))
    else:
        weights = weights.withColumn("qw", F.lit(1.0))
    hits = asked.lookup(index.postings).select("term", "doc_id", document_weight(doc).alias("w"))
    return hits.join(weights, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("idf") * F.col("w") * F.col("qw")).alias("score"))


def bm25(index: Index, queries: DataFrame, k: float = 0.75, b: float = 0.5) -> DataFrame:
    """(query_id, doc_id, score). A term counts once however often the query repeats it."""
    need(index, COUNTED)
    asked = asked_of(queries, index.analyzer)
    known = asked.counts.join(asked.lookup(index.terms), "term").select("query_id", "term", idf(index.n_docs, F.col("df"), "t").alias("idf"))
    tf, nd = F.col("tf").cast("double"), index.doc_norm(F.col("dl"))
    part = tf * (k + 1) / (tf + k * (1 - b + b * nd))
    hits = asked.lookup(index.postings).select("term", "doc_id", part.alias("part"))
    return hits.join(known, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("idf") * F.col("part")).alias("score"))


def matched_pairs(index: Index, queries) -> DataFrame:
    """(query_id, doc_id, dl, i, j, p1, p2): for each pair of query positions, both terms' position lists in each document that has both.

    A row is a pair in a document; positions stay in their arrays, so frequent terms make no rows.
    """
    need(index, (PostingType.POSITIONAL,))
    asked = asked_of(queries, index.analyzer)
    lists = asked.lookup(index.postings).select("term", "doc_id", "dl", "positions")
    first = lists.select(F.col("term").alias("t1"), "doc_id", "dl", F.col("positions").alias("p1"))
    second = lists.select(F.col("term").alias("t2"), "doc_id", F.col("positions").alias("p2"))
    return first.join(asked.pairs, "t1").join(second, ["doc_id", "t2"]).select("query_id", "doc_id", "dl", "i", "j", "p1", "p2")


#: Pairs of two position lists up to which they are compared inside arrays; longer lists meet by bins.
COMPARED = 4096


def short_lists(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matched pairs whose lists are compared as they are, and the others."""
    few = F.size("p1").cast("long") * F.size("p2") <= COMPARED
    return rows.where(few), rows.where(~few)


def met_by_bins(rows: DataFrame, how: str = "inner") -> DataFrame:
    """Long lists as rows: (query_id, doc_id, dl, i, j, p1, p2) of positions within reach. A bin is as wide as the reach,
    so a first position meets the second ones of three bins: at most as many as there are places in reach, however long the lists are."""
    width = REACH + 1
    keys = ["query_id", "doc_id", "i", "j"]
    first = rows.select(*keys, "dl", F.explode("p1").alias("p1")).withColumn("bin", F.floor(F.col("p1") / width))
    second = rows.select(*keys, F.explode("p2").alias("p2")).withColumn("at", F.floor(F.col("p2") / width))
    second = second.withColumn("bin", F.explode(F.array(F.col("at") - 1, F.col("at"), F.col("at") + 1))).drop("at")
    near = F.abs(second["p2"] - first["p1"]) <= REACH
    return first.join(second, [*(first[c].eqNullSafe(second[c]) for c in keys), first["bin"] == second["bin"], near], how).select(*(first[c] for c in keys), "dl", "p1", "p2")


def position_pairs(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, i, j, p1, p2) of positions within reach of each other, one row each."""
    short, long = short_lists(matched_pairs(index, queries))
    rows = short.select("query_id", "doc_id", "i", "j", F.explode("p1").alias("p1"), "p2")
    near = F.filter("p2", lambda p: F.abs(p - F.col("p1")) <= REACH)
    inside = rows.select("query_id", "doc_id", "i", "j", "p1", F.explode(near).alias("p2"))
    return inside.unionByName(met_by_bins(long).drop("dl"))


def closeness(gap: Column, p1: Column, p2: Column) -> Column:
    """How well two positions fit two query positions `gap` apart (counted with one more than their difference)."""
    apart = p2 - p1
    dist = F.when(apart < 0, apart - gap).otherwise(gap - apart)
    return F.when(dist >= 0, CEILING - F.log10(dist + 1.0)).otherwise(BEYOND * (F.log10(1.0 - dist) + CEILING))


def proximity(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, dl, s, boost): for each first position its best fitting second, summed; the boost is its logarithm, 0 for no sum."""
    gap = F.col("j") - F.col("i") + 1

    def best(p1: Column) -> Column:
        near = F.filter("p2", lambda p2: F.abs(p2 - p1) <= REACH)
        return F.greatest(F.lit(0.0), F.coalesce(F.array_max(F.transform(near, lambda p2: closeness(gap, p1, p2))), F.lit(0.0)))

    short, long = short_lists(matched_pairs(index, queries))
    short = short.select("query_id", "doc_id", "dl", F.aggregate(F.transform("p1", best), F.lit(0.0), lambda a, x: a + x).alias("part"))
    met = met_by_bins(long, "left").withColumn("part", F.greatest(F.lit(0.0), F.coalesce(closeness(gap, F.col("p1"), F.col("p2")), F.lit(0.0))))
    long = met.groupBy("query_id", "doc_id", "dl", "i", "j", "p1").agg(F.max("part").alias("part"))
    sums = short.unionByName(long.select("query_id", "doc_id", "dl", "part")).groupBy("query_id", "doc_id", "dl").agg(F.sum("part").alias("s"))
    return sums.withColumn("boost", F.when(F.col("s") > 0, F.log10("s")).otherwise(0.0))


def bm25_proximity(index: Index, queries: DataFrame, k: float = 0.75, b: float = 0.5) -> DataFrame:
    """BM25 plus the boost, less for long documents. Where all lengths are equal, or the document is the shortest, there is no boost."""
    queries = asked_of(queries, index.analyzer)
    low, high = index.stats["min_norm"] or 0.0, index.stats["max_norm"] or 0.0
    boosts = proximity(index, queries).where("boost > 0")
    place = (index.doc_norm(F.col("dl")) - low) / F.lit((high - low) or 1.0)
    more = F.when((F.lit(high > low)) & (place > 0), BM25_BOOST * F.col("boost") / F.log2(place + 1)).otherwise(0.0)
    boosts = boosts.select("query_id", "doc_id", more.alias("more"))
    return bm25(index, queries, k, b).join(boosts, ["query_id", "doc_id"], "left").select("query_id", "doc_id", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))


def tfidf_proximity(index: Index, queries: DataFrame, schema: str = "lnc.ltc") -> DataFrame:
    """TF-IDF plus a tenth of the boost."""
    queries = asked_of(queries, index.analyzer)
    boosts = proximity(index, queries).where("boost > 0").select("query_id", "doc_id", "boost")
    return tfidf(index, queries, schema).join(boosts, ["query_id", "doc_id"], "left").select("query_id", "doc_id", (F.col("score") + TFIDF_BOOST * F.coalesce("boost", F.lit(0.0))).alias("score"))


#: A ranker with columns of its own in the index: the most frequent term's count in a document, and a term's count in the corpus.
AUGMENTED = "augmented"
register_hooks(AUGMENTED, Hooks({"max_tf": lambda of_doc: F.max("tf").over(of_doc)}, {"cf": lambda: F.sum("tf")}, {"augmented_floor": 0.5}))


def augmented(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): frequencies against the document's highest, from the floor kept in the index up to 1, by the
    logarithm of all tokens over those of the term. For an index that was built for this ranker."""
    if AUGMENTED not in index.rankers:
        raise ValueError("the index was not built for this ranker: Index.build(rankers=('augmented',))")
    asked, floor = asked_of(queries, index.analyzer), index.meta["augmented_floor"]
    n_tokens = F.lit(float(index.n_docs) * (index.stats["avgdl"] or 0.0))
    known = asked.counts.join(asked.lookup(index.terms), "term").select("query_id", "term", F.log(n_tokens / F.col("cf")).alias("icf"))
    hits = asked.lookup(index.postings).select("term", "doc_id", (floor + (1 - floor) * F.col("tf") / F.col("max_tf")).alias("part"))
    return hits.join(known, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("icf") * F.col("part")).alias("score"))


#: Rankers by method: f(index, queries, **parameters) -> (query_id, doc_id, score).
RANKERS = {None: unranked, RankingMethod.BM25: bm25, RankingMethod.BM25_OPTIMIZED: bm25_proximity, RankingMethod.TF_IDF: tfidf, RankingMethod.TF_IDF_OPTIMIZED: tfidf_proximity, AUGMENTED: augmented}


def register_ranker(name, ranker) -> None:
    """Add a ranker of one's own."""
    RANKERS[name] = ranker


def rank(index: Index, queries: DataFrame, method=None, **parameters) -> DataFrame:
    if method not in RANKERS:
        raise ValueError(f"unknown ranker {method!r}")
    return RANKERS[method](index, queries, **parameters)


def rounded(scores: DataFrame) -> DataFrame:
    return scores.withColumn("score", F.round("score", 6))


def top_k(scores: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best of each query, ties to the smaller doc_id.

    Spark keeps k rows of a query in each task before the exchange (a limit on the window's group).
    """
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return rounded(scores).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("long"), "doc_id", "score")


def resolve(results: DataFrame, mapping: DataFrame) -> DataFrame:
    """External ids for the few rows of a result."""
    return results.join(mapping, "doc_id")

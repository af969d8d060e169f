"""Headline timings: index builds of three layouts, and searches of a batch of 13 queries by each ranker; medians of three runs, of 13 for single searches.

Prints one JSON line. BENCH_SF_DIR: the tables; BENCH_CPUS: cores.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from textlode.functions.analysis import STANDARD
from textlode.operators import scoring
from textlode.operators.index import Index, PostingType
from textlode.operators.scoring import RankingMethod
from textlode.session import local_session, ship, table

#: 13 queries of one to three words, as many as the published benchmark asks.
WORDS = "anea thanedble erou tionea ontha ingble thereon erthe anding reshan heanon oneas tiontion".split()
QUERIES = [(i, " ".join(WORDS[i : i + 1 + i % 3])) for i in range(len(WORDS))]


def timed(work) -> float:
    began = time.perf_counter()
    work()
    return time.perf_counter() - began


def thrice(work) -> float:
    return statistics.median(timed(work) for _ in range(3))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")
    seconds: dict[str, float] = {}
    built = {}
    for kind in PostingType:
        seconds[f"build_{kind.value}"] = thrice(lambda kind=kind: built.update({kind: Index.build(docs, STANDARD, kind)}))
    index = built[PostingType.POSITIONAL]
    runs = {"tfidf": RankingMethod.TF_IDF, "tfidf_proximity": RankingMethod.TF_IDF_OPTIMIZED, "bm25": RankingMethod.BM25, "bm25_proximity": RankingMethod.BM25_OPTIMIZED}
    for name, method in runs.items():
        one = lambda q: scoring.top_k(scoring.rank(index, scoring.query_table(spark, [q]), method), 10).collect()
        one(QUERIES[0])  # the first compiles the plan
        seconds[f"search_{name}"] = statistics.median(timed(lambda q=q: one(q)) for q in QUERIES)
        seconds[f"batch_{name}"] = thrice(lambda: scoring.top_k(scoring.rank(index, scoring.query_table(spark, QUERIES), method), 10).collect())
    print(json.dumps({"metric": "index build and search", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": {k: round(v, 3) for k, v in seconds.items()}, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()

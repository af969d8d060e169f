"""Command line: index, search and evaluate.

    python -m textlode.cli index --documents a.tsv.gz --out DIR [--stop-words FILE] [--min-token-length N]
        [--language english] [--posting-list-type positional] [--ranker bm25] [--k K] [--b B] [--schema lnc.ltc]
        [--max-block-size N] [--max-ram PERCENT]
    python -m textlode.cli search --index DIR [--n 10] [--show-score] [QUERY]      (a shell without QUERY; q ends it)
    python -m textlode.cli evaluate --index DIR --qrels FILE [--n 10 20 50]

--max-block-size makes a task's sort go to disk after so many rows, --max-ram gives the engine so many percent of the
machine's memory. Both are settings of the local session made here, and change no result; a cluster has its own.
"""

from __future__ import annotations

import argparse
import os
import time

from pyspark.sql import functions as F

from .functions.analysis import Analyzer
from .operators import evaluation, scoring
from .operators.index import Index, PostingType
from .operators.scoring import RankingMethod
from .session import local_session, ship
from .sources.qrels import read_qrels
from .sources.reviews import number_documents, read_reviews
from .sources.stop_words import read_stop_words


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="textlode")
    sub = top.add_subparsers(dest="command", required=True)
    make = sub.add_parser("index")
    make.add_argument("--documents", nargs="+", required=True)
    make.add_argument("--out", required=True)
    make.add_argument("--stop-words")
    make.add_argument("--min-token-length", type=int, default=0)
    make.add_argument("--language")
    make.add_argument("--posting-list-type", type=PostingType, default=PostingType.FREQUENCY)
    make.add_argument("--ranker", type=RankingMethod)
    make.add_argument("--k", type=float, default=0.75)
    make.add_argument("--b", type=float, default=0.5)
    make.add_argument("--schema", default="lnc.ltc")
    make.add_argument("--max-block-size", type=int, help="rows that a sort holds before it goes to disk")
    make.add_argument("--max-ram", type=int, help="percent of the machine's memory for the engine")
    ask = sub.add_parser("search")
    ask.add_argument("--index", required=True)
    ask.add_argument("--n", type=int, default=10)
    ask.add_argument("--show-score", action="store_true")
    ask.add_argument("query", nargs="?")
    judge = sub.add_parser("evaluate")
    judge.add_argument("--index", required=True)
    judge.add_argument("--qrels", required=True)
    judge.add_argument("--n", type=int, nargs="+", default=[10, 20, 50])
    return top


def build(spark, args) -> Index:
    stop = read_stop_words(spark, args.stop_words) if args.stop_words else ()
    analyzer = Analyzer(args.min_token_length or None, stop, args.language)
    ranker = {"ranker": args.ranker.value if args.ranker else None}
    if args.ranker in (RankingMethod.BM25, RankingMethod.BM25_OPTIMIZED):
        ranker |= {"k": args.k, "b": args.b}
    elif args.ranker:
        scoring.check_schema(args.schema)
        ranker |= {"schema": args.schema}
    docs = number_documents(read_reviews(spark, args.documents))
    return Index.build(docs, analyzer, args.posting_list_type, meta=ranker, path=args.out, extra={"mapping": docs.select("doc_id", "ext_id")})


def method_of(index: Index) -> tuple:
    name = index.meta.get("ranker")
    return (RankingMethod(name) if name else None), {k: index.meta[k] for k in ("k", "b", "schema") if k in index.meta}


def run_search(spark, path: str, queries: list[tuple[int, str]], n: int):
    index = Index.open(spark, path)
    method, parameters = method_of(index)
    best = scoring.top_k(scoring.rank(index, scoring.query_table(spark, queries), method, **parameters), n)
    return scoring.resolve(best, index.extra["mapping"]).orderBy("query_id", "rank")


def session_of(args):
    """A local session under the limits that the arguments name."""
    share, rows = getattr(args, "max_ram", None), getattr(args, "max_block_size", None)
    if (share is not None and not 0 < share <= 100) or (rows is not None and rows < 1):
        raise ValueError("--max-ram is a percentage from 1 to 100, --max-block-size a positive number")
    machine = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") >> 20
    limits = {"memory": f"{max(512, machine * share // 100)}m"} if share else {}
    return local_session(**limits, settings={"spark.shuffle.spill.numElementsForceSpillThreshold": str(rows)} if rows else {})


def main(argv=None) -> None:
    args = parser().parse_args(argv)
    spark = session_of(args)
    ship(spark)
    if args.command == "index":
        began = time.perf_counter()
        index = build(spark, args)
        print(f"{index.n_docs} documents, {index.terms.count()} terms, {1000 * (time.perf_counter() - began):.0f} ms")
    elif args.command == "search":
        while (query := args.query if args.query is not None else input("query (q ends): ")) != "q":
            began = time.perf_counter()
            for row in run_search(spark, args.index, [(0, query)], args.n).collect():
                print(row.ext_id, *([row.score] if args.show_score else []))
            print(f"{1000 * (time.perf_counter() - began):.0f} ms")
            if args.query is not None:
                break
    else:
        qrels = read_qrels(spark, args.qrels)
        names = [r[0] for r in qrels.select("query").distinct().orderBy("query").collect()]
        queries = list(enumerate(names))
        judged = qrels.join(scoring.query_table(spark, queries), "query").withColumnRenamed("ext_id", "doc_id")
        for n in args.n:
            began = time.perf_counter()
            found = run_search(spark, args.index, queries, n).select("query_id", F.col("ext_id").alias("doc_id"), "rank", "score").cache()
            count, seconds = found.count(), time.perf_counter() - began
            metrics = evaluation.precision_recall(found, judged)
            print(f"n={n}: {count / seconds:.1f} results a second", evaluation.summary(metrics).first().asDict(), evaluation.ndcg_reference(found, judged).agg(F.avg("ndcg").alias("ndcg")).first().asDict())
            found.unpersist()


if __name__ == "__main__":
    main()

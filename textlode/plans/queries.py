"""Every query of the engine by name; each takes (spark, sf_dir).

Queries that analyse text take it from the documents table; queries that search share one index
for each folder and setting, built at the first of them and kept for the session.
"""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.analysis import RAW, STANDARD, STOP_WORDS, Analyzer, analyze, positions
from ..functions.sql import register_analysis, register_search
from ..functions.stem import stem_terms as stems_of
from ..operators import blocks, evaluation, scoring
from ..operators import index as ix
from ..operators.fill import forward_fill
from ..operators.index import Index
from ..session import dealt, park, shared_dir, ship, stamp, table
from ..sources import posting_text
from ..sources.qrels import read_qrels
from ..sources.reviews import number_documents, project_text, read_reviews
from ..sources.stop_words import stop_word_table
from ..streaming.growing import GrowingIndex
from .settings import BATCH, LOOKUP, LOOKUP_MANY, PROJECTED, PRUNED, QUERY, SCHEMAS, SHARDS, SIZES, TOP

DATA = Path(__file__).resolve().parents[1] / "sources" / "examples"
INDEXES: dict[tuple, Index] = {}
BLOCKS: dict[tuple, blocks.BlockIndex] = {}


def key_of(spark, d, analyzer: Analyzer) -> tuple:
    """Names an index: another session, other files or newer ones make another."""
    return (spark.sparkContext.applicationId, d, stamp(spark, f"{d}/documents.parquet"), analyzer)


def docs(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def tokens(spark, d, analyzer: Analyzer) -> DataFrame:
    return analyze(dealt(docs(spark, d)), analyzer)


def opened(spark, d, analyzer: Analyzer = STANDARD) -> Index:
    key = key_of(spark, d, analyzer)
    if key not in INDEXES:
        ship(spark)
        INDEXES[key] = Index.build(dealt(docs(spark, d)), analyzer)
    return INDEXES[key]


def blocked(spark, d) -> blocks.BlockIndex:
    key = key_of(spark, d, STANDARD)
    if key not in BLOCKS:
        BLOCKS[key] = blocks.BlockIndex.build(docs(spark, d), STANDARD)
    return BLOCKS[key]


def one(spark):
    return scoring.query_table(spark, [(0, QUERY)])


def batch(spark):
    return scoring.query_table(spark, BATCH)


def scored(method, **parameters):
    def run(spark, d):
        return scoring.rounded(scoring.rank(opened(spark, d), one(spark), method, **parameters)).select("doc_id", "score")

    return run


def spots(analyzer: Analyzer):
    return lambda spark, d: positions(tokens(spark, d, analyzer)).select("doc_id", "pos", "term")


def lines(postings, layout: str):
    return lambda spark, d: posting_text.to_lines(postings(tokens(spark, d, STANDARD)), layout, parts=posting_text.parts_for(docs(spark, d)))


def corpus_stats(spark, d):
    return ix.corpus_statistics(ix.document_lengths(tokens(spark, d, STANDARD)))


def doc_length_norm(spark, d):
    lengths = park(ix.document_lengths(tokens(spark, d, STANDARD)), "lengths")
    average = ix.corpus_statistics(lengths).select("avgdl")
    return lengths.crossJoin(F.broadcast(average)).select("doc_id", ix.half_even(F.col("dl") / F.col("avgdl")).alias("dl_norm"))  # one row


def idf_of(letter: str):
    def run(spark, d):
        index = opened(spark, d)
        return index.terms.select("term", scoring.idf(index.n_docs, F.col("df"), letter).alias("idf"))

    return run


def weights(triple: str):
    return lambda spark, d: scoring.document_weights(opened(spark, d), triple)


def lookup(terms: list[str]):
    return lambda spark, d: opened(spark, d).postings.where(F.col("term").isin(terms)).select("term", "doc_id", "tf")


def top(method=scoring.RankingMethod.BM25, queries=batch, **parameters):
    return lambda spark, d: scoring.top_k(scoring.rank(opened(spark, d), queries(spark), method, **parameters), TOP)


def stop_anti_join(spark, d):
    stop = spark.createDataFrame([(w,) for w in STOP_WORDS], "term string")
    return positions(tokens(spark, d, RAW)).select("term").distinct().join(F.broadcast(stop), "term", "left_anti")  # 127 words


def qrels(spark, d) -> DataFrame:
    """Stand-in judgments: every document of good quality is relevant to every query of the batch; grades and order follow the id."""
    good = table(spark, d, "labels").where("quality = 1").select("doc_id")
    judged = batch(spark).select("query_id").crossJoin(good)  # five queries
    grade = (F.col("doc_id") % 3 + 1).cast("int")
    return judged.select("query_id", "doc_id", grade.alias("grade"))


def ordered_qrels(spark, d) -> DataFrame:
    """The judgments in the order of doc_id within each of the five queries."""
    return evaluation.in_order(qrels(spark, d))


def results(spark, d) -> DataFrame:
    return top()(spark, d)


def six(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def resolve_doc_ids(spark, d):
    mapping = table(spark, d, "documents").select("doc_id", F.concat("source", F.lit("-"), F.col("doc_id").cast("string")).alias("ext_id"))
    return scoring.resolve(top(queries=one)(spark, d), mapping).select("rank", "ext_id", "score")


def boosts(spark, d):
    return six(scoring.proximity(opened(spark, d), one(spark)), "s", "boost").select("doc_id", "s", "boost")


def pairs(spark, d):
    return scoring.position_pairs(opened(spark, d), one(spark)).select("doc_id", "i", "j", "p1", "p2")


def stemmed(spark, d):
    ship(spark)
    return stems_of(positions(tokens(spark, d, RAW)).select("term").distinct())


def stemmed_tokens(spark, d):
    ship(spark)
    return positions(tokens(spark, d, Analyzer(3, STOP_WORDS, "english"))).select("doc_id", "pos", "term")


def eval_loop(spark, d):
    """Every query of the batch at every result size, from one ranking as deep as the largest."""
    found = park(scoring.top_k(scoring.rank(opened(spark, d), batch(spark), scoring.RankingMethod.BM25), max(SIZES)), "found")
    return evaluation.loop(found, ordered_qrels(spark, d), SIZES)


def eval_latency(spark, d):
    """Means, median latency and results a second. Real times differ from run to run, so that of a query is a stand-in: its number squared, in eighths of a second."""
    found = results(spark, d)
    judged = evaluation.precision_recall(found, qrels(spark, d))
    seconds = (F.col("query_id") * F.col("query_id") / F.lit(8.0)).alias("seconds")
    latencies = batch(spark).select("query_id").distinct().join(found.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left")
    latencies = latencies.select("query_id", seconds, F.coalesce("n", F.lit(0)).alias("n_results"))
    return six(evaluation.summary(judged, latencies), "mean_precision", "mean_recall", "mean_f_score", "median_seconds", "results_per_second")


def posting_blocks(spark, d):
    """Blocks in a layout of its own, with as many shards as the SQL has; an index takes the session's number."""
    found = blocks.blocks_of(analyze(docs(spark, d), STANDARD), blocks.SPAN, SHARDS).where("term is not null")
    return found.select("term", "span", "n", "first", "last", "max_tf", "min_dl", F.coalesce("offsets", F.array(F.lit(0).cast("long"))).alias("offsets"), F.coalesce("tfs", F.array("max_tf")).alias("tfs"))


def search_benchmark(spark, d):
    """The texts of the benchmark table as queries."""
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return blocks.search_table(blocked(spark, d), queries, TOP)


#: Micro-batches that the documents come in.
MICRO_BATCHES = 3


def grown(spark, d) -> GrowingIndex:
    """The documents as a stream of files, a third of them in each micro-batch."""
    path = f"{shared_dir(spark)}/textlode/stream-{uuid.uuid4().hex}"
    files = spark.sparkContext.defaultParallelism
    found = docs(spark, d)
    found.repartition(MICRO_BATCHES * files).write.parquet(f"{path}/inbox")
    index = GrowingIndex(spark, f"{path}/index", STANDARD, ix.PostingType.FREQUENCY)
    stream = spark.readStream.schema(found.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/inbox")
    index.stream(stream, f"{path}/checkpoint").awaitTermination()
    return index


def stream_bm25(spark, d):
    return scoring.rounded(scoring.bm25(grown(spark, d).snapshot(), one(spark))).select("doc_id", "score")


def index_snapshot(spark, d):
    """Scores by the first version of an index, opened before a second was committed over it."""
    path = f"{shared_dir(spark)}/textlode/index-{uuid.uuid4().hex}"
    Index.build(docs(spark, d), STANDARD, ix.PostingType.FREQUENCY, path=path)
    first = Index.open(spark, path)
    Index.build(table(spark, d, "benchmark"), STANDARD, ix.PostingType.FREQUENCY, "item_id", path=path)
    if Index.open(spark, path).version != first.version + 1:
        raise RuntimeError("the second version was not committed")
    return scoring.rounded(scoring.bm25(first, one(spark))).select("doc_id", "score")


def ranker_hooks(spark, d):
    """Scores by a ranker that has columns of its own in the index, from an index that was opened again."""
    path = f"{shared_dir(spark)}/textlode/hooked-{uuid.uuid4().hex}"
    Index.build(docs(spark, d), STANDARD, ix.PostingType.FREQUENCY, path=path, rankers=(scoring.AUGMENTED,))
    return scoring.rounded(scoring.rank(Index.open(spark, path), one(spark), scoring.AUGMENTED)).select("doc_id", "score")


def judged_lines(spark, d) -> DataFrame:
    """Labels as the lines of a judgment file: a toxic document opens a block, every document is a line in it."""
    labels = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    line = F.struct(F.lit(1).alias("kind"), F.concat_ws("\t", "doc_id", "quality").alias("value"))
    head = F.struct(F.lit(0).alias("kind"), F.concat(F.lit("Q:"), F.col("doc_id").cast("string")).alias("value"))
    return labels.select("doc_id", F.explode(F.when(F.col("toxic") == 1, F.array(head, line)).otherwise(F.array(line))).alias("x")).select("doc_id", "x.kind", "x.value")


def block_of_lines(spark, d):
    """The block that each line belongs to: its opening line, carried forward."""
    heads = judged_lines(spark, d).withColumn("block", F.when(F.col("kind") == 0, F.col("value")))
    return forward_fill(heads, ["doc_id", "kind", "value"], ["block"])


def numbered(spark, d):
    named = F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("ext_id")
    return number_documents(table(spark, d, "documents").select(named)).select("ext_id", "doc_id")


def sql_tokenize(spark, d):
    register_analysis(spark, STANDARD)
    docs(spark, d).repartition("doc_id").createOrReplaceTempView("textlode_documents")
    # the outer form keeps Catalyst from inferring a filter on the array, which would tokenise twice
    return spark.sql("SELECT d.doc_id, t.pos, t.term FROM (SELECT doc_id, tokenize(text) AS words FROM textlode_documents) AS d, LATERAL posexplode_outer(d.words) AS t(pos, term) WHERE t.pos IS NOT NULL")


def sql_bm25(spark, d):
    register_search(spark, opened(spark, d))
    return spark.sql(f"SELECT doc_id, round(score, 6) AS score FROM search_bm25('{QUERY}')")


def example(name: str) -> str:
    return f"file://{DATA / name}"


QUERIES = {
    "corpus_scan": lambda s, d: docs(s, d),
    "doc_text_projection": lambda s, d: (lambda t: t.select("doc_id", project_text(t.select("source", "lang", "text"), PROJECTED)))(table(s, d, "documents")),
    "tokenize": spots(RAW),
    "token_positions": lambda s, d: ix.positional_postings(tokens(s, d, RAW)).select("doc_id", "term", F.explode("positions").alias("pos")),
    "tokenize_min_len": spots(Analyzer(3)),
    "tokenize_stopwords": spots(Analyzer(None, STOP_WORDS)),
    "analyze_full": spots(STANDARD),
    "stem_terms": stemmed,
    "analyze_stemmed": stemmed_tokens,
    "stopword_anti_join": stop_anti_join,
    "postings_boolean": lambda s, d: ix.boolean_postings(tokens(s, d, STANDARD)),
    "postings_frequency": lambda s, d: ix.frequency_postings(tokens(s, d, STANDARD)),
    "postings_positional": lambda s, d: ix.positional_postings(tokens(s, d, STANDARD)),
    "posting_lines": lines(ix.frequency_postings, "frequency"),
    "posting_lines_boolean": lines(ix.boolean_postings, "boolean"),
    "posting_lines_positional": lines(ix.positional_postings, "positional"),
    "posting_lines_read": lambda s, d: posting_text.from_lines(park(lines(ix.positional_postings, "positional")(s, d).select("line"), "lines"), "positional"),
    "term_df": lambda s, d: opened(s, d).terms.select("term", "df"),
    "vocab_size": lambda s, d: opened(s, d).terms.agg(F.count("*").alias("n_terms")),
    "sorted_terms": lambda s, d: opened(s, d).terms.select("term").orderBy("term"),
    "corpus_stats": corpus_stats,
    "doc_lengths": lambda s, d: ix.document_lengths(tokens(s, d, STANDARD)),
    "doc_length_norm": doc_length_norm,
    "term_lookup": lookup([LOOKUP]),
    "term_lookup_multi": lookup(LOOKUP_MANY),
    "boolean_search": lambda s, d: scoring.unranked(opened(s, d), one(s)).select("doc_id", "score"),
    "idf_plain": idf_of("t"),
    "idf_prob": idf_of("p"),
    **{f"tfidf_doc_weights_{t}": weights(t) for t in ("lnc", "nnc", "bnc", "lnn")},
    **{f"tfidf_{a}_{b}": scored(scoring.RankingMethod.TF_IDF, schema=f"{a}.{b}") for a, b in SCHEMAS},
    "bm25": scored(scoring.RankingMethod.BM25),
    "bm25_k12_b075": scored(scoring.RankingMethod.BM25, k=1.2, b=0.75),
    "topk_bm25": lambda s, d: top(queries=one)(s, d).select("rank", "doc_id", "score"),
    "topk_batch": top(),
    "topk_pruned": lambda s, d: blocks.top_k_pruned(blocked(s, d), scoring.query_table(s, PRUNED), TOP)[0],
    "search_benchmark": search_benchmark,
    "posting_blocks": posting_blocks,
    "posting_blocks_read": lambda s, d: blocked(s, d).postings(),
    "stream_bm25": stream_bm25,
    "index_snapshot": index_snapshot,
    "ranker_hooks": ranker_hooks,
    "forward_fill": block_of_lines,
    "number_documents": numbered,
    "sql_tokenize": sql_tokenize,
    "sql_bm25": sql_bm25,
    "position_pairs": pairs,
    "proximity_boost": boosts,
    "bm25_proximity": scored(scoring.RankingMethod.BM25_OPTIMIZED),
    "tfidf_proximity": scored(scoring.RankingMethod.TF_IDF_OPTIMIZED),
    "resolve_doc_ids": resolve_doc_ids,
    "qrels_semi_join": lambda s, d: evaluation.judged_hits(results(s, d), qrels(s, d)).select("query_id", "doc_id"),
    "eval_precision_recall": lambda s, d: six(evaluation.precision_recall(results(s, d), qrels(s, d)), "precision", "recall", "f_score"),
    "eval_ndcg_reference": lambda s, d: six(evaluation.ndcg_reference(results(s, d), ordered_qrels(s, d)), "ndcg"),
    "eval_ndcg": lambda s, d: six(evaluation.ndcg(results(s, d), qrels(s, d)), "ndcg"),
    "eval_summary": lambda s, d: six(evaluation.summary(evaluation.precision_recall(results(s, d), qrels(s, d))), "mean_precision", "mean_recall", "mean_f_score"),
    "eval_loop": lambda s, d: six(eval_loop(s, d), "precision", "recall", "f_score", "ndcg"),
    "eval_loop_summary": lambda s, d: six(evaluation.loop_summary(eval_loop(s, d)), "mean_precision", "mean_recall", "mean_f_score", "mean_ndcg"),
    "eval_latency": eval_latency,
    "stop_word_file": lambda s, d: stop_word_table(s, example("stop_words.txt")),
    "qrels_load": lambda s, d: read_qrels(s, example("judgments.txt")),
    "reviews_scan": lambda s, d: read_reviews(s, example("reviews.tsv.gz")),
}


def flagship(spark, d) -> DataFrame:
    queries = scoring.query_table(spark, [(0, "anea thanedble erou")])
    return scoring.top_k(scoring.bm25(opened(spark, d), queries), TOP)

import json
import math

import pytest
from pyspark.sql import functions as F

from textlode.functions.analysis import RAW, Analyzer, analyze
from textlode.operators import evaluation, index as ix, scoring
from textlode.operators.index import Index, PostingType
from textlode.operators.scoring import RankingMethod

SMOKE = [(0, "good games for kids"), (1, "good old games games"), (2, "haha lols are funny")]
ALBUMS = [(0, "rock album"), (1, "the greatest rock album ever made"), (2, "album of rock and roll greatest hits collection"), (3, "quiet song")]


@pytest.fixture(scope="module")
def smoke(spark):
    return Index.build(spark.createDataFrame(SMOKE, "doc_id long, text string"))


@pytest.fixture(scope="module")
def albums(spark):
    return Index.build(spark.createDataFrame(ALBUMS, "doc_id long, text string"))


def scores(index, query, method, **parameters):
    found = scoring.rank(index, scoring.query_table(index.spark, [(0, query)]), method, **parameters)
    return {r.doc_id: r.score for r in found.collect()}


def near(found, expected):
    assert found.keys() == expected.keys()
    for doc, score in expected.items():
        assert found[doc] == pytest.approx(score, abs=1e-6)


def test_tfidf(smoke):
    near(scores(smoke, "good old games games", RankingMethod.TF_IDF), {1: 0.8895119390, 0: 0.4018232740})


def test_bm25(smoke):
    near(scores(smoke, "good old games games", RankingMethod.BM25, k=1.2, b=0.75), {1: 2.060875, 0: 0.81})
    near(scores(smoke, "good old games games", RankingMethod.BM25), {1: 2.0194545455, 0: 0.81})


def test_proximity(smoke, albums):
    found = scoring.proximity(smoke, scoring.query_table(smoke.spark, [(0, "good old games games")]))
    near({r.doc_id: r.s for r in found.collect()}, {0: 1.2730012721, 1: 4.9773663083})
    near({r.doc_id: r.boost for r in found.collect()}, {0: 0.1048288376, 1: 0.6969996037})
    near(scores(smoke, "good old games games", RankingMethod.TF_IDF_OPTIMIZED), {1: 0.9592118994, 0: 0.4123061577})
    # all documents are equally long: no boost
    near(scores(smoke, "good old games games", RankingMethod.BM25_OPTIMIZED), scores(smoke, "good old games games", RankingMethod.BM25))
    near(scores(albums, "greatest rock album", RankingMethod.BM25_OPTIMIZED, k=1.2, b=0.75), {1: 1.1225433353, 2: 0.9694063657, 0: 0.7455871970})


def test_unranked_keeps_a_row_for_each_term(smoke):
    found = scoring.rank(smoke, scoring.query_table(smoke.spark, [(0, "good games zzzz")]))
    assert sorted((r.doc_id, r.score) for r in found.collect()) == [(0, 0.0), (0, 0.0), (1, 0.0), (1, 0.0)]


def test_top_k_breaks_ties_by_id(spark):
    rows = spark.createDataFrame([(0, 7, 1.0), (0, 3, 1.0), (0, 9, 2.0), (1, 5, 0.0)], "query_id long, doc_id long, score double")
    found = scoring.top_k(rows, 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.doc_id) for r in found] == [(0, 1, 9), (0, 2, 3), (1, 1, 5)]


@pytest.mark.parametrize("schema", ["", "lnc", "lncltcx", "xnc.ltc", "lxc.ltc", "lnx.ltc", "lnc-ltc"])
def test_bad_schema(schema):
    with pytest.raises(ValueError):
        scoring.check_schema(schema)


def test_every_letter_runs(smoke):
    for doc in ("nnn", "ltc", "bpc"):
        for query in ("ntn", "lpc", "bnc"):
            assert all(math.isfinite(s) for s in scores(smoke, "good old", RankingMethod.TF_IDF, schema=f"{doc}.{query}").values())


def test_layouts(spark, smoke):
    docs = spark.createDataFrame(SMOKE, "doc_id long, text string")
    boolean = Index.build(docs, RAW, PostingType.BOOLEAN)
    assert scores(boolean, "good", None) == {0: 0.0, 1: 0.0}
    with pytest.raises(ValueError):
        scores(boolean, "good", RankingMethod.BM25)
    frequency = Index.build(docs, RAW, PostingType.FREQUENCY)
    near(scores(frequency, "good old games games", RankingMethod.BM25), {1: 2.0194545455, 0: 0.81})
    with pytest.raises(ValueError):
        scores(frequency, "good", RankingMethod.BM25_OPTIMIZED)
    with pytest.raises(ValueError):
        scores(smoke, "good", "no such ranker")
    with pytest.raises(ValueError):
        ix.postings_of(docs, "no such layout")


def test_registries(smoke):
    scoring.register_ranker("tf", lambda index, queries: scoring.asked_of(queries, index.analyzer).lookup(index.postings).select(F.lit(0).alias("query_id"), "doc_id", F.col("tf").cast("double").alias("score")))
    assert scores(smoke, "games", "tf") == {0: 1.0, 1: 2.0}
    ix.register_posting_type("length", lambda tokens: tokens.select(F.lit("x").alias("term"), "doc_id"))
    assert ix.postings_of(smoke.docs.withColumn("tokens", F.array()), "length").count() == 3


def test_index_of_a_layout_of_ones_own(spark, tmp_path):
    ix.register_posting_type("first", lambda tokens: ix.positions(tokens).groupBy("term", "doc_id").agg(F.min("pos").alias("first")))
    path = str(tmp_path / "own")
    Index.build(spark.createDataFrame(SMOKE, "doc_id long, text string"), RAW, "first", path=path)
    again = Index.open(spark, path)
    assert again.kind == "first" and {(r.term, r.doc_id): r["first"] for r in again.postings.where("term = 'games'").collect()} == {("games", 0): 1, ("games", 1): 2}
    assert {r.term: r.df for r in again.terms.collect()}["good"] == 2 and again.n_docs == 3


def test_index_is_kept(spark, tmp_path, smoke):
    path = str(tmp_path / "index")
    docs = spark.createDataFrame(SMOKE, "doc_id long, text string")
    Index.build(docs, Analyzer(2), meta={"ranker": "bm25", "k": 1.2}, path=path)
    again = Index.open(spark, path)
    assert again.analyzer == Analyzer(2) and again.meta["k"] == 1.2 and again.n_docs == 3
    near(scores(again, "good old games games", RankingMethod.BM25, k=1.2, b=0.75), {1: 2.060875, 0: 0.81})
    with pytest.raises(ValueError):
        Index.build(docs, meta={"language": "x"})


def test_empty_and_odd_documents(spark):
    docs = spark.createDataFrame([(0, None), (1, ""), (2, "word " * 30_000), (3, "word")], "doc_id long, text string")
    index = Index.build(docs)
    assert index.n_docs == 4 and index.terms.collect()[0].df == 2
    assert scores(index, "", RankingMethod.BM25) == {} and scores(index, "zzzz", RankingMethod.TF_IDF) == {}
    nothing = Index.build(docs.limit(0))
    assert nothing.n_docs == 0 and scores(nothing, "word", RankingMethod.BM25) == {}


def test_results_do_not_depend_on_partitions(spark, smoke):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        other = Index.build(spark.createDataFrame(SMOKE, "doc_id long, text string").repartition(3))
        near(scores(other, "good old games games", RankingMethod.TF_IDF), {1: 0.8895119390, 0: 0.4018232740})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_invariants(spark, sf_dir):
    index = Index.build(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert index.postings.agg(F.sum("tf")).first()[0] == index.docs.agg(F.sum("dl")).first()[0]
    assert index.terms.agg(F.max("df")).first()[0] <= index.n_docs
    weights = scoring.document_weights(index, "lnc").groupBy("doc_id").agg(F.sum(F.col("w") ** 2).alias("n"))
    assert weights.where(F.abs(F.col("n") - 1) > 0.05).count() == 0


def test_lookup_is_pushed_down(spark, sf_dir):
    index = Index.build(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    plan = scoring.Asked(scoring.query_table(spark, [(0, "anea erou")]), RAW).lookup(index.postings)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term" in plan


def test_evaluation(spark):
    results = spark.createDataFrame([(0, 1, 10, 2.0), (0, 2, 11, 1.0)], "query_id long, rank long, doc_id long, score double")
    qrels = spark.createDataFrame([(0, 0, 10, 3), (0, 1, 12, 1), (1, 0, 10, 1)], "query_id long, ord long, doc_id long, grade int")
    found = {r.query_id: r for r in evaluation.precision_recall(results, qrels).collect()}
    assert (found[0].precision, found[0].recall, found[0].f_score) == (0.5, 0.5, 0.5)
    assert (found[1].precision, found[1].recall, found[1].f_score) == (0.0, 0.0, 0.0)
    reference = {r.query_id: r.ndcg for r in evaluation.ndcg_reference(results, qrels).collect()}
    assert reference[0] == pytest.approx((3 + 1 / math.log2(3)) / (7 + 1 / math.log2(3))) and reference[1] == 0.0
    usual = {r.query_id: r.ndcg for r in evaluation.ndcg(results, qrels).collect()}
    assert usual[0] == pytest.approx(7 / (7 + 1 / math.log2(3)))
    times = spark.createDataFrame([(0, 0.2, 2), (1, 0.4, 0)], "query_id long, seconds double, n_results long")
    total = evaluation.summary(evaluation.precision_recall(results, qrels), times).first()
    assert total.mean_precision == 0.25 and total.median_seconds == pytest.approx(0.3) and total.results_per_second == pytest.approx(2 / 0.6)


def test_meta_is_json(spark, tmp_path, smoke):
    path = str(tmp_path / "meta")
    Index.build(spark.createDataFrame(SMOKE, "doc_id long, text string"), path=path)
    assert json.loads(spark.read.text(f"{path}/meta").first()[0])["posting_class"] == "positional"


def test_long_position_lists_meet_by_bins(spark, monkeypatch, albums):
    """The same pairs and sums whichever way lists are compared."""
    queries = scoring.query_table(spark, [(0, "greatest rock album rock"), (1, "album greatest")])
    values = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    inside = values(scoring.position_pairs(albums, queries)), values(scoring.proximity(albums, queries))
    monkeypatch.setattr(scoring, "COMPARED", 0)
    assert (values(scoring.position_pairs(albums, queries)), values(scoring.proximity(albums, queries))) == inside


def test_proximity_is_near_linear_in_a_long_document(spark):
    """50,000 occurrences of two terms, 2.5 billion pairs of positions: what is made is at most one row for each place in reach."""
    index = Index.build(spark.createDataFrame([(0, "rock album " * 50_000), (1, "rock")], "doc_id long, text string"))
    queries = scoring.query_table(spark, [(0, "rock album")])
    assert scoring.position_pairs(index, queries).count() == sum(sum(0 <= p + d < 100_000 for d in range(-9, 10, 2)) for p in range(0, 100_000, 2))

    def fit(apart):
        dist = apart - 2 if apart < 0 else 2 - apart
        return math.log10(15) - math.log10(dist + 1) if dist >= 0 else 0.8 * (math.log10(1 - dist) + math.log10(15))

    brute = sum(max(0.0, *(fit(d) for d in range(-9, 10, 2) if 0 <= p + d < 100_000)) for p in range(0, 100_000, 2))
    assert scoring.proximity(index, queries).first().s == pytest.approx(brute, rel=1e-9)


def test_postings_exchange_no_token(spark):
    """What a document holds is gathered from its own text: grouping tokens by (term, document) sorted and spilled them all."""
    tokens = analyze(spark.createDataFrame(SMOKE, "doc_id long, text string"), RAW)
    for make in (ix.boolean_postings, ix.frequency_postings, ix.positional_postings):
        plan = make(tokens)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Aggregate" not in plan


@pytest.mark.parametrize("kind", [PostingType.BOOLEAN, PostingType.FREQUENCY, PostingType.POSITIONAL])
def test_rows_of_one_name_meet_beside_others(spark, kind):
    rows = [(1, "b a b"), (2, "a"), (1, "b c"), (None, "a a"), (None, "b"), (3, None), (4, "c " * 30_000 + "a")]
    index = Index.build(spark.createDataFrame(rows, "doc_id long, text string"), kind=kind)
    spots = {}
    for doc, text in rows:
        for pos, term in enumerate((text or "").split()):
            spots.setdefault((term, doc), []).append(pos)
    lengths = {d: sum(len(p) for (_, e), p in spots.items() if e == d) for d, _ in rows}
    found = index.postings.collect()
    assert len(found) == len(spots) and all(r.dl == lengths[r.doc_id] for r in found)
    for r in found:
        if kind is not PostingType.BOOLEAN:
            tfs = [len(p) for (_, e), p in spots.items() if e == r.doc_id]
            assert r.tf == len(spots[r.term, r.doc_id]) and r.sq_n == sum(t * t for t in tfs) and r.sq_b == len(tfs)
            assert r.sq_l == pytest.approx(sum((1 + math.log(t)) ** 2 for t in tfs))
        if kind is PostingType.POSITIONAL:
            assert r.positions == sorted(spots[r.term, r.doc_id])
    assert sorted((str(r.doc_id), r.dl) for r in index.docs.collect()) == sorted((str(d), len((t or "").split())) for d, t in rows)


def test_a_table_that_grows_gets_more_files(spark, monkeypatch):
    monkeypatch.setattr(ix, "FILE_ROWS", 100)
    df = spark.range(1500).selectExpr("concat('t', id % 7) AS term", "id AS doc_id")
    assert ix.sorted_by_term(df, 1500).rdd.getNumPartitions() > 10 and ix.files_for(spark, 3) == 4


def test_judgments_of_one_query_are_numbered_in_several_tasks(spark):
    judged = [(q, i) for q, n in ((1, 200), (2, 3), (3, 1)) for i in range(n)]
    rows = spark.createDataFrame([(q, i * 7, i % 3) for q, i in reversed(judged)], "query_id long, doc_id long, grade int")
    found = evaluation.in_order(rows)
    assert sorted((r.query_id, r.ord) for r in found.collect()) == judged
    assert found.where("doc_id <> ord * 7 or grade <> ord % 3").isEmpty()
    plan = evaluation.ndcg_reference(spark.createDataFrame([(1, 1, 0.5)], "query_id long, rank long, score double"), found)
    assert plan.count() == 3
    # no task has all judgments of a query
    parked = spark.read.parquet(*found.inputFiles())
    assert parked.where("query_id = 1").groupBy(F.input_file_name()).count().count() > 1

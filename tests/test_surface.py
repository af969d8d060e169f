"""Ranker hooks, forward fill, numbering and the SQL functions."""

import random

import pytest
from pyspark.sql import functions as F

from textlode.functions.analysis import RAW, STANDARD, Analyzer, analyze
from textlode.functions.sql import register_analysis, register_search
from textlode.operators import fill, scoring
from textlode.operators import index as ix
from textlode.operators.index import Hooks, Index, PostingType
from textlode.plans import queries
from textlode.sources.reviews import number_documents

DOCS = [(0, "good games"), (1, "good old games games"), (2, None)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hooks_are_kept_and_restored(spark, tmp_path):
    docs, path = spark.createDataFrame(DOCS, "doc_id long, text string"), str(tmp_path / "hooked")
    Index.build(docs, RAW, PostingType.POSITIONAL, path=path, rankers=("augmented",))
    again = Index.open(spark, path)
    assert again.rankers == ("augmented",) and again.meta["augmented_floor"] == 0.5
    assert {(r.term, r.doc_id): r.max_tf for r in again.postings.collect()} == {("good", 0): 1, ("games", 0): 1, ("good", 1): 2, ("old", 1): 2, ("games", 1): 2}
    assert {r.term: (r.df, r.cf) for r in again.terms.collect()} == {"good": (2, 2), "games": (2, 3), "old": (1, 1)}
    assert scoring.rank(again, scoring.query_table(spark, [(0, "games")]), "augmented").count() == 2
    with pytest.raises(ValueError):
        scoring.rank(Index.build(docs), scoring.query_table(spark, [(0, "games")]), "augmented").count()


def test_odd_hooks(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    with pytest.raises(ValueError):
        ix.register_hooks("bad", Hooks({"tf": lambda w: F.lit(1)}))
    with pytest.raises(ValueError):
        Index.build(docs, rankers=("nobody",))
    with pytest.raises(ValueError):
        Index.build(docs, kind=PostingType.BOOLEAN, rankers=("augmented",))
    ix.register_hooks("other", Hooks({"max_tf": lambda w: F.lit(0)}))
    with pytest.raises(ValueError):
        Index.build(docs, rankers=("augmented", "other"))


@pytest.mark.parametrize("block", [1, 2, 256])
@pytest.mark.parametrize("by", [(), ("g",)])
def test_forward_fill_equals_a_plain_loop(spark, monkeypatch, block, by):
    monkeypatch.setattr(fill, "BLOCK", block)
    rng = random.Random(block)
    # one group holds most rows, most values are null, some rows come twice
    rows = [(rng.choice([None, "hot", "hot", "hot", "hot", "cold"]), i, rng.choice([None] * 30 + ["x", "y"]), rng.choice([None] * 3 + [1, 2]), f"t{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i long, `a b` string, n int, text string").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        found = sorted(map(tuple, fill.forward_fill(df, ["i"], ["a b", "n"], by).collect()), key=lambda r: r[1])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    last, want = {}, []
    for g, i, a, n, t in rows:
        key = g if by else 0
        old = last.get(key, (None, None))
        last[key] = (old[0] if a is None else a, old[1] if n is None else n)
        want.append((g, i, *last[key], t))
    assert found == want


def test_forward_fill_of_odd_tables(spark):
    df = spark.createDataFrame([(1, None), (1, "a"), (1, "a"), (None, None)], "i long, v string")
    assert fill.forward_fill(df.limit(0), ["i"], ["v"]).count() == 0
    found = sorted(map(tuple, fill.forward_fill(df, ["i"], ["v"]).collect()), key=repr)
    assert len(found) == 4 and (None, None) in found and found.count((1, "a")) >= 2
    for order, columns in ((["i"], ["i"]), ([], ["v"]), (["i"], [])):
        with pytest.raises(ValueError):
            fill.forward_fill(df, order, columns)
    with pytest.raises(ValueError):
        fill.forward_fill(df.withColumn("_ff_at", F.lit(1)), ["i"], ["v"])


def test_no_window_over_a_single_partition(spark, sf_dir):
    text = plan(queries.block_of_lines(spark, sf_dir))
    assert "Window" in text and "SinglePartition" not in text.split("BroadcastExchange")[0]


def test_numbers_are_dense(spark):
    df = spark.createDataFrame([(f"r{i % 90}", str(i)) for i in range(100)], "ext_id string, text string").repartition(5)
    found = number_documents(df).collect()
    assert sorted(r.doc_id for r in found) == list(range(100)) and {(r.ext_id, r.text) for r in found} == {(f"r{i % 90}", str(i)) for i in range(100)}


@pytest.mark.parametrize("analyzer", [RAW, STANDARD, Analyzer(2, ("it's", "a\\b"))])
def test_sql_tokens_equal_the_analyzer(spark, analyzer):
    texts = [None, "", "It's a \\ 'quoted' \"line\"\twith [signs] ^_`{|}~\nand gaps here", "the The THE games' end.", "x" * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.createOrReplaceTempView("some_texts")
    register_analysis(spark, analyzer)
    want = {r.doc_id: r.tokens for r in analyze(df, analyzer).collect()}
    assert {r.doc_id: r.found for r in spark.sql("SELECT doc_id, tokenize(text) AS found FROM some_texts").collect()} == want
    rows = spark.sql("SELECT doc_id, t.* FROM (SELECT doc_id, tokenize(text) AS words FROM some_texts), LATERAL posexplode(words) AS t(pos, term)").collect()
    assert sorted((r.doc_id, r.pos, r.term) for r in rows) == sorted((i, pos, t) for i, found in want.items() for pos, t in enumerate(found))
    with pytest.raises(ValueError):
        register_analysis(spark, Analyzer(language="english"))


def test_search_by_name(spark):
    index = Index.build(spark.createDataFrame(DOCS, "doc_id long, text string"), RAW, PostingType.FREQUENCY)
    register_search(spark, index)
    for query in ("good old games games", "zzzz", ""):
        want = {r.doc_id: round(r.score, 9) for r in scoring.bm25(index, scoring.query_table(spark, [(0, query)])).collect()}
        assert {r.doc_id: round(r.score, 9) for r in spark.sql(f"SELECT * FROM search_bm25('{query}')").collect()} == want
    assert spark.sql("SELECT * FROM search_bm25(NULL)").count() == 0
    with pytest.raises(ValueError):
        register_search(spark, Index.build(spark.createDataFrame(DOCS, "doc_id long, text string"), RAW, PostingType.BOOLEAN))


def test_tokens_in_sql_are_made_where_the_text_is(spark, sf_dir):
    text = plan(queries.sql_tokenize(spark, sf_dir))
    assert "Join" not in text and "Aggregate" not in text and text.count("regexp_replace(regexp_replace") == 1


@pytest.mark.parametrize("query", [queries.sql_tokenize, queries.sql_bm25, queries.ranker_hooks, queries.block_of_lines])
def test_no_python_in_the_plan(spark, sf_dir, query):
    text = plan(query(spark, sf_dir))
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text

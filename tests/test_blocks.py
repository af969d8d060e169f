import random

import pytest
from pyspark.sql import functions as F

from textlode.functions.analysis import RAW, STANDARD, analyze
from textlode.operators import blocks, scoring
from textlode.operators.index import Index, PostingType


@pytest.fixture(scope="module")
def index(spark, sf_dir):
    return Index.build(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), STANDARD, PostingType.FREQUENCY)


@pytest.fixture(scope="module")
def found(spark, sf_dir):
    return blocks.BlockIndex.build(spark.read.parquet(f"{sf_dir}/documents.parquet"), STANDARD, span=8)


def rows(df):
    return sorted(map(tuple, df.collect()))


def some_queries(spark, index, n=40, seed=1):
    rng, terms = random.Random(seed), [r.term for r in index.terms.orderBy(F.desc("df"), "term").limit(400).collect()]
    return scoring.query_table(spark, [(i, " ".join(rng.choices(terms[: rng.choice([5, 50, 400])], k=rng.randrange(1, 6)))) for i in range(n)] + [(n, "zzzz"), (n + 1, "")])


def test_blocks_hold_the_postings(index, found):
    assert found.blocks.agg(F.max("n")).first()[0] <= 8
    assert rows(found.postings()) == rows(index.postings.select("term", "doc_id", "tf", "dl"))
    assert rows(found.documents()) == rows(index.docs) and rows(found.terms) == rows(index.terms) and found.stats == index.stats
    assert found.blocks.groupBy("span").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0


def test_impacts_bound_every_posting(index, found):
    for k, b in ((0.75, 0.5), (1.2, 0.75), (0.0, 0.0), (2.0, 1.0)):
        avgdl = index.stats["avgdl"]
        best = blocks.read_blocks(found.blocks.withColumn("bound", blocks.best_part(avgdl, k, b)), "term", "span", "bound").withColumn("part", blocks.part_of(F.col("tf"), F.col("dl"), avgdl, k, b))
        tops = best.groupBy("term", "span").agg(F.max("part").alias("part"), F.first("bound").alias("bound"))
        assert tops.where("part <> bound").count() == 0


@pytest.mark.parametrize(("k", "b"), [(0.75, 0.5), (1.2, 0.75)])
def test_pruned_and_table_search_are_exact(spark, index, found, k, b):
    queries = some_queries(spark, index)
    exact = rows(scoring.top_k(scoring.bm25(index, queries, k, b), 10))
    assert rows(blocks.search_table(found, queries, 10, k, b)) == exact
    pruned, counts = blocks.top_k_pruned(found, queries, 10, k, b)
    assert rows(pruned) == exact
    assert counts.where("n_read > n_postings").count() == 0


def test_a_frequent_term_is_read_in_part(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choices(["common", "other", "third"], [1, 5, 5], k=rng.randrange(2, 60)))) for i in range(3000)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    found = blocks.BlockIndex.build(table, RAW, span=16)
    queries = scoring.query_table(spark, [(1, "common"), (2, "common third")])
    pruned, counts = blocks.top_k_pruned(found, queries)
    assert rows(pruned) == rows(scoring.top_k(scoring.bm25(Index.build(table, RAW, PostingType.FREQUENCY), queries), 10))
    n = {r.query_id: r for r in counts.collect()}
    assert n[1].n_postings > 1500 and n[1].n_read < n[1].n_postings / 2


def test_bounds_need_usual_parameters(spark, found):
    with pytest.raises(ValueError):
        blocks.top_k_pruned(found, scoring.query_table(spark, [(1, "tion")]), b=1.5)


def test_a_table_of_queries_moves_no_postings(spark, index, found):
    """Over 2,000 terms: the scan of blocks meets no exchange, and no Python or driver step is in the plan."""
    queries = index.terms.select(F.monotonically_increasing_id().alias("query_id"), F.col("term").alias("query")).limit(2500)
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with blocks.subset_keys(spark):
            hits = found.blocks.join(found.at_shards(found.weights(queries)), ["shard", "term"])
            plan = blocks.sums(found, hits, 0.75, 0.5)._jdf.queryExecution().sparkPlan().toString() + hits._jdf.queryExecution().executedPlan().toString()
            physical = hits._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    scan = physical[: physical.index("Bucketed: true")]
    assert "SortMergeJoin" in scan and "Exchange" not in scan and "Python" not in plan
    assert rows(blocks.search_table(found, queries)) == rows(scoring.top_k(scoring.bm25(index, queries), 10))


def test_odd_queries_and_empty_tables(spark, index, found):
    queries = spark.createDataFrame([(1, None), (None, "tion"), (2, "tion"), (2, "ing")], "query_id long, query string")
    both = scoring.query_table(spark, [(2, "tion ing")])
    expected = rows(scoring.top_k(scoring.bm25(index, both), 10))
    assert rows(blocks.search_table(found, queries)) == expected and rows(blocks.top_k_pruned(found, queries)[0]) == expected
    none = blocks.BlockIndex.build(spark.createDataFrame([], "doc_id long, text string, term string"))
    assert none.n_docs == 0 and none.documents().collect() == []
    odd = blocks.BlockIndex.build(spark.createDataFrame([(None, "a"), (1, None), (2, "b " * 70_000), (3, "b")], "doc_id int, text string"))
    assert odd.n_docs == 3 and rows(odd.postings()) == [("b", 2, 70_000, 70_000), ("b", 3, 1, 1)]
    assert blocks.search_table(none, queries).collect() == [] and blocks.top_k_pruned(none, queries)[0].collect() == []


def test_blocks_are_opened_again(spark, sf_dir, index, tmp_path):
    path = f"file://{tmp_path}/blocks"
    blocks.BlockIndex.build(spark.read.parquet(f"{sf_dir}/documents.parquet"), STANDARD, path, shards=3)
    again = blocks.BlockIndex.open(spark, path, STANDARD, 3)
    assert again.stats == index.stats and rows(again.postings()) == rows(index.postings.select("term", "doc_id", "tf", "dl"))


def test_building_moves_the_tokens_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = blocks.blocks_of(blocks.analyze(docs, STANDARD), 8, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_tokens_are_counted_before_they_move(spark, sf_dir):
    """One aggregation, of postings: counting tokens by (term, document) in a shard's task grew with all tokens of the shard."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    plan = blocks.blocks_of(analyze(docs, STANDARD), 8, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1


def test_shards_grow_with_the_table(spark, sf_dir, index, found, monkeypatch):
    monkeypatch.setattr(blocks, "SHARD_DOCS", 20)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = blocks.BlockIndex.build(docs, STANDARD)
    assert more.shards == -(-docs.count() // 20) > found.shards
    assert sorted(more.postings().collect()) == sorted(found.postings().collect())

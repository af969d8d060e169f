"""Versions of an index, and an index that grows: what a reader sees while writers write, stop and come again."""

import pytest
from pyspark.sql import functions as F

from textlode.functions.analysis import STANDARD
from textlode.operators import index as ix, scoring
from textlode.operators.index import Index, PostingType
from textlode.session import SCOPE, park, scratch
from textlode.sources.snapshots import CommitConflict, Snapshots
from textlode.streaming import growing
from textlode.streaming.growing import GrowingIndex

QUERY = "anea thanedble erou only"


def rows(df):
    return sorted(map(tuple, df.collect()))


def scores(index, method=scoring.RankingMethod.BM25):
    return rows(scoring.rounded(scoring.rank(index, scoring.query_table(index.spark, [(0, QUERY)]), method)).select("doc_id", "score"))


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return park(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.ntile(7).over(ix.Window.orderBy("doc_id")).alias("part")), "docs")


@pytest.fixture(scope="module")
def whole(docs):
    return Index.build(docs, STANDARD)


# versions


def test_commits_follow_one_another(spark, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}/s")
    assert store.load() == (0, {}) and store.versions() == []
    assert store.commit({"tables": ["a-1"], "x": "é"}, 0) == 1
    with pytest.raises(CommitConflict):
        store.commit({"tables": []}, 0)
    assert store.commit({"tables": ["a-1", "b-1"]}, 1) == 2
    assert store.load(1)[1]["x"] == "é" and store.load()[0] == 2
    assert not [n for n in store.names("versions") if "draft" in n and not n.startswith(".")]


def test_old_versions_and_strays_are_removed(spark, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}/s")
    for i, tables in enumerate((["a"], ["a", "b"], ["b", "c"])):
        for t in tables:
            spark.range(1).write.mode("overwrite").parquet(store.table(t))
        store.commit({"tables": tables}, i)
    spark.range(1).write.parquet(store.table("stray"))
    assert store.expire(keep=1) == ["a", "stray"] and store.versions() == [3] and store.names("data") == ["b", "c"]


def test_a_reader_keeps_its_version(spark, tmp_path, docs):
    path = f"file://{tmp_path}/i"
    first = Index.build(docs.where("part <= 3"), STANDARD, path=path)
    opened = Index.open(spark, path)
    before = scores(opened)
    second = Index.build(docs, STANDARD, path=path)
    assert (first.version, second.version) == (1, 2) and scores(opened) == before != scores(second)
    assert scores(Index.open(spark, path)) == scores(second) and scores(Index.open(spark, path, 1)) == before


@pytest.mark.parametrize("where", ["document_frequencies", "corpus_statistics"])
def test_a_build_that_stops_leaves_the_old_index(spark, tmp_path, docs, monkeypatch, where):
    path = f"file://{tmp_path}/i"
    before = scores(Index.build(docs.where("part <= 3"), STANDARD, path=path))

    def stop(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(ix, where, stop)
        with pytest.raises(RuntimeError):
            Index.build(docs, STANDARD, path=path)
    again = Index.open(spark, path)
    assert again.version == 1 and scores(again) == before
    kept = set(Snapshots(spark, path).load()[1]["tables"])
    assert Snapshots(spark, path).expire() and set(Snapshots(spark, path).names("data")) == kept
    assert scores(again) == before


def test_further_tables_and_what_is_missing(spark, tmp_path, docs):
    path = f"file://{tmp_path}/i"
    Index.build(docs, STANDARD, path=path, extra={"mapping": docs.select("doc_id", F.lit("x").alias("ext_id"))})
    assert Index.open(spark, path).extra["mapping"].count() == docs.count()
    with pytest.raises(ValueError):
        Index.open(spark, f"file://{tmp_path}/none")


def test_scratch_tables_go(spark):
    with scratch(spark):
        gone, kept = park(spark.range(3), "a"), park(spark.range(3), "b", keep=True)
        paths = SCOPE.get()
        assert gone.count() == 3 and len(paths) == 1
    assert kept.count() == 3 and not Snapshots(spark, paths[0]).fs.exists(Snapshots(spark, paths[0]).at())
    with pytest.raises(ValueError), scratch(spark):
        park(spark.range(1), "a")
        raise ValueError
    assert SCOPE.get() is None


# growth


@pytest.mark.parametrize("kind", [PostingType.FREQUENCY, PostingType.POSITIONAL])
def test_batches_make_the_index_of_the_whole(spark, tmp_path, docs, whole, kind):
    grow = GrowingIndex(spark, f"file://{tmp_path}/g", STANDARD, kind)
    for part in range(1, 8):
        grow.add(docs.where(F.col("part") == part))
    assert [len(level) for level in grow.levels()] == [1, 2]
    found = grow.snapshot()
    assert found.stats == whole.stats and rows(found.terms) == rows(whole.terms) and rows(found.docs) == rows(whole.docs)
    methods = [scoring.RankingMethod.BM25, scoring.RankingMethod.TF_IDF]
    if kind is PostingType.POSITIONAL:
        methods += [scoring.RankingMethod.BM25_OPTIMIZED, scoring.RankingMethod.TF_IDF_OPTIMIZED]
    for method in methods:
        assert scores(found, method) == scores(whole, method)


def test_a_stream_that_starts_again(spark, tmp_path, docs, whole):
    """Three runs with one checkpoint; then the last batches once more, as after a crash before their checkpoint was written."""
    path, inbox = f"file://{tmp_path}/g", str(tmp_path / "in")
    for lo, hi in ((1, 2), (3, 5), (6, 7)):
        docs.where(F.col("part").between(lo, hi)).drop("part").coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema("doc_id long, text string").parquet(inbox)
        GrowingIndex(spark, path, STANDARD).stream(stream, str(tmp_path / "cp")).awaitTermination(240)
    grow = GrowingIndex(spark, path)
    assert grow.analyzer == STANDARD and [len(level) for level in grow.levels()] == [0, 1]
    before, version = scores(grow.snapshot()), grow.version
    assert before == scores(whole)
    assert not grow.add(docs, "documents", 2) and not grow.add(docs, "documents", 0)
    assert grow.version == version and scores(grow.snapshot()) == before
    # another stream, whose documents are there already
    assert grow.add(docs, "other", 0) and scores(grow.snapshot()) == before


def test_a_batch_that_stops_adds_nothing(spark, tmp_path, docs, monkeypatch):
    grow = GrowingIndex(spark, f"file://{tmp_path}/g", STANDARD)
    for part in (1, 2):
        grow.add(docs.where(F.col("part") == part), "s", part)
    pinned, before = grow.snapshot(), scores(grow.snapshot())

    def stop(*_):
        raise RuntimeError("stopped while compacting")

    with monkeypatch.context() as m:
        m.setattr(GrowingIndex, "merged", stop)
        with pytest.raises(RuntimeError):
            grow.add(docs.where("part = 3"), "s", 3)
    again = GrowingIndex(spark, grow.store.path)
    assert scores(again.snapshot()) == before
    assert again.add(docs.where("part = 3"), "s", 3) and [len(x) for x in again.levels()] == [0, 1]
    assert again.snapshot().n_docs == docs.where("part <= 3").count()
    assert scores(pinned) == before
    again.expire()
    assert set(again.store.names("data")) == set(again.state["tables"]) and scores(again.snapshot()) != before


def test_two_writers(spark, tmp_path, docs):
    a, b = (GrowingIndex(spark, f"file://{tmp_path}/g", STANDARD) for _ in range(2))
    a.add(docs.where("part = 1"))
    with pytest.raises(CommitConflict):
        b.add(docs.where("part = 2"))
    b.refresh()
    assert b.add(docs.where("part = 2")) and b.snapshot().n_docs == docs.where("part <= 2").count()


def test_odd_batches(spark, tmp_path):
    grow = GrowingIndex(spark, f"file://{tmp_path}/g")
    with pytest.raises(ValueError):
        grow.snapshot()
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert grow.add(empty, "s", 0) and grow.levels() == []
    grow.add(spark.createDataFrame([(1, None, "x"), (2, "a a b", "y"), (3, "", "z")], "doc_id long, text string, term string"))
    assert grow.snapshot().n_docs == 3 and rows(grow.snapshot().terms) == [("a", 1), ("b", 1)]
    assert growing.compacted([[], []], None) == [[], []]


def test_texts_of_new_documents_are_not_joined(spark, docs):
    texts, seen = docs.select("doc_id", "text"), docs.where("part <= 3")
    fresh = park(texts.join(seen.select("doc_id"), "doc_id", "left_anti"), "fresh")
    assert growing.unknown(fresh, seen) is fresh
    assert rows(growing.unknown(texts, seen)) == rows(fresh)

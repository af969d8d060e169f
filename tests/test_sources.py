import gzip
import time

import pytest
from pyspark.sql import functions as F

from textlode import cli
from textlode.functions.analysis import Analyzer, analyze
from textlode.operators import index as ix
from textlode.plans.queries import example
from textlode.sources import posting_text
from textlode.sources.qrels import read_qrels
from textlode.sources.reviews import number_documents, read_reviews
from textlode.sources.stop_words import read_stop_words
from textlode.streaming.segments import append_segments, read_segments


def test_reviews(spark):
    found = {r.ext_id: r.text for r in read_reviews(spark, example("reviews.tsv.gz")).collect()}
    assert found == {"R1": 'Great album He said "play it" again', "R2": "tab\there plain body", "R3": "no headline", "R4": "breaks line one\nline two", "R5": 'mid "quote" word last'}


def test_reviews_of_several_files(spark, tmp_path):
    for name, text in (("a", "review_body\treview_id\treview_headline\nbody\tA\thead\n"), ("b", "review_id\treview_headline\treview_body\nB\th\tb\n")):
        with gzip.open(tmp_path / f"{name}.tsv.gz", "wt") as f:
            f.write(text)
    docs = number_documents(read_reviews(spark, [str(tmp_path / "a.tsv.gz"), str(tmp_path / "b.tsv.gz")]))
    assert sorted(r.doc_id for r in docs.collect()) == [0, 1]
    assert {r.ext_id: r.text for r in docs.collect()} == {"A": "body head", "B": "h b"}
    with pytest.raises(ValueError):
        read_reviews(spark, str(tmp_path / "a.tsv.gz"), "no_such_column")
    with pytest.raises(ValueError):
        read_reviews(spark, [])


def test_qrels(spark):
    found = [(r.query, r.ord, r.ext_id, r.grade) for r in read_qrels(spark, example("judgments.txt")).orderBy("query", "ord").collect()]
    assert found == [("greatest album", 0, "R1", 3), ("greatest album", 1, "R2", 2), ("quiet song", 0, "R3", 1), ("quiet song", 1, "R1", 1)]


def test_posting_lines_round_trip(spark):
    tokens = analyze(spark.createDataFrame([(3, "b a b"), (1, "a")], "doc_id long, text string"), Analyzer())
    for layout, kind in (("boolean", ix.boolean_postings), ("frequency", ix.frequency_postings), ("positional", ix.positional_postings)):
        postings = kind(tokens)
        lines = posting_text.to_lines(postings, layout)
        again = posting_text.from_lines(lines, layout)
        assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, postings.select(*again.columns).collect()), key=str)
    weighted = ix.frequency_postings(tokens).withColumn("w", F.lit(0.5))
    assert {r.line for r in posting_text.to_lines(weighted, "frequency", True).collect()} == {"a 1:1/0.5 3:1/0.5", "b 3:2/0.5"}
    one = spark.createDataFrame([("a 1:2/0.25#1.5",)], "line string")
    assert posting_text.from_lines(one, "frequency", True).first().w == 0.25


def test_command_line(spark, tmp_path, capsys):
    args = cli.parser().parse_args(["index", "--documents", example("reviews.tsv.gz"), "--out", str(tmp_path / "i"), "--ranker", "bm25", "--posting-list-type", "positional"])
    cli.build(spark, args)
    found = cli.run_search(spark, str(tmp_path / "i"), [(0, "play album"), (1, "quote")], 5).collect()
    assert [(r.query_id, r.ext_id) for r in found] == [(0, "R1"), (1, "R5")]


def test_stream_of_segments(spark, tmp_path):
    schema = "doc_id long, text string"
    for i, rows in enumerate(([(0, "a b a")], [(1, "b c")])):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        append_segments(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    postings, terms, docs = read_segments(spark, str(tmp_path / "out"))
    assert {(r.term, r.doc_id): r.tf for r in postings.collect()} == {("a", 0): 2, ("b", 0): 1, ("b", 1): 1, ("c", 1): 1}
    assert {r.term: r.df for r in terms.collect()} == {"a": 1, "b": 2, "c": 1} and docs.count() == 2


def test_stop_word_file(spark, tmp_path):
    (tmp_path / "w.txt").write_text("of\n\nthe\nof\n")
    assert read_stop_words(spark, str(tmp_path / "w.txt")) == ("of", "the")
    args = cli.parser().parse_args(["index", "--documents", example("reviews.tsv.gz"), "--out", str(tmp_path / "i"), "--stop-words", str(tmp_path / "w.txt"), "--max-block-size", "50000", "--max-ram", "95"])
    assert cli.build(spark, args).meta["stop_words"] == ["of", "the"]


def test_limits_are_checked():
    for bad in (["--max-ram", "0"], ["--max-ram", "101"], ["--max-block-size", "0"]):
        with pytest.raises(ValueError):
            cli.session_of(cli.parser().parse_args(["index", "--documents", "a", "--out", "b", *bad]))


def test_a_long_line_is_cut_once(spark):
    """Each entry used to carry and cut its whole line again: 40,000 entries then took minutes."""
    line = "word " + " ".join(f"{d}:{d % 7},{d % 7 + 9}" for d in range(40_000)) + "#1.5"
    lines = spark.createDataFrame([(line,), ("bare",), ("x 1:2 3:4#0.5",), ("y 1:2",)], "line string")
    start = time.monotonic()
    rows = {(r.term, r.doc_id): r.positions for r in posting_text.from_lines(lines, "positional").collect()}
    assert time.monotonic() - start < 30
    assert len(rows) == 40_003 and all(rows["word", d] == [d % 7, d % 7 + 9] for d in range(40_000)) and rows["x", 3] == [4]


def test_terms_are_dealt_over_more_tasks_for_more_text(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"rock album {i}") for i in range(200)], "doc_id long, text string")
    few = posting_text.parts_for(docs)
    monkeypatch.setattr(posting_text, "TASK_TEXT", 64)
    parts = posting_text.parts_for(docs)
    assert few == 4 and parts > 30
    found = posting_text.to_lines(ix.frequency_postings(analyze(docs, Analyzer())), "frequency", parts=parts)
    assert found.rdd.getNumPartitions() == parts and found.count() == 202

import corpus_pipeline as cp
import odd

from textlode.llm import jaccard_join, quality_rules, registry, toxicity
from textlode.llm.common import park


def test_stages_have_their_names_and_order():
    assert [name for name, _ in cp.STAGES] == ["toxicity", "quality_rules", "ngram_jaccard", "best_fit_packing"]
    assert cp.ORACLE_SQL is None and len(registry.QUERIES) == 13


def test_each_stage_against_its_operator(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    model = toxicity.train_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    one = park(cp.drop_toxic(spark, docs, sf_dir), "t1")
    assert one.columns == docs.columns and ids(one) == ids(toxicity.score_table(docs, model).where("score < 0.5"))
    assert set(ids(docs)) > set(ids(one))

    two = park(cp.drop_poor(spark, one, sf_dir), "t2")
    assert two.columns == docs.columns and ids(two) == ids(quality_rules.judge(one, ["doc_id"]).where("kept"))

    three = park(cp.drop_copies(spark, two, sf_dir), "t3")
    classes = jaccard_join.near_duplicates(two).groupBy("class_row").count().count()
    assert three.columns == docs.columns and three.count() == classes == three.distinct().count()
    assert jaccard_join.near_duplicates(three).groupBy("class_row").count().where("count > 1").count() == 0

    pieces = cp.pack(spark, three, sf_dir)
    assert ids(pieces.where("piece = 0")) == ids(three)
    assert sorted(map(tuple, cp.run(spark, sf_dir).select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(tuple, pieces.select("doc_id", "piece", "length", "ids_crc32").collect()))


def test_stages_by_exchange_give_the_same(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = [sorted(r.doc_id for r in f(spark, docs, sf_dir).collect()) for f in (cp.drop_poor, cp.drop_copies)]
    monkeypatch.setattr(cp, "BROADCAST_REJECTS", -1)
    assert before == [sorted(r.doc_id for r in f(spark, docs, sf_dir).collect()) for f in (cp.drop_poor, cp.drop_copies)]


def test_copies_kept_do_not_depend_on_files(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = [sorted(r.doc_id for r in cp.drop_copies(spark, x, sf_dir).collect()) for x in (docs, docs.repartition(7, "text"))]
    assert kept[0] == kept[1]


def test_stages_on_odd_tables(spark, sf_dir, tmp_path):
    odd.table(spark).write.parquet(str(tmp_path / "odd"))
    docs = spark.read.parquet(str(tmp_path / "odd"))
    for _, stage in cp.STAGES[:3]:
        docs = park(stage(spark, docs, sf_dir), "odd")
        assert docs.columns == odd.table(spark).columns
    assert [r.text for r in docs.collect()] == [odd.TEXTS[4]] or docs.count() >= 1
    assert docs.where(f"text = '{odd.TEXTS[4]}'").count() == 1
    assert cp.pack(spark, docs, sf_dir).count() >= docs.count()
    nothing = docs.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, nothing, sf_dir).count() == 0

import datetime as dt
import zlib
from collections import Counter

import odd
import pytest
from pyspark.sql import functions as F

from textlode.llm import sharding, url_filters


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 100, 1000, 4097])
def test_permutation(spark, n):
    places = [r.p for r in spark.range(n).select(sharding.shuffled_place(F.col("id"), n, 17).alias("p")).collect()]
    assert sorted(places) == list(range(n))
    if n > 50:
        assert sum(abs(p - i) < n // 10 for i, p in enumerate(places)) < n // 2


def test_permutation_is_the_plain_rule(spark):
    def mix(x, key):
        add, mul, mul2 = key
        return (((x % sharding.PRIME + add) * mul) % sharding.PRIME * mul2) % sharding.MODULUS % sharding.SMALL

    def once(x, n):
        a, b = sharding.sides(n)
        left, right = x % a, x // a
        for i, key in enumerate(sharding.round_keys(17)):
            if i % 2:
                right = (right + mix(left, key)) % b
            else:
                left = (left + mix(right, key)) % a
        return right * a + left

    n, expected = 1234, []
    for x in range(n):
        x = once(x, n)
        while x >= n:
            x = once(x, n)
        expected.append(x)
    got = spark.range(n).select("id", sharding.shuffled_place(F.col("id"), n, 17).alias("p")).orderBy("id").collect()
    assert [r.p for r in got] == expected


def test_shards_of_odd_tables(spark):
    df = odd.table(spark)
    got = sharding.shard(df, ["doc_id", "text"], 4).collect()
    assert len(got) == df.count() and set(df.columns) <= set(got[0].asDict())
    for shard, n in Counter(r.shard for r in got).items():
        assert n in (len(got) // 4, len(got) // 4 + 1) and sorted(r.slot for r in got if r.shard == shard) == list(range(n))
    assert sharding.shard(odd.empty(spark), ["doc_id"], 4).count() == 0
    with pytest.raises(ValueError):
        sharding.shard(df, ["doc_id"], 0)


def test_shards_do_not_depend_on_partitions(spark, sf_dir):
    first = {r.doc_id: (r.shard, r.slot) for r in sharding.op8_sharding(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(7)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    assert first == {r.doc_id: (r.shard, r.slot) for r in sharding.shard(rows, ["doc_id", "text_crc32", "size"], 16).collect()}


def test_query_against_plain_code(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = sharding.op8_sharding(spark, sf_dir).collect()
    assert {r.doc_id for r in got} == set(texts)
    for r in got:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)


def test_hosts_and_keys(spark):
    urls = ["http://User@WWW.Example.org:80/a/b?x=1#y", "https://a.b.c", "ftp://x./", "nonsense", "", None, "http://h/a//b/"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = [r.k for r in df.select(url_filters.url_keys(F.col("u")).alias("k")).collect()]
    assert got == [["d:www.example.org", "d:example.org", "p:www.example.org/a", "p:www.example.org/a/b"], ["d:a.b.c", "d:b.c"], ["d:x"], None, None, None, ["d:h", "p:h/a", "p:h/a/b"]]


def test_intervals(spark):
    day = lambda d: dt.date(2024, 1, d)
    log = [("l", "d:x", day(1), "add"), ("l", "d:x", day(1), "add"), ("l", "d:x", day(3), "add"), ("l", "d:x", day(5), "remove"), ("l", "d:x", day(6), "remove"), ("l", "d:x", day(9), "add"), ("l", "d:y", day(2), "add"), ("l", "d:y", day(2), "remove"), ("l", None, day(2), "add"), ("l", "d:z", None, "add"), ("l", "d:z", day(1), "other")]
    events = spark.createDataFrame(log, "list_name string, pattern string, event_date date, action string")
    got = sorted((r.pattern, r.valid_from, r.valid_to) for r in url_filters.validity(events).collect())
    assert got == [("d:x", day(1), day(5)), ("d:x", day(9), dt.date(9999, 12, 31))]
    rows = [(1, "http://x/", day(4)), (2, "http://x/", day(5)), (3, "http://x/", day(9)), (3, "http://x/", day(9)), (4, None, day(4)), (5, "http://x/", None), (None, "http://y/", day(3))]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetch_date date").withColumn("pattern", F.lit("clash")).withColumn("list_name", F.lit(1))
    found = sorted((str(r.page_id), r.blocked, r.n_entries) for r in url_filters.filter_captures(captures, events).collect())
    assert found == [("1", True, 1), ("2", False, 0), ("3", True, 1), ("3", True, 1), ("4", False, 0), ("5", False, 0), ("None", False, 0)]
    assert url_filters.filter_captures(captures.limit(0), events).count() == 0
    assert url_filters.filter_captures(captures, events.limit(0)).where("blocked").count() == 0


def test_url_query_against_sql(spark, sf_dir):
    import duckdb

    got = sorted(map(tuple, url_filters.op9_url_filters(spark, sf_dir).collect()), key=repr)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    assert got == sorted(con.execute(url_filters.OP9_SQL).fetchall(), key=repr)


def test_native_queries_run_no_python(spark, sf_dir):
    for query in (sharding.op8_sharding, url_filters.op9_url_filters):
        plan = query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan

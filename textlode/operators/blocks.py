"""Postings in blocks, dealt by document: tables of queries, top n with pruning, lookup without moving postings.

Documents are dealt over shards. In a shard they stand in the order of their lengths, and SPAN neighbours are a span. A
block holds a term's postings in one span: ids as differences from the first, frequencies, lengths, and what a search
may skip by, the first and last id, the highest frequency, the least length, and the impacts, the pairs of frequency and length that no other pair of the block
beats. From those the best BM25 part in the block is known exactly for any parameters. The block of no term (null) holds
all documents of its span.

blocks    (shard, term, low, span, n, first, last, max_tf, min_dl, impacts, offsets, tfs, dls), in buckets by shard, sorted
          by (term, low); low is the negated part at usual parameters, about the best, so that a term's best blocks come first in
          its files. Most blocks have one posting: their arrays are null, as are impacts that are (max_tf, min_dl) alone

Building moves a document's counted terms once, to its shard; all that follows happens there.

All terms of a document are in one shard. So queries go to the shards, and their rows, not the postings, are copied: a
score is summed where its postings lie, and what leaves a shard is its best k for each query.
"""

from __future__ import annotations

import functools
import operator
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.analysis import RAW, Analyzer, analyze
from ..session import park, shared_dir, ship
from .index import corpus_statistics, gathered, half_even
from .scoring import idf, query_tokens, top_k

#: Documents of a span, and so the postings of a block at most.
SPAN = 64
#: Documents of a shard, about: a table that grows gets more shards, not larger ones. And spans whose blocks are made at once.
SHARD_DOCS, SPANS_AT_ONCE = 20_000, 16
#: Copies of a term's statistics, so that a term that many queries ask for is met in as many tasks.
SALTS = 16
#: Terms up to this many go to the scan with the least impact that is wanted of each.
PUSHED_FLOORS = 64
#: Scores are given to six places: a block that can come this near to the last of the best is read.
SLACK = 2e-6
#: Average length, k and b that blocks are put in order by.
USUAL_LENGTH, USUAL_K, USUAL_B = 300.0, 0.75, 0.5
SCHEMA = "shard INT, term STRING, low DOUBLE, span BIGINT, n INT, first BIGINT, last BIGINT, max_tf INT, min_dl INT, impacts ARRAY<STRUCT<tf: INT, dl: INT>>, offsets ARRAY<BIGINT>, tfs ARRAY<INT>, dls ARRAY<INT>"


def part_of(tf: Column, dl: Column, avgdl: float | None, k: float, b: float) -> Column:
    """What a posting adds to a BM25 score, without idf: more for a higher frequency, not more for a longer document."""
    tf = tf.cast("double")
    return tf * (k + 1) / (tf + k * (1 - b + b * half_even(dl / F.lit(avgdl or 1.0))))


def usual_part() -> Column:
    """About the best part of a block at usual parameters, from its highest frequency and least length: an order, no bound."""
    tf = F.col("max_tf").cast("double")
    return tf / (tf + USUAL_K * (1 - USUAL_B + USUAL_B * F.col("min_dl") / USUAL_LENGTH))


def best_part(avgdl: float | None, k: float, b: float) -> Column:
    several = F.array_max(F.transform("impacts", lambda x: part_of(x["tf"], x["dl"], avgdl, k, b)))
    return F.when(F.col("impacts").isNull(), part_of(F.col("max_tf"), F.col("min_dl"), avgdl, k, b)).otherwise(several)


@contextmanager
def subset_keys(spark: SparkSession) -> Iterator[None]:
    """Let a join on (shard, term) use a layout by shard alone. For what is planned and run inside."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name, "true")
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def declared(spark: SparkSession, path: str, shards: int) -> str:
    """A name for the table of blocks at a path, by which Spark knows its buckets."""
    name = f"textlode_blocks_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({SCHEMA}) USING parquet OPTIONS (compression 'zstd') CLUSTERED BY (shard) SORTED BY (term, low) INTO {shards} BUCKETS LOCATION '{path}'")
    return name


@dataclass
class BlockIndex:
    """Blocks, document frequencies (term, df), and four numbers of the corpus."""

    spark: SparkSession
    analyzer: Analyzer
    blocks: DataFrame
    terms: DataFrame
    stats: dict
    shards: int

    @property
    def n_docs(self) -> int:
        return self.stats["n_docs"]

    @staticmethod
    def build(docs: DataFrame, analyzer: Analyzer = RAW, path: str | None = None, span: int = SPAN, shards: int | None = None, key: str = "doc_id", text: str = "text") -> BlockIndex:
        """Index a table of documents whose key is an integer. shards: as many as the session's shuffle partitions, or one for
        each SHARD_DOCS rows if these are more, where not given.

        A null text is an empty document; rows without a key are left out; rows of one key are documents
        of their own, whose scores add up. Of docs only two columns are read.
        """
        spark = docs.sparkSession
        shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // SHARD_DOCS))
        path = path or f"{shared_dir(spark)}/textlode/blocks-{uuid.uuid4().hex}"
        tokens = analyze(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null"), analyzer)
        name = declared(spark, path, shards)
        blocks_of(tokens, span, shards).select(*spark.table(name).columns).write.insertInto(name)
        return BlockIndex.of(spark, name, analyzer, shards)

    @staticmethod
    def open(spark: SparkSession, path: str, analyzer: Analyzer, shards: int) -> BlockIndex:
        """Blocks at a path, written with this analyzer and so many shards."""
        return BlockIndex.of(spark, declared(spark, path, shards), analyzer, shards)

    @staticmethod
    def of(spark: SparkSession, name: str, analyzer: Analyzer, shards: int) -> BlockIndex:
        blocks = spark.table(name)
        terms = park(blocks.where("term is not null").groupBy("term").agg(F.sum("n").alias("df")), "terms")
        stats = corpus_statistics(read_blocks(blocks.where("term is null")).select("dl")).first().asDict()
        return BlockIndex(spark, analyzer, blocks, terms, stats, shards)

    def postings(self) -> DataFrame:
        """(term, doc_id, tf, dl)."""
        return read_blocks(self.blocks.where("term is not null"), "term")

    def documents(self) -> DataFrame:
        """(doc_id, dl) of every document."""
        return read_blocks(self.blocks.where("term is null")).select("doc_id", "dl")

    def weights(self, queries: DataFrame) -> DataFrame:
        """(query_id, term, idf) of a table of queries (query_id, query): each term that the index has, once."""
        asked = park(query_tokens(queries, self.analyzer).select("query_id", "term").where("query_id is not null").distinct(), "asked")
        known = self.terms.join(asked.select("term").distinct(), "term", "left_semi").select("term", idf(self.n_docs, F.col("df"), "t").alias("idf"))
        known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = asked.withColumn("salt", F.pmod(F.hash("query_id"), F.lit(SALTS)))
        return park(salted.join(known, ["term", "salt"]).select("query_id", "term", "idf"), "weights")

    def at_shards(self, rows: DataFrame) -> DataFrame:
        """A copy of rows for every shard, dealt as the blocks are."""
        return rows.withColumn("shard", F.explode(F.array(*map(F.lit, shard_names(self.spark, self.shards))))).repartition(self.shards, "shard")


def shard_names(spark: SparkSession, shards: int) -> list[int]:
    """So many numbers that Spark's hash deals one to each bucket; 0, 1, 2 ... would share some and leave others empty."""
    rows = spark.range(shards * (20 + shards.bit_length())).select(F.col("id").cast("int").alias("id"))
    found = rows.groupBy(F.pmod(F.hash("id"), F.lit(shards)).alias("bucket")).agg(F.min("id").alias("id")).collect()
    return [r.id for r in sorted(found)]


def shard_of(doc_id: Column, shards: int) -> Column:
    return (F.conv(F.substring(F.md5(doc_id.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % shards).cast("int")


def blocks_of(tokens: DataFrame, span: int, shards: int) -> DataFrame:
    """Rows of SCHEMA of (doc_id, tokens)."""
    ship(tokens.sparkSession)
    names = F.array(*map(F.lit, shard_names(tokens.sparkSession, shards)))
    # a document's tokens are counted in its own row, before it moves
    dealt = gathered(tokens).withColumn("no", shard_of(F.col("doc_id"), shards)).withColumn("shard", F.get(names, "no")).repartition(shards, "shard")
    place = F.row_number().over(Window.partitionBy("shard").orderBy("dl", "doc_id")) - 1
    placed = dealt.withColumn("span", F.floor(place / span).cast("long") * shards + F.col("no"))
    spans = placed.groupBy("shard", "span").agg(F.collect_list(F.struct("doc_id", "dl", "postings")).alias("docs"))
    blocks = spans.mapInArrow(span_blocks, ", ".join(x for x in SCHEMA.split(", ") if not x.startswith("low ")))
    return blocks.withColumn("low", -usual_part())


def span_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows (shard, span, docs), some spans at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, SPANS_AT_ONCE):
            yield made_blocks(batch.slice(at, SPANS_AT_ONCE))


def made_blocks(spans: pa.RecordBatch) -> pa.RecordBatch:
    """The blocks of some spans: their postings sorted by (span, term, doc_id, tf, dl), with a posting of no term for each document."""
    docs = spans.column("docs").flatten()
    place = np.repeat(np.arange(spans.num_rows), pc.list_value_length(spans.column("docs")).to_numpy())
    ids, lengths, held = docs.field("doc_id").to_numpy(), docs.field("dl").to_numpy(), docs.field("postings")
    postings, sizes = held.flatten(), pc.list_value_length(held).to_numpy()
    terms = postings.field("term").dictionary_encode()
    # 0: no term
    of = np.concatenate([np.arange(len(ids)), np.repeat(np.arange(len(ids)), sizes)])
    code = np.concatenate([np.zeros(len(ids), np.int64), terms.indices.to_numpy().astype(np.int64) + 1])
    tf = np.concatenate([np.ones(len(ids), np.int32), postings.field("tf").to_numpy().astype(np.int32)])
    key = place[of] * (len(terms.dictionary) + 1) + code
    rank = np.unique(ids, return_inverse=True)[1]
    order = np.lexsort((lengths[of], tf, key * len(ids) + rank[of]))
    key, of, code, tf = key[order], of[order], code[order], tf[order]
    doc_id, dl = ids[of], lengths[of]
    starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
    n = np.diff(np.append(starts, len(key)))
    first, single = doc_id[starts], pa.array(n == 1)
    member = np.repeat(n > 1, n)
    edges = pa.array(np.concatenate([[0], np.cumsum(np.where(n > 1, n, 0))]).astype(np.int32))
    lists = lambda x: pa.ListArray.from_arrays(edges, pa.array(x[member]), mask=single)
    # impacts: by length and then frequency, what beats all before in its block; one pair is (max_tf, min_dl)
    block = np.repeat(np.arange(len(n)), n)[member]
    by = np.lexsort((-tf[member], dl[member], block))
    pair_tf, pair_dl = tf[member][by], dl[member][by]
    height = block * (int(tf.max()) + 1) + pair_tf
    kept = np.concatenate([[True], height[1:] > np.maximum.accumulate(height)[:-1]])[: len(height)]
    fronts = np.bincount(block[kept], minlength=len(n))
    kept &= (fronts > 1)[block]
    fronts[fronts == 1] = 0
    pairs = pa.StructArray.from_arrays([pa.array(pair_tf[kept]), pa.array(pair_dl[kept])], names=["tf", "dl"])
    impacts = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(fronts)]).astype(np.int32)), pairs, mask=pa.array(fronts == 0))
    columns = {
        "shard": spans.column("shard").take(pa.array(place[of[starts]])),
        "term": terms.dictionary.take(pa.array(code[starts] - 1, mask=code[starts] == 0)),
        "span": spans.column("span").take(pa.array(place[of[starts]])),
        "n": pa.array(n.astype(np.int32)),
        "first": pa.array(first),
        "last": pa.array(doc_id[np.append(starts[1:], len(key)) - 1]),
        "max_tf": pa.array(np.maximum.reduceat(tf, starts)),
        "min_dl": pa.array(np.minimum.reduceat(dl, starts)),
        "impacts": impacts,
        "offsets": lists(doc_id - np.repeat(first, n)),
        "tfs": lists(tf),
        "dls": lists(dl),
    }
    return pa.RecordBatch.from_pydict(columns)


def read_blocks(blocks: DataFrame, *keep: str) -> DataFrame:
    """Postings of blocks: (keep..., doc_id, tf, dl)."""
    one = F.array(F.struct(F.lit(0).cast("long").alias("offsets"), F.col("max_tf").alias("tfs"), F.col("min_dl").alias("dls")))
    rows = blocks.select(*keep, "first", F.explode(F.when(F.col("n") == 1, one).otherwise(F.arrays_zip("offsets", "tfs", "dls"))).alias("e"))
    return rows.select(*keep, (F.col("first") + F.col("e.offsets")).alias("doc_id"), F.col("e.tfs").cast("long").alias("tf"), F.col("e.dls").alias("dl"))


def sums(found: BlockIndex, hits: DataFrame, k: float, b: float) -> DataFrame:
    """(shard, query_id, doc_id, score) of blocks that queries meet: (shard, query_id, idf) beside a block."""
    parts = read_blocks(hits, "shard", "query_id", "idf").withColumn("part", F.col("idf") * part_of(F.col("tf"), F.col("dl"), found.stats["avgdl"], k, b))
    return parts.groupBy("shard", "query_id", "doc_id").agg(F.sum("part").alias("score"))


def search_table(found: BlockIndex, queries: DataFrame, n: int = 10, k: float = 0.75, b: float = 0.5) -> DataFrame:
    """(query_id, rank, doc_id, score): the n best documents by BM25 of each query of a table of any size; ties to the smaller doc_id.

    Nothing is collected and nothing is broadcast but what Spark itself finds small. Rows of queries without a known term
    are missing; a null query has none, nor has one without an id; an id that comes twice is one query with the terms of both.
    """
    with subset_keys(found.spark):
        hits = found.blocks.join(found.at_shards(found.weights(queries)), ["shard", "term"])
        return park(top_k(sums(found, hits, k, b).select("query_id", "doc_id", "score"), n), "results")


def ranked_spans(found: BlockIndex, weights: DataFrame, k: float, b: float) -> DataFrame:
    """(shard, query_id, span, bound, n): what a document of a span can score at most, and the postings that the span has for the query."""
    meta = found.blocks.select("shard", "term", "span", "n", best_part(found.stats["avgdl"], k, b).alias("best"))
    met = meta.join(found.at_shards(weights), ["shard", "term"])
    return met.groupBy("shard", "query_id", "span").agg(F.sum(F.col("idf") * F.col("best")).alias("bound"), F.sum("n").alias("n"))


def floors(blocks: DataFrame, wanted: DataFrame, weights: DataFrame) -> DataFrame:
    """Blocks without those of less impact than any that is wanted, term by term, where the terms are few: read from the files' statistics."""
    terms = [r.term for r in weights.select("term").distinct().limit(PUSHED_FLOORS + 1).collect()]
    if not terms or len(terms) > PUSHED_FLOORS:
        return blocks
    low = blocks.where(F.col("term").isin(terms)).select("term", "span", "low").join(wanted.select("query_id", "span"), "span").join(weights, ["query_id", "term"]).groupBy("term").agg(F.max("low").alias("low")).collect()
    tests = [(F.col("term") == r.term) & (F.col("low") <= r.low) for r in low]
    return blocks.where(functools.reduce(operator.or_, tests) if tests else F.lit(False))


def score_spans(found: BlockIndex, wanted: DataFrame, weights: DataFrame, k: float, b: float) -> DataFrame:
    """(query_id, doc_id, score) of all documents of the wanted spans (shard, query_id, span)."""
    pairs = wanted.select("shard", "query_id", "span").join(weights, "query_id").repartition(found.shards, "shard")
    hits = floors(found.blocks, wanted, weights).join(pairs, ["shard", "term", "span"])
    return sums(found, hits, k, b).select("query_id", "doc_id", "score")


def top_k_pruned(found: BlockIndex, queries: DataFrame, n: int = 10, k: float = 0.75, b: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """The rows of `search_table`, and (query_id, n_postings, n_read): how many postings the queries' terms have and how many were scored.

    The bounds of spans come from impacts alone. The n most promising spans are scored first; each has a document at
    least, so they give an n-th best score, and of the rest those spans are scored that can reach it. So the result is exact.
    """
    if k < 0 or not 0 <= b <= 1:
        raise ValueError("bounds hold for k of at least 0 and b from 0 to 1")
    spark = found.spark
    with subset_keys(spark):
        weights = found.weights(queries)
        spans = park(ranked_spans(found, weights, k, b), "spans")
        best = Window.partitionBy("query_id").orderBy(F.desc("bound"), "span")
        first = spans.withColumn("at", F.row_number().over(best)).where(F.col("at") <= n)
        first = park(first.select("shard", "query_id", "span"), "first")
        known = park(score_spans(found, first, weights, k, b), "known")
        # a query with fewer than n documents so far has scored all its spans
        last = top_k(known, n).where(F.col("rank") == n).select("query_id", F.col("score").alias("last"))
        rest = spans.join(last, "query_id").where(F.col("bound") >= F.col("last") - SLACK).join(first, ["shard", "query_id", "span"], "left_anti")
        rest = park(rest.select("shard", "query_id", "span"), "rest")
        results = park(top_k(known.unionByName(score_spans(found, rest, weights, k, b)), n), "results")
    read = spans.join(first.unionByName(rest), ["shard", "query_id", "span"], "left_semi").groupBy("query_id").agg(F.sum("n").alias("n_read"))
    counts = spans.groupBy("query_id").agg(F.sum("n").alias("n_postings")).join(read, "query_id")
    return results, counts

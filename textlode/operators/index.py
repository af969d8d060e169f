"""The inverted index as tables, and its statistics.

postings  (term, doc_id, tf, dl, sq_n, sq_l, sq_b[, positions]), in files sorted by term; the document's
          length and squared norms ride along, so that scoring joins nothing by document
terms     (term, df), sorted by term
docs      (doc_id, dl), every document, those without tokens too
meta      layout, ranker, parameters, analyzer settings, corpus statistics

An index written to a path is a version of it (sources/snapshots.py): its tables stand in folders of their own, and the
version that names them is committed when all are there. Whoever has opened an older version goes on reading that.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.analysis import RAW, Analyzer, analyze, positions
from ..session import park, scratch
from ..sources.snapshots import Snapshots


class PostingType(Enum):
    BOOLEAN = "boolean"
    FREQUENCY = "frequency"
    POSITIONAL = "positional"


def half_even(x: Column, digits: int = 3) -> Column:
    return F.bround(x, digits)


#: Repeated ids up to this many are broadcast.
BROADCAST_IDS = 100_000
#: Rows of one file of a sorted table, about 60 MB while it is sorted: a table that grows gets more files, not larger ones.
FILE_ROWS = 500_000


def by_repetition(tokens: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose doc_id no other row has, and the others, None if there are none. Ids alone are exchanged."""
    ids = park(tokens.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("again")), "repeated")
    n = ids.count()
    if not n:
        return tokens, None
    ids, same = F.broadcast(ids) if n <= BROADCAST_IDS else ids, F.col("doc_id").eqNullSafe(F.col("again"))
    return tokens.join(ids, same, "left_anti"), tokens.join(ids, same, "left_semi")


def gathered(tokens: DataFrame, positional: bool = False) -> DataFrame:
    """(doc_id, dl, postings) of rows (doc_id, tokens), each by itself: no token is exchanged or held beyond its document.

    postings: an array of (term, tf), or (term, positions). A document's tokens are sorted, and each run of equal ones is a posting.
    """
    words = F.transform("tokens", lambda t, i: F.struct(t.alias("term"), i.alias("pos"))) if positional else F.col("tokens")
    term = lambda x: x["term"] if positional else x
    # each step is a column that the next one reads more than once, so that it is worked out once
    rows = tokens.select("doc_id", F.sort_array(words).alias("words"))
    first = F.transform("words", lambda x, i: F.when((i == 0) | (term(x) != term(F.get("words", i - 1))), i))
    rows = rows.select("doc_id", "words", F.filter(first, lambda i: i.isNotNull()).alias("starts"))

    def posting(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("starts", k + 1), F.size("words"))
        what = F.transform(F.sequence(start, end - 1), lambda i: F.get("words", i)["pos"]).alias("positions") if positional else (end - start).cast("long").alias("tf")
        return F.struct(term(F.get("words", start)).alias("term"), what)

    return rows.select("doc_id", F.size("words").alias("dl"), F.transform("starts", posting).alias("postings"))


def unpacked(rows: DataFrame, *columns: str) -> DataFrame:
    """A row for each posting of gathered rows, with columns of their document. The outer form as in `positions`."""
    return rows.select("doc_id", *columns, F.explode_outer("postings").alias("x")).where("x is not null").select("x.*", "doc_id", *columns)


def united(once: DataFrame, again: DataFrame | None) -> DataFrame:
    return once if again is None else once.unionByName(again)


def boolean_postings(tokens: DataFrame) -> DataFrame:
    """(term, doc_id): which documents have a term."""
    once, again = by_repetition(tokens)
    rows = once.select("doc_id", F.array_distinct("tokens").alias("tokens"))
    return united(positions(rows).select("term", "doc_id"), again and positions(again).select("term", "doc_id").distinct())


def frequency_postings(tokens: DataFrame) -> DataFrame:
    """(term, doc_id, tf): how often."""
    once, again = by_repetition(tokens)
    return united(unpacked(gathered(once)).select("term", "doc_id", "tf"), again and positions(again).groupBy("term", "doc_id").agg(F.count("*").alias("tf")))


def positional_postings(tokens: DataFrame) -> DataFrame:
    """(term, doc_id, positions): where, in order, from 0."""
    once, again = by_repetition(tokens)
    return united(unpacked(gathered(once, True)).select("term", "doc_id", "positions"), again and positions(again).groupBy("term", "doc_id").agg(F.sort_array(F.collect_list("pos")).alias("positions")))


LAYOUTS = {PostingType.BOOLEAN: boolean_postings, PostingType.FREQUENCY: frequency_postings, PostingType.POSITIONAL: positional_postings}


def register_posting_type(kind, build) -> None:
    """Add a layout of one's own, to be indexed and opened by its name: build(tokens) -> DataFrame with term and doc_id, rows of them distinct."""
    LAYOUTS[kind] = build


def postings_of(tokens: DataFrame, kind) -> DataFrame:
    if kind not in LAYOUTS:
        raise ValueError(f"unknown posting type {kind!r}")
    return LAYOUTS[kind](tokens)


@dataclass(frozen=True)
class Hooks:
    """What a ranker keeps in an index, worked out while it is built.

    postings    columns of counted postings: f(window over all postings of the document) -> Column over (term, doc_id, tf[, positions])
    terms       columns of the terms table: an aggregate over a term's postings, the columns above among them
    parameters  values for the metadata, which whoever opens the index finds there
    """

    postings: Mapping[str, Callable[[WindowSpec], Column]] = field(default_factory=dict)
    terms: Mapping[str, Callable[[], Column]] = field(default_factory=dict)
    parameters: Mapping[str, object] = field(default_factory=dict)


HOOKS: dict[str, Hooks] = {}
#: Columns that every index of counted postings has.
TAKEN = frozenset(("term", "doc_id", "tf", "dl", "sq_n", "sq_l", "sq_b", "positions", "df"))


def register_hooks(ranker: str, hooks: Hooks) -> None:
    """Let a ranker have columns of its own in the indexes that are built for it (Index.build(rankers=...))."""
    names = [*hooks.postings, *hooks.terms]
    if len(set(names)) < len(names) or TAKEN & set(names):
        raise ValueError(f"column names {names} are taken or repeated")
    HOOKS[ranker] = hooks


def hooks_of(rankers: Iterable[str]) -> Hooks:
    """The hooks of several rankers together; those that use one name for a column share it if they are the same."""
    whole = Hooks()
    for ranker in rankers:
        if ranker not in HOOKS:
            raise ValueError(f"no hooks are registered for the ranker {ranker!r}")
        for have, more in ((whole.postings, HOOKS[ranker].postings), (whole.terms, HOOKS[ranker].terms), (whole.parameters, HOOKS[ranker].parameters)):
            if clash := [c for c in more if c in have and have[c] != more[c]]:
                raise ValueError(f"rankers do not agree about {clash}")
            have.update(more)
    if set(whole.postings) & set(whole.terms):
        raise ValueError("a column of postings and one of terms have the same name")
    return whole


def document_frequencies(postings: DataFrame, more: Mapping[str, Callable[[], Column]] | None = None) -> DataFrame:
    """(term, df) of any layout, with more aggregates by name: rows of (term, doc_id) are distinct."""
    return postings.groupBy("term").agg(F.count("*").alias("df"), *(f().alias(name) for name, f in (more or {}).items()))


def document_lengths(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_id", F.size("tokens").cast("long").alias("dl"))


def corpus_statistics(lengths: DataFrame) -> DataFrame:
    """One row: n_docs, avgdl, min_norm, max_norm; norms are lengths over the average, to three places. An empty corpus has nulls."""
    return statistics_of(lengths.agg(F.count("*").alias("n_docs"), F.sum("dl").alias("total"), F.min("dl").alias("lo"), F.max("dl").alias("hi")))


def statistics_of(sums: DataFrame) -> DataFrame:
    """The same from sums of lengths (n_docs, total, lo, hi), which add up over parts of a corpus."""
    sums = sums.select("n_docs", F.when(F.col("n_docs") > 0, F.col("total").cast("double") / F.col("n_docs")).alias("avgdl"), "lo", "hi")
    norm = lambda c: half_even(F.when(F.col("avgdl") > 0, F.col(c) / F.col("avgdl")))
    return sums.select("n_docs", "avgdl", norm("lo").alias("min_norm"), norm("hi").alias("max_norm"))


def ranked_postings(rows: DataFrame, kind: PostingType, n: int, more: Mapping[str, Callable[[WindowSpec], Column]] | None = None) -> DataFrame:
    """Postings of gathered rows with what scoring asks of their document, with more columns by name; n: how many there are."""
    positional = kind is PostingType.POSITIONAL
    if more:  # dealt by document before they are unpacked, so that windows over a document exchange nothing more
        rows = rows.repartition(files_for(rows.sparkSession, n), "doc_id")
    made = unpacked(rows, "dl", "sq_n", "sq_l", "sq_b")
    if positional:
        made = made.withColumn("tf", F.size("positions").cast("long"))
    of_doc = Window.partitionBy("doc_id")
    return made.select("term", "doc_id", "tf", "dl", "sq_n", "sq_l", "sq_b", *(["positions"] if positional else []), *(f(of_doc).alias(name) for name, f in (more or {}).items()))


def squared_norms(positional: bool) -> dict[str, Column]:
    """Squared norms of a gathered row, by its damped frequencies."""
    tf = lambda x: (F.size(x["positions"]) if positional else x["tf"]).cast("double")
    of = lambda f: F.aggregate("postings", F.lit(0.0), lambda a, x: a + f(tf(x)) * f(tf(x)))
    return {"sq_n": of(lambda t: t), "sq_l": of(lambda t: 1 + F.log(t)), "sq_b": F.size("postings").cast("double")}


def met_postings(tokens: DataFrame, kind: PostingType, more: Mapping[str, Callable[[WindowSpec], Column]] | None = None) -> DataFrame:
    """The columns of ranked_postings for documents that several rows have, whose tokens meet."""
    # dealt by document, so that grouping by (document, term) and the sums by document exchange nothing more
    spots = positions(tokens.repartition("doc_id"))
    what = [F.count("*").cast("long").alias("tf")]
    if kind is PostingType.POSITIONAL:
        what.append(F.sort_array(F.collect_list("pos")).alias("positions"))
    postings = spots.groupBy("doc_id", "term").agg(*what)
    damped = 1 + F.log(F.col("tf").cast("double"))
    of_doc = Window.partitionBy("doc_id")
    postings = postings.select(
        "term",
        "doc_id",
        "tf",
        F.sum("tf").over(of_doc).cast("int").alias("dl"),
        F.sum((F.col("tf") * F.col("tf")).cast("double")).over(of_doc).alias("sq_n"),
        F.sum(damped * damped).over(of_doc).alias("sq_l"),
        F.count("*").over(of_doc).cast("double").alias("sq_b"),
        *(["positions"] if kind is PostingType.POSITIONAL else []),
        *(f(of_doc).alias(name) for name, f in (more or {}).items()),
    )
    return postings


@dataclass
class Index:
    """An opened index. stats holds four numbers, read once."""

    spark: SparkSession
    kind: PostingType
    analyzer: Analyzer
    postings: DataFrame
    terms: DataFrame
    docs: DataFrame
    stats: dict
    meta: dict = field(default_factory=dict)
    extra: dict[str, DataFrame] = field(default_factory=dict)
    version: int | None = None
    rankers: tuple[str, ...] = ()

    @property
    def n_docs(self) -> int:
        return self.stats["n_docs"]

    def doc_norm(self, dl: Column) -> Column:
        return half_even(dl / F.lit(self.stats["avgdl"] or 1.0))

    @staticmethod
    def build(docs: DataFrame, analyzer: Analyzer = RAW, kind: PostingType = PostingType.POSITIONAL, key: str = "doc_id", text: str = "text", meta: dict | None = None, path: str | None = None, extra: dict[str, DataFrame] | None = None, rankers: Iterable[str] = ()) -> Index:
        """Index a table of documents and write it, as a new version of `path` or to the session's shared folder.

        A document's postings are gathered from its own text and written first, so that nothing is analysed twice
        and no token is exchanged; the only exchange of postings is the final sort by term.
        A null text is an empty document. Duplicate keys are documents of one name: their tokens meet in one posting.
        extra: further tables by name that belong to the index. rankers: names whose hooks add columns to it. A build that stops leaves the versions before as they are;
        of two builds at once one is committed and the other raises CommitConflict.
        """
        spark = docs.sparkSession
        if kind not in LAYOUTS:
            raise ValueError(f"unknown posting type {kind!r}")
        rankers = tuple(rankers)
        hooks = hooks_of(rankers)
        if (hooks.postings or hooks.terms) and kind not in (PostingType.FREQUENCY, PostingType.POSITIONAL):
            raise ValueError("hooks add columns to frequency or positional postings only")
        whole = {"posting_class": getattr(kind, "value", kind), **analyzer.settings()}
        for name, value in (hooks.parameters | (meta or {})).items():
            if name in whole:
                raise ValueError(f"metadata key {name!r} is taken")
            whole[name] = value
        place = Place(spark, path)
        with scratch(spark):
            tokens = analyze(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), analyzer)
            postings, lengths, n = postings_by_document(tokens, kind, hooks.postings)
            made = place.write_sorted(postings, "postings", n)
            terms = place.write_sorted(document_frequencies(made, hooks.terms), "terms")
            docs_table = place.write(lengths, "docs")
            more = {name: place.write(df, name) for name, df in (extra or {}).items()}
        stats = corpus_statistics(docs_table.select("doc_id", F.col("dl").cast("long"))).first().asDict()
        version = place.commit({"meta": whole, "corpus": stats, "extra": sorted(more), "rankers": list(rankers)})
        return Index(spark, kind, analyzer, made, terms, docs_table, stats, whole, more, version, rankers)

    @staticmethod
    def open(spark: SparkSession, path: str, version: int | None = None) -> Index:
        """An index written by build(), its last version or the one named; what is missing is an error of the reader."""
        store = Snapshots(spark, path)
        version, content = store.load(version)
        if not version:
            raise ValueError(f"no index at {path}")
        whole, names = content["meta"], content["names"]
        read = lambda name: spark.read.parquet(store.table(names[name]))
        kind = next((k for k in LAYOUTS if getattr(k, "value", k) == whole["posting_class"]), None)
        if kind is None:
            raise ValueError(f"unknown posting type {whole['posting_class']!r}")
        return Index(spark, kind, Analyzer.from_settings(whole), read("postings"), read("terms"), read("docs"), content["corpus"], whole, {n: read(n) for n in content["extra"]}, version, tuple(content.get("rankers", ())))


def postings_by_document(tokens: DataFrame, kind, more: Mapping[str, Callable[[WindowSpec], Column]] | None = None) -> tuple[DataFrame, DataFrame, int]:
    """Postings of a layout with what scoring asks of their document, with more columns by name where they are counted; lengths
    (doc_id, dl) of rows of tokens; and about how many postings there are. Texts are analysed once: what a document holds is written here."""
    lengths = lambda df: df.select("doc_id", F.size("tokens").alias("dl"))
    if not isinstance(kind, PostingType):
        tokens = park(tokens, "tokens")
        return postings_of(tokens.repartition("doc_id"), kind), lengths(tokens), tokens.agg(F.sum(F.size("tokens"))).first()[0] or 0
    once, again = by_repetition(tokens)
    again = again and park(again, "tokens")
    if kind is PostingType.BOOLEAN:
        held = F.array_distinct("tokens")
        rows = park(once.select("doc_id", F.size("tokens").alias("dl"), F.transform(held, lambda t: F.struct(t.alias("term"))).alias("postings")), "documents")
    else:
        positional = kind is PostingType.POSITIONAL
        rows = park(gathered(once, positional).withColumns(squared_norms(positional)), "documents")
    n = sum(df.agg(F.sum(F.size(c))).first()[0] or 0 for df, c in ((rows, "postings"), (again, "tokens")) if df is not None)
    if kind is not PostingType.BOOLEAN:
        made = united(ranked_postings(rows, kind, n, more), again and met_postings(again, kind, more))
    else:
        # the length rides along, summed over documents of one name
        made = united(unpacked(rows, "dl"), again and met_postings(again, PostingType.FREQUENCY).select("term", "doc_id", "dl"))
    return made, united(rows.select("doc_id", "dl"), again and lengths(again)), n


class Place:
    """Where an index is written: folders of a coming version, or the session's shared folder."""

    def __init__(self, spark: SparkSession, path: str | None) -> None:
        self.spark, self.path, self.names = spark, path, {}
        self.store = Snapshots(spark, path) if path else None
        self.after = self.store.load()[0] if self.store else 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        if self.store is None:
            return park(df, name, keep=True)
        self.names[name] = self.store.fresh(name)
        df.write.option("compression", "zstd").parquet(self.store.table(self.names[name]))
        return self.spark.read.parquet(self.store.table(self.names[name]))

    def write_sorted(self, df: DataFrame, name: str, n: int = 0) -> DataFrame:
        return self.write(sorted_by_term(df, n), name)

    def commit(self, content: dict) -> int | None:
        if self.store is None:
            return None
        version = self.store.commit(content | {"names": self.names, "tables": sorted(self.names.values())}, self.after)
        # for people: the last version's metadata as text
        row = json.dumps(content["meta"] | {"corpus": content["corpus"]}, sort_keys=True)
        self.spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/meta")
        return version


def files_for(spark: SparkSession, rows: int) -> int:
    """As many as the session's shuffle partitions, and more for so many rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // FILE_ROWS))


def sorted_by_term(df: DataFrame, rows: int = 0) -> DataFrame:
    """In files sorted by term, so that a search reads the row groups of its terms; rows: about how many there are."""
    order = [c for c in ("term", "doc_id") if c in df.columns]
    # doc_id too: a term that most documents have is dealt over several files
    return df.repartitionByRange(files_for(df.sparkSession, rows), *order).sortWithinPartitions(*order)

"""An index that grows: micro-batches become immutable segments, levels of segments are compacted, searches read a snapshot.

    segment   postings and terms sorted by term, docs: the tables of a small index
    version   which segments count, by level; the last batch of each stream; sums of lengths

Segments of a level are merged into one of the next when there are FANOUT, so a search opens few files for a term
however many batches came. Document frequencies add up over segments when they are read, corpus statistics from the sums
in the version. A batch and the compaction after it are committed as one, together with the batch's number: a batch that
is run again finds its number and adds nothing, one that stopped half-way had added nothing.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.analysis import RAW, Analyzer, analyze
from ..operators.index import BROADCAST_IDS, Index, PostingType, document_frequencies, postings_by_document, sorted_by_term, statistics_of
from ..session import park, scratch
from ..sources.snapshots import Snapshots

FANOUT = 3
PARTS = ("postings", "terms", "docs")


@dataclass(frozen=True)
class Segment:
    """Names of a segment's tables, and sums of its documents' lengths."""

    postings: str
    terms: str
    docs: str
    n_docs: int
    total: int
    lo: int | None
    hi: int | None


class GrowingIndex:
    def __init__(self, spark: SparkSession, path: str, analyzer: Analyzer = RAW, kind: PostingType = PostingType.POSITIONAL) -> None:
        """analyzer and kind are those of a new index; one that is there keeps its own."""
        self.spark, self.store = spark, Snapshots(spark, path)
        self.refresh()
        if self.version:
            self.analyzer, self.kind = Analyzer.from_settings(self.state["meta"]), PostingType(self.state["meta"]["posting_class"])
        else:
            self.analyzer, self.kind = analyzer, kind
            self.state = {"levels": [], "batches": {}, "meta": {"posting_class": kind.value, **analyzer.settings()}}

    def refresh(self) -> None:
        """Go on from what was committed last."""
        self.version, self.state = self.store.load()

    def levels(self) -> list[list[Segment]]:
        return [[Segment(**s) for s in level] for level in self.state["levels"]]

    def segments(self) -> list[Segment]:
        return [s for level in self.levels() for s in level]

    def read(self, segments: list[Segment], part: str) -> DataFrame:
        return self.spark.read.parquet(*[self.store.table(getattr(s, part)) for s in segments])

    def write(self, df: DataFrame, part: str) -> str:
        name = self.store.fresh(part)
        df.write.option("compression", "zstd").parquet(self.store.table(name))
        return name

    def segment(self, postings: DataFrame, docs: DataFrame, n: int, terms: DataFrame | None = None) -> Segment:
        first = self.write(sorted_by_term(postings, n), "postings")
        terms = document_frequencies(self.spark.read.parquet(self.store.table(first))) if terms is None else terms
        names = [first, self.write(sorted_by_term(terms), "terms"), self.write(docs, "docs")]
        lengths = self.spark.read.parquet(self.store.table(names[2]))
        sums = lengths.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total"), F.min("dl").alias("lo"), F.max("dl").alias("hi")).first()
        return Segment(*names, *sums)

    def merged(self, segments: list[Segment]) -> Segment:
        terms = self.read(segments, "terms").groupBy("term").agg(F.sum("df").alias("df"))
        postings = self.read(segments, "postings")
        return self.segment(postings, self.read(segments, "docs"), postings.count(), terms)

    def add(self, docs: DataFrame, stream: str = "", batch: int | None = None) -> bool:
        """Index a batch (doc_id, text) as a segment. False if this batch of this stream is in already.

        Documents whose id the index has already are left out, and of equal ids in the batch all count as one document,
        as in Index.build. Batches of one index are added one after another; a second writer at the same
        time gets CommitConflict and can run its batch again.
        """
        self.refresh_if_committed()
        if batch is not None and self.state["batches"].get(stream, -1) >= batch:
            return False
        levels = self.levels()
        known = [s for level in levels for s in level]
        fresh = docs.select("doc_id", "text")
        if known:
            fresh = unknown(fresh, self.read(known, "docs"))
        with scratch(self.spark):
            new = self.segment(*postings_by_document(analyze(fresh, self.analyzer), self.kind))
        if new.n_docs:
            levels = compacted([[*(levels[0] if levels else []), new], *levels[1:]], self.merged)
        batches = self.state["batches"] | ({stream: batch} if batch is not None else {})
        self.commit(levels, batches)
        return True

    def refresh_if_committed(self) -> None:
        if self.version:
            self.refresh()

    def commit(self, levels: list[list[Segment]], batches: dict) -> None:
        rows = [[asdict(s) for s in level] for level in levels]
        tables = [getattr(s, part) for level in levels for s in level for part in PARTS]
        state = {"levels": rows, "batches": batches, "meta": self.state["meta"], "tables": tables}
        self.version, self.state = self.store.commit(state, self.version), state

    def stream(self, docs: DataFrame, checkpoint: str, name: str = "documents", **trigger):
        """Start a stream of (doc_id, text) into the index. Its name keeps the batches of several streams apart."""

        def write(batch: DataFrame, number: int) -> None:
            self.add(batch, name, number)

        return docs.select("doc_id", "text").writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def snapshot(self, version: int | None = None) -> Index:
        """The index as it was committed last, or as a version named; it does not change while more is added."""
        number, state = self.store.load(version)
        segments = [Segment(**s) for level in state.get("levels", []) for s in level]
        if not segments:
            raise ValueError("nothing is indexed yet")
        sums = self.spark.createDataFrame([(s.n_docs, s.total, s.lo, s.hi) for s in segments], "n_docs long, total long, lo long, hi long")
        stats = statistics_of(sums.agg(F.sum("n_docs").alias("n_docs"), F.sum("total").alias("total"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))).first().asDict()
        terms = self.read(segments, "terms").groupBy("term").agg(F.sum("df").alias("df"))
        return Index(self.spark, self.kind, self.analyzer, self.read(segments, "postings"), terms, self.read(segments, "docs"), stats, state["meta"], {}, number)

    def expire(self, keep: int = 1) -> list[str]:
        """Remove old versions and what only they, or stopped batches, have written. Not while a batch is being added."""
        return self.store.expire(keep)


def unknown(docs: DataFrame, known: DataFrame) -> DataFrame:
    """docs without those whose doc_id is known. Ids alone are joined; texts move only where ids come again, and many of them."""
    again = park(docs.select("doc_id").join(known.select("doc_id"), "doc_id", "left_semi").distinct(), "known")
    if not (n := again.count()):
        return docs
    return docs.join(F.broadcast(again) if n <= BROADCAST_IDS else again, "doc_id", "left_anti")


def compacted(levels: list[list[Segment]], merge) -> list[list[Segment]]:
    """Levels with none of FANOUT segments or more: such a level becomes one segment of the next."""
    out = [list(level) for level in levels]
    for i, level in enumerate(out):
        if len(level) >= FANOUT:
            if i + 1 == len(out):
                out.append([])
            out[i + 1].append(merge(level))
            level.clear()
    return out

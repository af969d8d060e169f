"""Line dedup: levelled sorted runs of line digests with the number of documents that have each.

A run is what one batch adds: (line, n), a row for each key, in buckets by key and sorted within them. Runs of a
level are compacted into one of the next when there are FANOUT of them, so a key's count lies in a few runs
however many batches came. Runs are buckets of one table, so merging them, or a batch with them, moves only the batch.
Which runs count is said by a committed version of the folder: a batch or a compaction that stops half-way, or is
run again, adds nothing twice.

A batch meets the runs by an anti-join: lines whose key they count often enough go, the others stay.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.snapshots import Snapshots
from .common import by_slices, forget, park, shared_dir, table

#: White space that is stripped from both ends of a line.
SPACES = b" \t\n\x0b\x0c\r"
#: Runs of a level that are compacted into one, and batches that a whole table is dealt into.
FANOUT, BATCHES = 3, 4
#: A key on more than one in HOT of all lines is hot. There are HOT of them at most, of 24 bytes each.
HOT = 10_000


@dataclass(frozen=True)
class Rules:
    """least_docs: documents that have a key, for its lines to go; least_chars: of a key that can go."""

    least_docs: int = 10
    least_chars: int = 1


def key_of(line: bytes) -> bytes:
    return line.strip(SPACES).lower()  # bytes: A-Z only


def digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def long_enough(key: bytes, least: int) -> bool:
    return bool(key) and (least <= 1 or len(key.decode()) >= least)


def document_key(doc_id: str, text: str) -> list:
    """Two digests of what a document is: rows that are equal in both columns are one document here, with one result."""
    return [F.xxhash64(doc_id, text).alias("_tl_a"), F.xxhash64(F.lit(1), text, doc_id).alias("_tl_b")]


def lines_of(docs: DataFrame, rules: Rules, doc_id: str = "doc_id", text: str = "text", batches: int = 1) -> DataFrame:
    """(batch, _tl_a, _tl_b, line) of each different key of a document that can go."""

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for whole in batches_:
            for part in by_slices(iter([whole])):
                found, ends = [], [0]
                for text_ in part.column(2):
                    keys = set(map(key_of, text_.as_py().split(b"\n")))
                    found += [digest(k) for k in keys if long_enough(k, rules.least_chars)]
                    ends.append(len(found))
                lines = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found, pa.binary()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lines], ["_tl_a", "_tl_b", "lines"])

    keyed = docs.where(F.col(text).isNotNull()).select(*document_key(doc_id, text), F.col(text).cast("binary").alias("text"))
    found = keyed.mapInArrow(run, "_tl_a long, _tl_b long, lines array<binary>")
    return found.select(F.pmod("_tl_a", F.lit(batches)).cast("int").alias("batch"), "_tl_a", "_tl_b", F.explode("lines").alias("line"))


class LineRuns:
    """Runs in a folder that all executors share, kept from one session to the next."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None) -> None:
        """buckets: of a new folder, as many as the session's shuffle partitions if not given; a folder keeps its number."""
        self.spark, self.store = spark, Snapshots(spark, path)
        self.version, state = self.store.load()
        self.buckets: int = state.get("buckets") or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = state.get("levels", [])
        self.name = f"textlode_runs_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (line BINARY, n BIGINT, run STRING) USING parquet OPTIONS (compression 'zstd') PARTITIONED BY (run) "
            f"CLUSTERED BY (line) SORTED BY (line) INTO {self.buckets} BUCKETS LOCATION '{self.store.path}/data'"
        )
        if self.version:
            spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")

    @property
    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def read(self, runs: list[str]) -> DataFrame:
        return self.spark.table(self.name).where(F.col("run").isin(runs)).select("line", "n")

    def write(self, counts: DataFrame) -> str:
        """A new run of (line, n). The exchange that counted them is the one that deals them into buckets."""
        run = self.store.fresh("run").replace("-", "")
        counts.select("line", "n", F.lit(run).alias("run")).write.insertInto(self.name)
        return run

    def add(self, lines: DataFrame) -> None:
        """The run of one batch: lines (line), a row for each document that has it. Then whatever levels are full are compacted."""
        levels = [list(level) for level in self.levels] or [[]]
        levels[0].append(self.write(lines.groupBy("line").agg(F.count("*").alias("n"))))
        for i, level in enumerate(levels):
            if len(level) >= FANOUT:
                if i + 1 == len(levels):
                    levels.append([])
                levels[i + 1].append(self.write(self.merged(level)))
                level.clear()
        runs = [r for level in levels for r in level]
        self.version = self.store.commit({"levels": levels, "buckets": self.buckets, "tables": [f"run={r}" for r in runs]}, self.version)
        self.levels = levels

    def merged(self, runs: list[str]) -> DataFrame:
        return self.read(runs).groupBy("line").agg(F.sum("n").alias("n"))

    def frequent(self, least: int) -> DataFrame:
        """(line, n) of keys that `least` documents or more have."""
        return self.merged(self.runs).where(F.col("n") >= least)


def going(lines: DataFrame, frequent: DataFrame, total: int) -> DataFrame:
    """Rows of lines whose key is frequent.

    A key on very many lines is one of a few, by arithmetic, and these are met where the lines lie; so no key sends
    more than one line in HOT to one task.
    """
    hot = frequent.where(F.col("n") * HOT > total).select("line", F.lit(True).alias("_tl_hot"))
    tagged = lines.join(F.broadcast(hot), "line", "left")
    rest = tagged.where("_tl_hot is null").join(frequent.where(F.col("n") * HOT <= total).select("line"), "line", "left_semi")
    return tagged.where("_tl_hot").unionByName(rest).drop("_tl_hot")


def without(docs: DataFrame, gone: DataFrame, doc_id: str = "doc_id", text: str = "text", texts: bool = True) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256[, kept]) of every document: lines whose key `gone` (_tl_a, _tl_b, line) names are dropped."""
    drops = gone.groupBy("_tl_a", "_tl_b").agg(F.collect_set("line").alias("_tl_gone"))
    rows = docs.select(F.col(doc_id).alias("_tl_doc"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_tl_text"), *document_key(doc_id, text)).join(drops, ["_tl_a", "_tl_b"], "left")
    names = [doc_id, "n_lines", "n_dropped", "kept_sha256", *(["kept"] if texts else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for whole in batches:
            for part in by_slices(iter([whole])):
                counts, dropped, marks, kept = [], [], [], []
                for text_, gone_ in zip(part.column(1), part.column(2), strict=True):
                    left = lines = text_.as_py().split(b"\n")
                    if gone_.is_valid:
                        bad = set(gone_.as_py())
                        left = [x for x in lines if digest(key_of(x)) not in bad]
                    out = b"\n".join(left)
                    counts.append(len(lines))
                    dropped.append(len(lines) - len(left))
                    marks.append(hashlib.sha256(out).hexdigest())
                    kept.append(out if texts else b"")
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(marks, pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(kept, pa.binary()).cast(pa.string())] if texts else [])], names)

    kinds = f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, n_lines long, n_dropped long, kept_sha256 string" + ", kept string" * texts
    return rows.select("_tl_doc", "_tl_text", "_tl_gone").mapInArrow(run, kinds)


def add_batch(runs: LineRuns, docs: DataFrame, rules: Rules = Rules(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One batch of a growing corpus: its lines join the runs, then those that are frequent by now go. Returns as `without`.

    Earlier batches stay as they were given out. A batch is counted once it is added; give it once.
    """
    lines = park(lines_of(docs, rules, doc_id, text), "lines")
    runs.add(lines)
    return without(docs, going(lines, runs.frequent(rules.least_docs), lines.count()), doc_id, text)


def dedup(docs: DataFrame, rules: Rules = Rules(), doc_id: str = "doc_id", text: str = "text", texts: bool = True, batches: int = BATCHES) -> DataFrame:
    """A whole table: all batches join the runs first, so that a key counts in all documents. Returns as `without`.

    A null or empty text is one empty line, which stays, as all lines of white space do; a document that loses
    all lines keeps its row with an empty text; each row is a document in the counts, repeated rows too; an
    empty table gives no rows; other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    lines = park(lines_of(docs, rules, doc_id, text, batches), "lines")
    runs = LineRuns(spark, f"{shared_dir(spark)}/textlode/runs-{uuid.uuid4().hex}")
    for i in range(batches):
        runs.add(lines.where(F.col("batch") == i))
    frequent = park(runs.frequent(rules.least_docs), "frequent")
    return without(docs, going(lines.drop("batch"), frequent, lines.count()), doc_id, text, texts)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten documents or more have. Nulls, empty tables and repeated rows as in `dedup`."""
    return dedup(table(spark, sf_dir, "documents"), texts=False)

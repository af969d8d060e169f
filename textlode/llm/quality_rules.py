"""Quality rules: base measures of a text, and lines that too many documents of a host share.

One pass over the texts writes, for each document, its measures and the digests of its
normalised lines (lower case, single spaces). Digests are counted per host over distinct
documents, pre-aggregated before each exchange. A line above the limits is removed, and a
document with too few words left is depleted and rejected.

Distinct documents are told apart by a fingerprint, the digest of their whole text in normalised
lines, so that copies of one document count once: a family of copies does not turn its own lines
into boilerplate. Near copies are documents of their own.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slices, forget, park, table

#: Fixed values of the base measures: the white space that parts words, and the symbols counted.
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
WINDOW = 5
#: Characters of a line that are handled at once, and an odd factor of window hashes.
PART, ODD = 1 << 20, np.uint64(0x9E3779B97F4A7C15)
SPACE = re.compile(r"[ \t\n\x0b\x0c\r]")


@dataclass(frozen=True)
class Rules:
    """min_words: of a text, and of what is left of it. max_repeat: per cent of words in repeated windows.
    A line is removed if more than min_docs distinct documents of its host have it, and more than max_share of them
    or more than max_docs."""

    min_words: int = 10
    max_repeat: int = 20
    min_docs: int = 20
    max_share: float = 0.02
    max_docs: int = 1000


#: Flagged lines up to this many are broadcast (16 bytes each and the host's name), more are joined by exchange.
BROADCAST_LINES = 50_000


def repeated_words(words: np.ndarray) -> int:
    """Words that lie in a 5-word window found twice or more in the text, the first included. words: their 64-bit hashes."""
    n = len(words)
    if n <= WINDOW:
        return 0
    codes = np.zeros(n - WINDOW + 1, np.uint64)
    for k in range(WINDOW):
        codes *= ODD
        codes += words[k : n - WINDOW + 1 + k]
    ordered = np.sort(codes)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(codes, twice))
    edges = np.zeros(n + 1, np.int32)
    edges[at] += 1
    edges[at + WINDOW] -= 1
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def cut(text: str, sign: str) -> Iterator[str]:
    """The parts of a text between signs, one at a time."""
    at = 0
    while (end := text.find(sign, at)) >= 0:
        yield text[at:end]
        at = end + 1
    yield text[at:]


def short_parts(line: str) -> Iterator[str]:
    """A line in parts of about PART characters, cut where words part; a longer word stays whole."""
    at = 0
    while len(line) - at > PART:
        found = SPACE.search(line, at + PART)
        if not found:
            break
        yield line[at : found.start()]
        at = found.start()
    yield line[at:] if at else line


def measure(text: str | None) -> tuple[int, int, int, int, int, int | None, np.ndarray, np.ndarray]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fingerprint, line digests, words of those lines).

    A null text counts as empty. Lines without a word are no lines. Lines are taken one by one, long ones in parts,
    and leave numbers only, so a text of any length takes a few times its own size at most.
    """
    text = text or ""
    words, raw, lines, counts = array("q"), array("q"), array("q"), array("q")
    whole = xxhash.xxh64()
    for line in cut(text, "\n"):
        if not line.strip(SPACES):
            continue
        raw.append(xxhash.xxh64_intdigest(line) - 2**63)
        if len(line) <= PART:
            parts = line.encode().split()  # bytes split at exactly SPACES
            words.extend(map(hash, parts))
            norm = b" ".join(line.lower().encode().split())
            n, key = len(parts), xxhash.xxh64_intdigest(norm)
            whole.update(norm + b" ")
        else:
            n, of_line, gap = 0, xxhash.xxh64(), b""
            for part in short_parts(line):
                parts = part.encode().split()
                words.extend(map(hash, parts))
                n += len(parts)
                if parts:
                    norm = b" ".join(part.lower().encode().split())
                    of_line.update(gap + norm)
                    whole.update(norm + b" ")
                    gap = b" "
            key = of_line.intdigest()
        lines.append(key - 2**63)
        counts.append(n)
    chars = len(text) - sum(map(text.count, SPACES))
    keys, place = np.unique(np.frombuffer(lines, np.int64), return_inverse=True)
    sums = np.bincount(place, np.frombuffer(counts, np.int64), len(keys)).astype(np.int64)
    dup = len(raw) - len(np.unique(np.frombuffer(raw, np.int64)))
    return len(words), chars, sum(map(text.count, SYMBOLS)), dup, repeated_words(np.frombuffer(words, np.uint64)), whole.intdigest() - 2**63 if words else None, keys, sums


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_tl_print")


def measured(df: DataFrame, text: str) -> DataFrame:
    """df without the text, with the measures."""
    keep = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for part in by_slices(batches):
            found = [measure(x.as_py()) for x in part.column(text)]
            numbers = [pa.array([x[i] for x in found], pa.int64()) for i in range(len(MEASURES))]
            flat = [np.concatenate([x[i] for x in found] or [np.zeros(0, np.int64)]) for i in (6, 7)]
            ends = np.cumsum([0, *(len(x[6]) for x in found)])
            lines = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in flat], ["line", "words"]))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *numbers, lines], names=[*keep, *MEASURES, "_tl_lines"])

    types = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.mapInArrow(run, f"{types}, {', '.join(f'{m} long' for m in MEASURES)}, _tl_lines array<struct<line: long, words: long>>")


def frequent_lines(docs: DataFrame, rules: Rules) -> DataFrame:
    """(_tl_host, line, n_docs) of lines above the limits, from measured documents."""
    hosts = docs.where("_tl_print is not null").select("_tl_host", "_tl_print").distinct().groupBy("_tl_host").agg(F.count("*").alias("_tl_all"))
    lines = docs.select("_tl_host", "_tl_print", F.explode("_tl_lines.line").alias("line"))
    counts = lines.distinct().groupBy("_tl_host", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > rules.min_docs)
    return counts.join(hosts, "_tl_host").where((F.col("n_docs") > rules.max_share * F.col("_tl_all")) | (F.col("n_docs") > rules.max_docs)).select("_tl_host", "line", "n_docs")


def judge(df: DataFrame, keys: list[str], text: str = "text", host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """keys with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, words_left, kept; one row for each of df.

    words_left: words outside the lines removed. kept is false if base_failed or words_left is under
    min_words. Null texts count as empty and fail; a null host is a host of its own; repeated rows
    are judged each. No other column of df is carried, whatever its name.
    """
    spark = df.sparkSession
    # cast to string: the host only groups
    rows = df.select(*[F.col(k) for k in keys], F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_tl_host"), F.col(text).alias("_tl_text"))
    rows = rows.withColumn("_tl_row", F.monotonically_increasing_id())
    docs = park(measured(rows, "_tl_text"), "measures")
    frequent = park(frequent_lines(docs, rules), "lines")
    if frequent.count() <= BROADCAST_LINES:
        frequent = F.broadcast(frequent)
    lines = docs.select("_tl_row", "_tl_host", F.explode("_tl_lines").alias("x")).select("_tl_row", "_tl_host", "x.line", "x.words")
    removed = lines.join(frequent, ["_tl_host", "line"]).groupBy("_tl_row").agg(F.sum("words").alias("_tl_gone"))
    base_failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("_tl_gone", F.lit(0))
    return docs.drop("_tl_lines").join(removed, "_tl_row", "left").select(*keys, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), left.alias("words_left"), (~base_failed & (left >= rules.min_words)).alias("kept"))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every document by the base rules and the line frequencies of its source."""
    return judge(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_left")

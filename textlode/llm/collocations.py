"""Phrase collocations: suffix arrays over word ids in shards, LCP intervals, counts merged by key.

A task gathers its texts in shards of a bounded number of words. In a shard the words of each language are
numbered as they come, and the numbers of all texts stand in one stream, parted by 0 where pieces end. Prefix
doubling sorts the stream's suffixes, and the intervals of the LCP array give each window with its occurrences in
the shard: the words that follow a place up to the piece's end, so many at most.

A phrase is the first words of the windows where it occurs. So one exchange of windows counts phrases of several sizes:
windows that start alike meet in one task, Spark sorts them, and the sums of their first words are taken as they
pass. A shard has at most one window for each of its words, however large the table.

A phrase can be frequent only if its parts are. So words are counted first, then pairs and triples in one exchange, then
four and five words, and a stream keeps only what the counts before left possible. What is frequent reaches the tasks
as a Bloom filter of a fixed size: it lets some rare phrases through, whose counts then show it, and never loses
one. Counts are exact at every size of the table; a filter that fills up costs time only.

Words are known by the 64-bit hash of language and word; 0 is no word. A hash that is 0 or that two words share is
looked for, and found would mean that all starts anew with another seed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_slices, forget, park, table
from .jaccard_join import few

#: Signs that end a piece, here all turned into the first, and the white space that parts words.
ENDS, SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"
SIGNS = bytes.maketrans(ENDS + SPACES, ENDS[:1] * len(ENDS) + SPACES[:1] * len(SPACES))
#: Words of a shard, and of texts at most that are split at once (a longer text is split alone).
SHARD, SLICE = 3_000_000, 4 << 20
#: Bits of a filter and probes of it.
FILTER_BITS, PROBES = 1 << 27, 3
#: Words of the table for each partition of windows, at most: a partition is sorted.
SORTED = 4_000_000
LONGEST = 5
WORDS = [f"w{i}" for i in range(1, LONGEST + 1)]


@dataclass(frozen=True)
class Rules:
    """least: occurrences of a phrase; top: phrases reported of each language."""

    least: int = 100
    top: int = 2000


def stream_of(texts: list[bytes]) -> list[bytes]:
    """The words of texts in lower case (A-Z only), and b'.' between pieces and texts."""
    return b".".join(texts).lower().translate(SIGNS).replace(b".", b" . ").split()


class Shard:
    """Word streams of some texts, numbered by language; 0 parts pieces."""

    def __init__(self) -> None:
        self.words: dict[str, defaultdict[bytes, int]] = {}
        self.parts: list[tuple[str, np.ndarray]] = []
        self.next, self.size = count(1).__next__, 0

    def add(self, lang: str, texts: list[bytes]) -> None:
        known = self.words.setdefault(lang, defaultdict(self.next, {b".": 0}))
        words = stream_of(texts)
        self.parts.append((lang, np.fromiter(map(known.__getitem__, words), np.int32, len(words))))
        self.size += len(words)

    def dictionary(self, seed: int) -> tuple[list[str], list[bytes], np.ndarray]:
        """(language, word, hash) of each number; 0 is no word."""
        total = sum(len(w) - 1 for w in self.words.values()) + 1
        langs, names, keys = [""] * total, [b""] * total, np.zeros(total, np.uint64)
        for lang, known in self.words.items():
            head = lang.encode() + b"\0"
            for word, i in known.items():
                if i:
                    langs[i], names[i], keys[i] = lang, word, xxhash.xxh64_intdigest(head + word, seed)
        return langs, names, keys

    def stream(self) -> np.ndarray:
        """All streams, each followed by 0."""
        return np.concatenate([np.zeros(1, np.int32), *(x for _, part in self.parts for x in (part, np.zeros(1, np.int32)))])


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    """Shards of rows (lang, text), text as binary."""
    forget()
    shard = Shard()
    for batch in batches:
        for part in by_slices(iter([batch]), 4000, SLICE):
            texts = defaultdict(list)
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                texts[lang].append(text)
            for lang, found in texts.items():
                shard.add(lang, found)
            if shard.size >= SHARD:
                yield shard
                shard = Shard()
    if shard.parts:
        yield shard


# suffix arrays


def suffix_array(stream: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first `depth` numbers, by prefix doubling: ranks of pairs of ranks."""
    rank, width = stream.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while width < depth:
        after = np.zeros_like(rank)
        after[:-width] = rank[width:] + 1
        key = rank * (int(after.max(initial=0)) + 1) + after
        order = np.argsort(key)
        steps = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty_like(key)
        rank[order] = steps
        width *= 2
    return order


def lcp_array(stream: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Words that each suffix shares with the one before it in order: no 0 among them, `depth` at most."""
    padded = np.concatenate([stream, np.zeros(depth, stream.dtype)])
    lcp, alive = np.zeros(len(order), np.int8), np.ones(max(len(order) - 1, 0), bool)
    for j in range(depth):
        here, before = padded[order[1:] + j], padded[order[:-1] + j]
        alive &= (here == before) & (here != 0)
        lcp[1:] += alive
    return lcp


def intervals(stream: np.ndarray, sizes: range) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, phrases as rows of numbers, occurrences) for each size: the LCP intervals of at least that depth."""
    depth = sizes[-1]
    if len(stream) <= depth:
        return
    order = suffix_array(stream, depth)
    lcp = lcp_array(stream, order, depth)
    padded = np.concatenate([stream, np.zeros(depth, stream.dtype)])
    for size in sizes:
        starts = np.flatnonzero(lcp < size)
        lengths = np.diff(np.append(starts, len(order)))
        phrases = padded[order[starts][:, None] + np.arange(size)]
        whole = (phrases != 0).all(1)
        yield size, phrases[whole], lengths[whole]


def windows(stream: np.ndarray, sizes: range) -> tuple[np.ndarray, np.ndarray]:
    """(windows as rows of numbers, occurrences): what follows each place up to the next 0, sizes[-1] words at most, then zeros; sizes[0] words at least."""
    depth = sizes[-1]
    order = suffix_array(stream, depth)
    lcp = lcp_array(stream, order, depth)
    padded = np.concatenate([stream, np.zeros(depth, stream.dtype)])
    length, alive = np.zeros(len(order), np.int8), np.ones(len(order), bool)
    for j in range(depth):
        alive &= padded[order + j] != 0
        length += alive
    # a suffix has the window of the one before it if they share all words of both
    starts = np.flatnonzero((lcp < length) | (np.concatenate([[-1], length[:-1]]) != length))
    times = np.diff(np.append(starts, len(order)))
    long = length[starts] >= sizes[0]
    starts, times = starts[long], times[long]
    found = padded[order[starts][:, None] + np.arange(depth)]
    found[np.arange(depth) >= length[starts][:, None]] = 0
    return found, times


# what may be frequent


def mixed(keys: list[np.ndarray]) -> np.ndarray:
    """One 64-bit hash of each row of word hashes."""
    x = np.zeros(len(keys[0]), np.uint64)
    for key in keys:
        x = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def probes(x: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    step = (x >> np.uint64(17)) | np.uint64(1)
    for i in range(PROBES):
        yield (x + np.uint64(i) * step) & np.uint64(bits - 1)


def may_have(filter_: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    x = mixed(keys)
    found = np.ones(len(x), bool)
    for at in probes(x, len(filter_) * 64):
        found &= (filter_[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return found


def filter_of(frequent: DataFrame, size: int, bits: int) -> np.ndarray:
    """The Bloom filter of frequent phrases of `size` words. Tasks set bits, Spark joins them by slot: bits / 64 rows at most reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            x = mixed([c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns])
            at = np.concatenate(list(probes(x, bits)))
            slots, place = np.unique(at >> np.uint64(6), return_inverse=True)
            own = np.zeros(len(slots), np.uint64)
            np.bitwise_or.at(own, place, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(own.view(np.int64))], ["slot", "own"])

    rows = frequent.select(*WORDS[:size]).mapInArrow(run, "slot int, own long").groupBy("slot").agg(F.expr("bit_or(own)").alias("own")).toArrow()
    found = np.zeros(bits // 64, np.uint64)
    found[rows.column("slot").to_numpy()] = rows.column("own").to_numpy().view(np.uint64)
    return found


def thinned(stream: np.ndarray, covered: np.ndarray) -> np.ndarray:
    """The stream with 0 for what is not covered, and one 0 for several."""
    left = np.where(covered, stream, 0)
    return left[np.concatenate([[True], (left[1:] != 0) | (left[:-1] != 0)])]


def possible(stream: np.ndarray, keys: np.ndarray, size: int, filter_: np.ndarray) -> np.ndarray:
    """The stream without what lies in no possible phrase of `size` words or more, where the filter knows those of size - 1."""
    part = size - 1
    n = len(stream) - part + 1
    if n < 2:
        return np.zeros(0, stream.dtype)
    if part == 1:
        ok = may_have(filter_, [keys])[stream] & (stream != 0)
    else:
        at = np.flatnonzero(np.all([stream[j : n + j] != 0 for j in range(part)], axis=0))
        ok = np.zeros(n, bool)
        ok[at] = may_have(filter_, [keys[stream[at + j]] for j in range(part)])
    starts = ok[:-1] & ok[1:]  # both parts of `size` words that start here
    covered = np.zeros(len(stream), bool)
    for j in range(size):
        covered[j : j + len(starts)] |= starts
    return thinned(stream, covered)


# the counts


def rows_of(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text")).where("text is not null")


def count_words(rows: DataFrame, seed: int) -> DataFrame:
    """(lang, word, w1, f) of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            langs, names, keys = shard.dictionary(seed)
            times = np.bincount(shard.stream(), minlength=len(keys))[1:]
            yield pa.RecordBatch.from_arrays([pa.array(langs[1:], pa.string()), pa.array(names[1:], pa.binary()).cast(pa.string()), pa.array(keys[1:].view(np.int64)), pa.array(times.astype(np.int64))], ["lang", "word", "w1", "n"])

    return rows.mapInArrow(run, "lang string, word string, w1 long, n long").groupBy("lang", "word", "w1").agg(F.sum("n").alias("f"))


def count_windows(spark: SparkSession, rows: DataFrame, sizes: range, seed: int, filter_: np.ndarray) -> DataFrame:
    """(w1, w2 ..., n) of the windows of each shard, where the filter knows phrases of sizes[0] - 1 words; 0 stands beyond a window's end."""
    sent = spark.sparkContext.broadcast(filter_)
    part, depth = sizes[0] - 1, sizes[-1]
    names = [*WORDS[:depth], "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            keys = shard.dictionary(seed)[2]
            found, times = windows(possible(shard.stream(), keys, sizes[0], sent.value), sizes)
            if part > 1:  # neighbours can cover an impossible part: a window ends before it
                fits = [may_have(sent.value, [keys[found[:, i + j]] for j in range(part)]) for i in range(depth - part + 1)]
                for i, ok in enumerate(np.logical_and.accumulate(fits)):
                    found[~ok, i + part - 1] = 0
                whole = found[:, part - 1 : sizes[0]].all(1)
                found, times = found[whole], times[whole]
            for at in range(0, len(found), 100_000):
                words = [pa.array(keys[found[at : at + 100_000, j]].view(np.int64)) for j in range(depth)]
                yield pa.RecordBatch.from_arrays([*words, pa.array(times[at : at + 100_000].astype(np.int64))], names)

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def frequent_ones(words: np.ndarray, times: np.ndarray, size: int) -> pa.RecordBatch:
    """Rows (w1 ... w5, f) of the first `size` words, of those that have so many."""
    whole = words[:, size - 1] != 0
    columns = [words[whole, j] if j < size else np.zeros(whole.sum(), np.int64) for j in range(LONGEST)]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(times[whole])], [*WORDS, "f"])


def first_words(batches: Iterator[pa.RecordBatch], sizes: range, least: int) -> Iterator[pa.RecordBatch]:
    """(w1 ... w5, f) of phrases of these sizes with at least `least` occurrences, from windows in order: sums over equal first words."""
    forget()
    depth = sizes[-1]
    last, sums = np.zeros((1, depth), np.int64), dict.fromkeys(sizes, 0)
    for batch in batches:
        if not batch.num_rows:
            continue
        words = np.stack([c.to_numpy() for c in batch.columns[:depth]], 1)
        before = np.concatenate([last, words[:-1]])
        changed = np.logical_or.accumulate(words != before, axis=1)
        for size in sizes:
            ends = np.flatnonzero(changed[:, size - 1])
            times = np.add.reduceat(np.concatenate([[sums[size]], batch.column(depth).to_numpy()]), np.concatenate([[0], ends + 1]))
            sums[size] = times[-1]  # its phrase may go on in the next batch
            done = times[:-1] >= least
            if done.any():
                yield frequent_ones(before[ends[done]], times[:-1][done], size)
        last = words[-1:]
    for size, f in sums.items():
        if f >= least:
            yield frequent_ones(last, np.array([f]), size)


def count_phrases(found: DataFrame, sizes: range, parts: int, least: int) -> DataFrame:
    """(w1 ... w5, f) of phrases of these sizes with at least `least` occurrences, from windows; 0 stands beyond a phrase's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from first_words(batches, sizes, least)

    ordered = found.repartition(parts, *WORDS[: sizes[0]]).sortWithinPartitions(*WORDS[: sizes[-1]])
    return ordered.mapInArrow(run, ", ".join(f"{c} long" for c in [*WORDS, "f"]))


def frequent_phrases(docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang", bits: int = FILTER_BITS, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, totals, phrases): frequent words (lang, word, w1, f), all occurrences of a language (lang, n), and
    frequent phrases of two to five words (lang, ws, f), ws their words' hashes."""
    spark, rows = docs.sparkSession, rows_of(docs, text, lang)
    while True:
        counts = park(count_words(rows, seed), "words")
        if not counts.groupBy("w1").count().where("count > 1 or w1 = 0").limit(1).count():
            break
        seed += 1  # two words of one hash, or one that would be no word
    words = counts.where(F.col("f") >= rules.least)
    totals = park(counts.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (totals.agg(F.sum("n")).first()[0] or 0) // SORTED + 1)
    found, before = [], words
    for sizes in (range(2, 4), range(4, LONGEST + 1)):
        filter_ = filter_of(before, sizes[0] - 1, bits)
        found.append(park(count_phrases(count_windows(spark, rows, sizes, seed, filter_), sizes, parts, rules.least), "phrases"))
        before = found[-1].where("w3 != 0")
    phrases = found[0].unionByName(found[1]).select("w1", F.filter(F.array(*WORDS), lambda w: w != 0).alias("ws"), "f")
    return words, totals, phrases.join(words.select("w1", "lang"), "w1").select("lang", "ws", "f")


# scores


def digits(column, precision: int):
    return F.col(column).cast(f"decimal({precision}, 0)")


def scored(words: DataFrame, totals: DataFrame, phrases: DataFrame) -> DataFrame:
    """(lang, ws, a, l, r, n, score): each phrase at its lowest-scoring cut, ties to the shortest first part.

    Decimals of 38 digits hold 1000 * a * n and l * r exactly.
    """
    known = words.select(F.array("w1").alias("ws"), "f").unionByName(phrases.select("ws", "f"))
    cuts = phrases.select("lang", "ws", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("ws") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": F.slice("ws", F.lit(1), F.col("k")), "rest": F.slice("ws", F.col("k") + 1, F.size("ws") - F.col("k"))})
    cuts = cuts.join(known.select(F.col("ws").alias("first"), F.col("f").alias("l")), "first").join(known.select(F.col("ws").alias("rest"), F.col("f").alias("r")), "rest").join(few(totals), "lang")
    cuts = cuts.withColumns({"_up": F.lit(1000).cast("decimal(4, 0)") * digits("a", 15) * digits("n", 17), "_down": digits("l", 15) * digits("r", 15)})
    cuts = cuts.withColumn("score", F.expr("_up div _down"))
    best = cuts.groupBy("lang", "ws", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "ws", "a", "b.l", "b.r", "n", "b.score")


def not_swallowed(phrases: DataFrame) -> DataFrame:
    """Phrases that no longer one contains with as many occurrences."""
    parts = [F.slice("ws", i + 1, n) for n in range(2, LONGEST) for i in range(LONGEST - n + 1)]
    fits = [(F.size("ws") > n) & (F.size("ws") >= i + n) for n in range(2, LONGEST) for i in range(LONGEST - n + 1)]
    inner = phrases.where(F.size("ws") > 2).select("f", F.explode(F.filter(F.array(*[F.when(ok, p) for ok, p in zip(fits, parts, strict=True)]), lambda p: p.isNotNull())).alias("ws"))
    longer = inner.groupBy("ws").agg(F.max("f").alias("_longer"))
    return phrases.join(longer, "ws", "left").where("_longer is null or _longer < f").drop("_longer")


def collocations(docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang", bits: int = FILTER_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of each language that their parts explain least.

    Null texts count as empty, a null language is `und`; repeated rows count each; equal scores go by
    occurrences, then by the phrase's bytes; a table without words gives no rows. Of docs only the two
    columns are read. Texts are taken whole, a long one in a shard of its own size.
    """
    words, totals, phrases = frequent_phrases(docs, rules, text, lang, bits)
    left = not_swallowed(phrases)
    best = park(scored(words, totals, phrases).join(left.select("ws"), "ws", "left_semi"), "scored")
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    first = best.withColumn("_place", F.rank().over(place)).where(F.col("_place") <= rules.top).drop("_place")
    spelt = first.select("*", F.posexplode("ws").alias("_at", "w1")).join(words.select("w1", "word"), "w1")
    spelt = spelt.groupBy("lang", "ws", "a", "l", "r", "n", "score").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = spelt.withColumn("rank", F.row_number().over(place).cast("long")).where(F.col("rank") <= rules.top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language of documents. Nulls, ties, empty tables and repeated rows as in `collocations`."""
    return collocations(table(spark, sf_dir, "documents"))

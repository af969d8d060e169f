"""Spelling variants: words one edit apart, by bands of a bitmask of letter parities.

A word's mask has a bit for each letter: whether it holds an odd number of them. One edit flips two bits at
most, so of three bands of the mask one at least stays as it is. And of a word's two halves, cut by the shorter
word's length, an edit leaves one alone. Words meet by (length, band, half), a filter on length and flipped bits
follows, and the edit distance decides. A pair is taken only where it meets first, so none is made distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import park, table

#: Letters of a word; A-Z alone are lowered.
RUN, UPPER, LOWER = "[A-Za-zÀ-ÿ]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed values of the slips that are put in: one run in SLIPS, by its CRC, loses a letter.
SLIPS = 97
LEAST_LENGTH, LEAST_TIMES, FACTOR = 5, 3, 2
#: Bits of the mask: a-z have their own, the 64 letters from U+00C0 share the rest. Bit i is in band i mod 3.
BITS, BANDS = 60, 3
BAND = [sum(1 << i for i in range(b, BITS, BANDS)) for b in range(BANDS)]


def slipped(doc_id: Column, run: Column) -> Column:
    """The run, or without one letter if the CRC of document and run says so. A null doc_id counts as an empty string."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % SLIPS == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of words long and frequent enough."""
    runs = docs.select(F.col(doc_id).alias("id"), F.explode(F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0))).alias("run"))
    words = runs.select(slipped(F.col("id"), F.translate("run", UPPER, LOWER)).alias("word"))
    return words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_TIMES)


def parity_mask(word: Column) -> Column:
    bit = lambda c: F.when(F.ascii(c) <= 122, F.ascii(c) - 97).otherwise(26 + (F.ascii(c) - 192) % (BITS - 26))  # noqa: E731  ascii: the code point
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda mask, c: F.when(c == "", mask).otherwise(mask.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit(c)))))


def meeting_rows(words: DataFrame, lengths: list[Column]) -> DataFrame:
    """A row of words for each length, band and half, with the key that it meets others by."""
    rows = words.withColumn("len", F.explode(F.array(*lengths)))
    cut = F.floor(F.col("len") / 2).cast("int")
    halves = F.array(F.substring("word", F.lit(1), cut), F.expr("right(word, len - cast(floor(len / 2) as int))"))
    bands = F.array(*[F.struct(F.lit(b).alias("band"), F.col("mask").bitwiseAND(F.lit(BAND[b])).alias("bits")) for b in range(BANDS)])
    rows = rows.select("word", "n", "mask", "len", F.explode(bands).alias("b"), halves.alias("halves")).select("*", F.posexplode("halves").alias("half", "part"))
    return rows.select("word", "n", "mask", "len", "b.band", "half", F.xxhash64("len", "b.band", "b.bits", "half", "part").alias("key"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n) of words (word, n) that one inserted, deleted or replaced letter turns into each other, each pair once."""
    masked = park(words.withColumn("mask", parity_mask(F.col("word"))), "masks")
    size = F.length("word")
    left = meeting_rows(masked, [size]).select("key", "band", "half", "len", *[F.col(c).alias(f"a_{c}") for c in ("word", "n", "mask")])
    # a word is met by those of its own length and by those one shorter
    right = meeting_rows(masked, [size, size - 1]).select("key", *[F.col(c).alias(f"b_{c}") for c in ("word", "n", "mask")])
    flips = F.col("a_mask").bitwiseXOR(F.col("b_mask"))
    same = [flips.bitwiseAND(F.lit(b)) == 0 for b in BAND]
    first_band = F.when(same[0], 0).when(same[1], 1).otherwise(2)
    cut = F.floor(F.col("len") / 2).cast("int")
    first_half = F.when(F.substring("a_word", F.lit(1), cut) == F.substring("b_word", F.lit(1), cut), 0).otherwise(1)
    longer = F.length("b_word") > F.length("a_word")
    fits = (longer | (F.col("a_word") < F.col("b_word"))) & (F.bit_count(flips) <= 2) & (F.col("band") == first_band) & (F.col("half") == first_half)
    # Spark knows the words' file, not the rows made of them: by its size they would be broadcast
    return left.join(right.hint("merge"), "key").where(fits & (F.levenshtein("a_word", "b_word", 1) == 1)).select(F.col("a_word").alias("a"), "a_n", F.col("b_word").alias("b"), "b_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words (word, form): forms followed to the last, twice as far in each round.

    A form occurs at least twice as often as its word, so there are no rings and few rounds.
    """
    found, moved = park(forms.select("word", F.col("form").alias("root")), "roots"), 1
    while moved:
        on = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        steps = park(found.join(on.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        moved, found = steps.where("moved").limit(1).count(), steps.select("word", "root")
    return found


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of the texts.

    form: the most frequent word one edit away, ties to the smallest, if it is at least twice as frequent; root: what
    forms lead to. Null and empty texts have no words; each row counts, repeated ones too; an empty table gives
    no rows; other columns are not read, whatever their names.
    """
    words = park(word_counts(docs, doc_id, text), "vocabulary")
    pairs = near_pairs(words).select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("m")))).alias("p")).select("p.*")
    near = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    rows = words.join(near.hint("merge"), "word", "left")
    own = F.when(-F.col("best.m") >= FACTOR * F.col("n"), F.col("best.other"))
    rows = park(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), own.alias("form"), F.when(own.isNotNull(), -F.col("best.m")).alias("form_n")), "forms")
    ends = roots(rows.where("form is not null"))
    return rows.join(ends.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of documents, with their spelling variants grouped. Nulls, empty tables and repeated rows as in `variants`."""
    return variants(table(spark, sf_dir, "documents"))

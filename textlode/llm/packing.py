"""Best-fit packing of tokenised documents into sequences of a fixed length.

Pieces are packed best-fit decreasing inside groups of bounded size. Bins that are nearly full
are final; the others become items, as long as what they hold, of the next round, in which they
meet the underfull bins of other groups. Rounds go on while there are several groups and the
last round joined bins. A bin's way up the tree is composed at the end, on bins only, and the
pieces take their sequence and offset from it in one join.

Only lengths travel: a piece is a few numbers, never its tokens.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import by_slices, kept, park, table
from .pretokens import WORD_PATTERN, is_latin, latin_splitter, vocabulary

CAPACITY = 4096
#: Pieces or bins in one group, and the room left in a bin that counts as nearly full.
GROUP, NEARLY = 50_000, 8


class WordEncoder:
    """Ids of whole texts by a vocabulary that parts words; memo: how many words are kept with their ids.

    Latin-1 texts are lower-cased and parted here and only unseen words go to the tokenizer; any
    other text, and one that may hold a special identifier's string, goes to it whole.
    """

    def __init__(self, path: str, memo: int = 1_000_000, longest: int = 64) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        # strings of the special identifiers, which the library looks for before it parts a text into words
        self.special = tuple({t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.split = latin_splitter(WORD_PATTERN).findall
        self.memo: dict[str, bytes] = {}
        self.size, self.longest = memo, longest

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Put unseen words into the memo; long ones, which are rare and would make its bound in bytes moot, are returned instead."""
        new = words.difference(self.memo)
        if len(self.memo) + len(new) > self.size:
            self.memo.clear()
            new = words
        long = {w for w in new if len(w) > self.longest}
        new = list(new - long)
        for start in range(0, len(new), 5000):
            part = new[start : start + 5000]
            # each word is a pre-token of its own, so a line of them is parted just where they were joined
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids, owner = np.array(found.ids, "<u4"), np.array(found.word_ids)
            ends = np.append(np.flatnonzero(np.diff(owner)) + 1, len(ids))
            if len(ends) != len(part):
                raise ValueError("words and pre-tokens do not agree")
            data, at = ids.tobytes(), 0
            for w, end in zip(part, (4 * ends).tolist()):
                self.memo[w] = data[at:end]
                at = end
        return {w: self.plain(w) for w in long}

    def plain(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        parted = [self.split(x.lower()) if is_latin(x) and not any(t in x for t in self.special) else None for x in texts]
        seen: set[str] = set()
        for words in parted:
            seen.update(words or ())
        long = self.learn(seen)
        memo, out = self.memo, []
        for x, words in zip(texts, parted):
            if words is None:
                out.append(self.plain(x))
                continue
            try:
                out.append(b"".join(map(memo.__getitem__, words)))
            except KeyError:
                out.append(b"".join([memo[w] if w in memo else long[w] for w in words]))
        return out


def word_encoder(path: str) -> WordEncoder:
    return kept(("words", path), lambda: WordEncoder(path))


def tokenised_pieces(df: DataFrame, key: str, text: str, path: str, end: int, capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, start, length, ids_crc32) of every document: its ids, then `end`, cut only if longer than capacity. Null texts are empty."""
    kind = df.schema[key].dataType.simpleString()
    tail, step = array("I", [end]).tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_slices(batches):
            encode = word_encoder(path).encode
            keys, rows = batch.column("k"), []
            for i, ids in enumerate(encode([x or "" for x in batch.column("t").to_pylist()])):
                ids += tail
                rows += [(i, n, at // 4, min(step, len(ids) - at) // 4, zlib.crc32(ids[at : at + step])) for n, at in enumerate(range(0, len(ids), step))]
            place, *columns = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(place, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64())))], names=[key, "piece", "start", "length", "ids_crc32"])

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item, largest item first, and the fill of each bin.

    An item goes to the open bin with the least room that still holds it. Bit r of `open_rooms` says
    that a bin with room r is open, so that bin is found with one shift and one find-first-set.
    """
    bins, offsets, fills = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = open_rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms ^= 1 << room
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        room -= size
        if room:
            by_room[room].append(b)
            open_rooms |= 1 << room
    return bins, offsets, np.array(fills, np.int64)


def pack_round(items: DataFrame, groups: int, level: int, capacity: int) -> DataFrame:
    """(item, bin, offset, fill): each item's bin, and how full that is in the end. items: item, length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        got = pa.Table.from_batches(rows).sort_by([("length", "descending"), ("item", "ascending")])  # rows reach a task in any order
        bins, offsets, fills = best_fit(got.column("length").to_numpy(), capacity)
        base = (level << 56) | (TaskContext.get().partitionId() << 24)  # a group has fewer bins than 2 ** 24
        out = pa.table({"item": got.column("item"), "bin": bins + base, "offset": offsets, "fill": fills[bins]})
        yield from out.to_batches(max_chunksize=100_000)

    dealt = items.select("item", "length").repartition(groups, F.xxhash64(F.lit(level), "item"))
    return dealt.mapInArrow(run, "item long, bin long, offset long, fill long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP, nearly: int = NEARLY) -> DataFrame:
    """pieces with sequence_id and offset. pieces has a column length (1 to capacity); its other columns stay, those two are replaced.

    Sequence ids are any numbers; places in a sequence are gapless from 0. Every piece is packed, repeated rows each for itself; an empty table
    stays empty. A length beyond the capacity or under 1 is an error.
    """
    bad = (F.col("length") < 1) | (F.col("length") > capacity) | F.col("length").isNull()
    checked = pieces.drop("sequence_id", "offset").withColumn("length", F.when(bad, F.raise_error(F.lit("length out of range"))).otherwise(F.col("length").cast("long")))
    rows = park(checked.withColumn("_tl_item", F.monotonically_increasing_id()), "pieces")
    items, ways, level = rows.select(F.col("_tl_item").alias("item"), "length"), [], 0
    n = items.count()
    while n:
        groups = -(-n // group)
        done = park(pack_round(items, groups, level, capacity), "bins")
        ways.append(done)
        least = done.agg(F.min("fill")).first()[0]
        # a bin is final if it is nearly full, or if even the emptiest bin does not fit in it
        under = done.where((F.col("fill") < capacity - nearly) & (F.col("fill") + least <= capacity)).select(F.col("bin").alias("item"), F.col("fill").alias("length")).distinct()
        left = under.count()
        if groups == 1 or left < 2 or left >= n:
            break
        items, n, level = under, left, level + 1
    if not ways:
        return rows.drop("_tl_item").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    # from the top down: where a bin of each level ends up
    top = None
    for done in reversed(ways[1:]):
        step = done.select(F.col("item"), F.col("bin").alias("_to"), F.col("offset").alias("_shift"))
        if top is not None:
            step = step.join(top, step["_to"] == top["_from"], "left").select("item", F.coalesce("_last", "_to").alias("_to"), (F.col("_shift") + F.coalesce("_more", F.lit(0))).alias("_shift"))
        top = step.select(F.col("item").alias("_from"), F.col("_to").alias("_last"), F.col("_shift").alias("_more"))
    base = ways[0].select(F.col("item").alias("_tl_item"), F.col("bin").alias("_bin"), F.col("offset").alias("_off"))
    if top is not None:
        base = base.join(top, base["_bin"] == top["_from"], "left").select("_tl_item", F.coalesce("_last", "_bin").alias("_bin"), (F.col("_off") + F.coalesce("_more", F.lit(0))).alias("_off"))
    return rows.join(base.withColumnsRenamed({"_bin": "sequence_id", "_off": "offset"}), "_tl_item").drop("_tl_item")


def pack_documents(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents with their places. A null text is a piece of the end identifier alone."""
    # fixed value: the identifier after each document
    found = pack(tokenised_pieces(df, key, text, vocabulary("word_bpe_49k.json"), end=1))
    return found.select(key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens. A null or empty text is the end identifier alone; repeated rows are packed each; an empty table gives no rows."""
    return pack_documents(table(spark, sf_dir, "documents"))

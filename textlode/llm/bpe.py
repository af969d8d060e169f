"""Byte-level BPE by a rank queue, and its decoding.

A pre-token is a doubly linked list of byte runs. Every adjacent pair with a merge rank lies
in the bucket of that rank; a hierarchical bitmap over the ranks says which buckets hold
entries, so the next rank is found with three find-first-set steps whatever the length.
Merging changes two neighbours; their old entries stay behind and are skipped when popped.
The cost of a pre-token of n bytes is near n log n, where rescanning would take n * n.
Many pre-tokens share one queue, so that a bucket is made and dropped once for all of them.

Pre-tokens repeat, so each worker keeps the ids of those it has met in a bounded memo. Texts
do not influence each other, and nothing is exchanged between tasks.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slices, kept, table
from .pretokens import pieces, ranks, vocabulary

#: Stands between pre-tokens: a byte that no UTF-8 text has.
PART = b"\xff"
#: Bytes of pre-tokens that are merged together, and of texts whose pre-tokens are looked up together.
CHUNK, SLICE = 1 << 18, 1 << 20


class RankQueue:
    """Positions by merge rank. Three levels of 64-bit words hold which ranks have entries: 64 ** 3 ranks and one top integer."""

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.levels: tuple[dict[int, int], dict[int, int]] = ({}, {})
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        if rank in self.buckets:
            self.buckets[rank].append(position)
        else:
            self.fill(rank, [position])

    def fill(self, rank: int, positions: list[int]) -> None:
        """Positions of a rank that has no entries."""
        self.buckets[rank] = positions
        low, mid = self.levels
        a, b = rank >> 6, rank >> 12
        low[a] = low.get(a, 0) | 1 << (rank & 63)
        mid[b] = mid.get(b, 0) | 1 << (a & 63)
        self.top |= 1 << b

    def lowest(self) -> int | None:
        """The lowest rank that has entries."""
        if not self.top:
            return None
        low, mid = self.levels
        b = (self.top & -self.top).bit_length() - 1
        word = mid[b]
        a = b << 6 | (word & -word).bit_length() - 1
        word = low[a]
        return a << 6 | (word & -word).bit_length() - 1

    def drop(self, rank: int) -> None:
        """A rank whose entries are used up."""
        del self.buckets[rank]
        low, mid = self.levels
        a, b = rank >> 6, rank >> 12
        low[a] &= ~(1 << (rank & 63))
        if not low[a]:
            del low[a]
            mid[b] &= ~(1 << (a & 63))
            if not mid[b]:
                del mid[b]
                self.top &= ~(1 << b)

    def pop(self) -> tuple[int, int] | None:
        """The lowest rank that has entries, and its leftmost position."""
        rank = self.lowest()
        if rank is None:
            return None
        bucket = self.buckets[rank]
        bucket.sort(reverse=True)
        position = bucket.pop()
        if not bucket:
            self.drop(rank)
        return rank, position


def pair_ranks(rank_of: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of single bytes (-2 for PART, -3 for one that has none), and ranks of pairs of bytes (-1: none)."""
    single, double = np.full(256, -3, np.int32), np.full(1 << 16, -1, np.int32)
    for x, rank in rank_of.items():
        if len(x) == 1:
            single[x[0]] = rank
        elif len(x) == 2:
            double[x[0] << 8 | x[1]] = rank
    single[PART[0]] = -2
    return single, double


def merge(pieces: list[bytes], rank_of: dict[bytes, int], single: np.ndarray, double: np.ndarray) -> list[bytes]:
    """The ids of pre-tokens, as little-endian unsigned 32-bit integers: in each the lowest rank first, and of equal ranks the leftmost.

    All stand in one row with PART around each, which no run with a rank holds, and share one queue.
    """
    whole = PART + PART.join(pieces) + PART
    n = len(whole)
    signs = np.frombuffer(whole, np.uint8)
    first = double[signs[:-1].astype(np.int64) << 8 | signs[1:]]
    at = np.flatnonzero(first >= 0)
    at = at[np.argsort(first[at], kind="stable")]
    kinds, starts = np.unique(first[at], return_index=True)
    queue = RankQueue()
    for rank, positions in zip(kinds.tolist(), np.split(at, starts[1:]), strict=True) if len(at) else ():
        queue.fill(rank, positions.tolist())
    now = [*first.tolist(), -1]  # rank that the pair starting here has now
    token = single[signs].tolist()  # of the run that starts here; -1: no run starts here any more, -2: PART
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get, buckets = rank_of.get, queue.buckets
    while (rank := queue.lowest()) is not None:
        bucket, lowest = buckets[rank], rank
        bucket.sort(reverse=True)
        while bucket and lowest == rank:  # what is merged here makes longer runs, so nothing of this rank is added meanwhile
            i = bucket.pop()
            if now[i] != rank:
                continue  # stale: a neighbour was merged since
            j = end[i]
            k = end[j]
            end[i], before[k], token[i] = k, i, rank
            now[j] = token[j] = -1
            now[i] = other = get(whole[i : end[k]], -1)
            if other >= 0:
                if other in buckets:
                    buckets[other].append(i)
                else:
                    queue.fill(other, [i])
                if other < lowest:
                    lowest = other
            h = before[i]
            now[h] = other = get(whole[h:k], -1)
            if other >= 0:
                if other in buckets:
                    buckets[other].append(h)
                else:
                    queue.fill(other, [h])
                if other < lowest:
                    lowest = other
        if not bucket:
            queue.drop(rank)
    ids = np.array(token, np.int32)
    ids = ids[ids != -1]
    if (ids < -2).any():
        raise KeyError("a byte that has no id")
    cuts = np.flatnonzero(ids == -2)
    made = ids.astype("<u4").tobytes()
    return [made[4 * a + 4 : 4 * b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


class Encoder:
    """Whole texts to ids and back. memo: how many pre-tokens are kept with their ids."""

    def __init__(self, path: str, pattern: str, memo: int = 1_000_000, longest: int = 64) -> None:
        self.token, self.split = {rank: token for token, rank in ranks(path).items()}, pieces(pattern)
        self.rank_of = {x: rank for x, rank in ranks(path).items() if len(x) == 1 or PART not in x}  # others are in no text
        self.pairs = pair_ranks(self.rank_of)
        self.memo: dict[str, bytes] = {}
        self.size, self.longest = memo, longest

    def learn(self, pieces: set[str]) -> None:
        """Put pre-tokens into the memo: those with a rank of their own, and others merged, as many at a time as CHUNK bytes hold, or one."""
        names, spelt, size = [], [], 0
        for piece in pieces:
            x = piece.encode()
            if (rank := self.rank_of.get(x)) is not None:
                self.memo[piece] = array("I", [rank]).tobytes()
                continue
            if size and size + len(x) > CHUNK:
                self.memo.update(zip(names, merge(spelt, self.rank_of, *self.pairs), strict=True))
                names, spelt, size = [], [], 0
            names.append(piece)
            spelt.append(x)
            size += len(x)
        self.memo.update(zip(names, merge(spelt, self.rank_of, *self.pairs) if names else [], strict=True))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers. Pre-tokens of all texts that are not known are merged together."""
        words = [self.split(x) for x in texts]
        if new := set().union(*words).difference(self.memo):
            self.learn(new)
        made = [b"".join(map(self.memo.__getitem__, x)) for x in words]
        if len(self.memo) > self.size:
            self.memo.clear()
        else:  # long ones are rare and would make the memo's bound in bytes moot
            for piece in new:
                if len(piece) > self.longest:
                    del self.memo[piece]
        return made

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, array("I", ids)))


def encoder(path: str, pattern: str) -> Encoder:
    return kept(("bpe", path, pattern), lambda: Encoder(path, pattern))


def encode_table(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with one more column: the ids (binary, little-endian unsigned 32-bit). A null text is empty: no ids. A column named like it is replaced."""
    names = [c for c in df.columns if c != ids]

    def run(batches):
        encode_all = encoder(path, pattern).encode_all
        for batch in by_slices(batches, size=SLICE):
            made = encode_all([x or "" for x in batch.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(made, pa.binary())], names=[*names, ids])

    types = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)
    return df.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, f"{types}, `{ids}` binary")


def decode_table(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded", pattern: str = "") -> DataFrame:
    """df with one more column: the bytes (binary) that the ids stand for. Null ids stay null; an id outside the vocabulary is an error.

    With the pattern that encoded them, workers that do both keep one table.
    """
    names = [c for c in df.columns if c != out]

    def run(batches):
        decode = encoder(path, pattern).decode
        for batch in by_slices(batches):
            made = [None if x is None else decode(x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(made, pa.binary())], names=[*names, out])

    types = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)
    return df.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, f"{types}, `{out}` binary")


def op6_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document's text encoded and decoded again; the digests are of the ids and of the decoded bytes."""
    import public_tokenizers

    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = encode_table(docs, path, public_tokenizers.PATTERN).drop("text")
    digests = encoded.select("doc_id", "ids", F.octet_length("ids").alias("n"), F.sha2("ids", 256).alias("ids_sha256"))
    return decode_table(digests, path, pattern=public_tokenizers.PATTERN).select("doc_id", (F.col("n") / 4).cast("long").alias("n_tokens"), "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))

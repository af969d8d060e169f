"""N-gram Jaccard join by chosen paths.

A document is its set of five-word shingles. In each run, sets are split recursively: at a node a
few tokens of a set are drawn by a hash that depends on the path so far, and the set goes down with
each of them, so two sets meet where both hold the same drawn tokens. Similar sets keep meeting,
others part within a level or two. A node that is small enough is compared by brute force; a larger
one is split on. Runs are repeated until a pair at the threshold is met with the target recall,
worked out from the branching.

A family of near copies does not part on tokens that its members share. A node that is still large at
the last level is therefore split around pivots: its members are compared with one pivot, those linked
to it are represented by it, and the others meet again by what they differ in from it (see `split`).
Work and rows grow with the members of a node, not with its pairs.

Sets that are equal form a class, represented once. Met pairs of small nodes are screened by their
smallest hashes and then verified on whole sets; nodes that hold the same members are compared once.
Links leave their node as (member, representative), never as all pairs; components are joined by
alternating stars. On request each member of a class is given a representative that it is linked to, with their
exact similarity (see `represented`), and the number of all its links, counted exactly inside its class (see `link_counts`).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_slices, forget, kept, park, table

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.99
#: Tokens drawn at a node on average (one over the threshold keeps a pair at it alive), and levels.
DRAWN, LEVELS = 1.25, 3
#: Members of a node that is compared as it is, before the last level and from it on; those of a larger one that may become its pivot.
LEAF, LAST_LEAF, CANDIDATES = 64, 2048, 32
#: Shingles of all members of a node that is compared as it is (32 MB); one with more is split on, however few its members.
LEAF_TOKENS = 4_000_000
#: Members of a class that may become representatives in one round.
HEADS = 32
#: Similarity to the pivot from which a member that is not linked to it may be linked to one that is, and from which it
#: may be linked to such a member (by the triangle inequality of Jaccard distances); and the band keys of a difference.
NEAR, FAR, BANDS = 0.6, 0.4, 24
#: Members of a block of a class whose links are counted, and their shingles: two blocks meet in a task.
LINK_BLOCK, LINK_TOKENS = 1024, 1_000_000
#: Smallest hashes kept of a set for the screen, and the share of them that a pair must have in common.
SCREEN, SCREEN_SHARE = 32, 0.5
#: Tables up to this size, by rows and bytes of a row, are broadcast.
BROADCAST_BYTES = 16_000_000
M1, M2, BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x100000001B3)


def runs_for(recall: float = RECALL, threshold: float = THRESHOLD) -> int:
    """Runs after which a pair at the threshold has met at the last level with the recall."""
    alive, shared = 1.0, DRAWN * threshold
    for _ in range(LEVELS):
        alive = 1 - exp(-shared * alive)
    runs, missed = 1, 1 - alive
    while missed > 1 - recall:
        runs, missed = runs + 1, missed * (1 - alive)
    return runs


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * M1
    x = (x ^ (x >> np.uint64(29))) * M2
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sets of shingle hashes; memo: how many words are kept with theirs."""

    def __init__(self, memo: int = 200_000) -> None:
        self.memo: dict[str, int] = {}
        self.size = memo

    def word(self, w: str) -> int:
        if len(self.memo) >= self.size:
            self.memo.clear()
        found = xxhash.xxh64_intdigest(w)
        if len(w) <= 64:
            self.memo[w] = found
        return found

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of the shingles of five lower-case words; a shorter text is one shingle, one without words has none."""
        words = (text or "").lower().split()
        get, word = self.memo.get, self.word
        h = np.array([get(w) or word(w) for w in words], np.uint64)
        if not len(h):
            return h
        n = max(1, len(h) - WORDS + 1)
        out = np.full(n, min(len(h), WORDS), np.uint64)
        for k in range(min(len(h), WORDS)):
            out = out * BASE + mix(h[k : k + n] + np.uint64(k))
        return np.unique(mix(out))


def draw(tokens: np.ndarray, nodes: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """(place of node, key of child) for the tokens drawn at each node."""
    if not len(nodes) or not len(tokens):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = (tokens[None, :] ^ nodes[:, None]) * M1
    h ^= h >> np.uint64(32)
    h *= M2
    if share >= 1:
        i, j = np.divmod(np.arange(h.size), len(tokens))
    else:
        i, j = np.nonzero(h < np.uint64(share * 2.0**64))
    return i, mix(nodes[i] * BASE ^ tokens[j])


def paths(tokens: np.ndarray, runs: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level (place of the parent in the level above, key) of a set's paths; the first level's parents are the runs' roots."""
    share = DRAWN / max(1, len(tokens))
    nodes, out = mix(np.arange(1, runs + 1, dtype=np.uint64)), []
    for _ in range(LEVELS):
        i, keys = draw(tokens, nodes, share)
        keys, first = np.unique(keys, return_index=True)
        out.append((i[first], keys))
        nodes = keys
    return out


def shingler() -> Shingler:
    return kept(("shingles",), Shingler)


def lists(arrays: list[np.ndarray], kind=np.int64) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    values = np.concatenate(arrays) if ends[-1] else np.zeros(0, kind)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.view(kind) if values.itemsize == np.dtype(kind).itemsize else values.astype(kind)))


def screen_of(tokens: np.ndarray) -> np.ndarray:
    """The smallest hashes, by their upper halves."""
    return (tokens[:SCREEN] >> np.uint64(32)).astype(np.uint32)


def sketched(rows: DataFrame, runs: int) -> DataFrame:
    """(row, doc, th, set_key, size, screen, keys_1, ..., parents_2, ...) of each text; set_key is null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in by_slices(batches):
                sets = [shingler().shingles(x) for x in batch.column("text").to_pylist()]
                made = [paths(x, runs) for x in sets]
                columns = [pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int32()), lists([screen_of(x) for x in sets], np.int32)]
                columns += [lists([m[level][1] for m in made]) for level in range(LEVELS)] + [lists([m[level][0] for m in made], np.int16) for level in range(1, LEVELS)]
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc"), batch.column("th"), *columns], names=["row", "doc", "th", "set_key", "size", "screen", *LEVEL_COLUMNS])

    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(run, f"row long, doc {kind}, th long, set_key binary, size int, screen array<int>, " + ", ".join(f"{c} array<{'long' if c.startswith('keys') else 'short'}>" for c in LEVEL_COLUMNS))


LEVEL_COLUMNS = [f"keys_{level}" for level in range(1, LEVELS + 1)] + [f"parents_{level}" for level in range(2, LEVELS + 1)]


def few(df: DataFrame, row_bytes: int = 24) -> DataFrame:
    """A written table, to be broadcast if its rows, of row_bytes each at most, are small together."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def counted(nodes: DataFrame) -> DataFrame:
    """(key, n, sign, opens) of nodes with something to compare: two members or more, one of them open."""
    counts = nodes.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("sign"), F.sum(F.col("open").cast("long")).alias("opens"), F.sum("size").alias("tokens"))
    return park(counts.where("n >= 2 and opens >= 1").select("key", "n", "sign", "tokens"), "counts")


def small_node(members: int):
    """Whether a counted node is compared as it is: by its members and by what their sets hold together."""
    return (F.col("n") <= members) & (F.col("tokens") <= LEAF_TOKENS)


def parted(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The small nodes (key, n, sign, id) and the large ones (key, id, open, size). Large ones with the same members are one."""
    counts = counted(nodes)
    small = park(nodes.join(few(counts.where(small_node(LAST_LEAF)).drop("tokens")), "key").select("key", "n", "sign", "id"), "leaves")
    keys = park(counts.where(~small_node(LAST_LEAF)).groupBy("n", "sign").agg(F.min("key").alias("key")).select("key"), "large")
    return small, park(nodes.join(few(keys), "key").select("key", "id", "open", "size"), "nodes")


def buckets(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves (key, n, sign, id) of all levels, and the nodes (key, id, open, size) that are large at the last."""
    leaves, large = None, None
    for level in range(1, LEVELS + 1):
        keys = F.col(f"keys_{level}")
        if large is None:
            nodes = classes.select("id", "size", F.explode(keys).alias("key"))
        else:
            above = F.transform(f"parents_{level}", lambda i: F.get(f"keys_{level - 1}", i.cast("int")))
            nodes = classes.select("id", "size", F.explode(F.arrays_zip(above.alias("p"), keys.alias("k"))).alias("x")).select("id", "size", F.col("x.p").alias("p"), F.col("x.k").alias("key"))
            nodes = park(nodes.join(few(large.withColumnRenamed("key", "p")), "p", "left_semi").select("key", "id", "size").distinct(), "nodes")
        nodes = nodes.withColumn("open", F.lit(True))
        if level == LEVELS:
            found, rest = parted(nodes)
            return (found if leaves is None else leaves.unionByName(found)), rest
        counts = counted(nodes)
        found = park(nodes.join(few(counts.where(small_node(LEAF)).drop("tokens")), "key").select("key", "n", "sign", "id"), "leaves")
        leaves = found if leaves is None else leaves.unionByName(found)
        large = counts.where(~small_node(LEAF)).select("key")
        if large.isEmpty():
            break
    return leaves, nodes.limit(0)


def once(leaves: DataFrame) -> DataFrame:
    """(key, id) of leaves; leaves that hold the same members are one."""
    keys = park(leaves.select("key", "n", "sign").distinct().groupBy("n", "sign").agg(F.min("key").alias("key")).select("key"), "keys")
    return leaves.select("key", "id").distinct().join(few(keys), "key")


def pivots(large: DataFrame, screens: DataFrame) -> DataFrame:
    """(key, pivot): of a node's open members with the smallest digests the first that is near nearly as many of them as any.

    Digests are of content, so nodes that hold the same family mostly have the same pivot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, chosen = [], []
            for key, found in zip(batch.column("key").to_pylist(), batch.column("found").to_pylist()):
                sets = [set(x["screen"]) for x in found]
                near = [sum(len(a & b) >= 0.6 * max(len(a), len(b)) for b in sets) for a in sets]
                best = next(i for i, n in enumerate(near) if n >= 0.8 * max(near))
                keys.append(key)
                chosen.append(found[best]["id"])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(chosen, pa.int64())], names=["key", "pivot"])

    first = Window.partitionBy("key").orderBy("digest", "id")
    drawn = large.where("open").join(screens, "id").withColumn("place", F.row_number().over(first)).where(F.col("place") <= CANDIDATES)
    listed = drawn.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("digest", "id", "screen"))).alias("found"))  # CANDIDATES at most
    return listed.mapInArrow(run, "key long, pivot long")


def band_keys(differ: np.ndarray, pivot: int, turn: int) -> np.ndarray:
    """Keys of what a member differs in from its pivot. In the first turn each is of two smallest hashes of the difference,
    by orders of their own; in later ones, where a node has been split by such keys already, there are two keys of one hash each."""
    bands = BANDS if turn == 1 else 2
    salts = mix(np.arange(1, 2 * bands + 1, dtype=np.uint64) + np.uint64(1000 * turn))
    least = mix(differ[None, :] ^ salts[:, None]).min(1)
    keys = least[:bands] * BASE ^ salts[:bands] ^ mix(np.array([pivot], np.int64).view(np.uint64))
    return mix(keys ^ least[bands:]) if turn == 1 else mix(keys)


def against_pivots(pairs: DataFrame, turn: int) -> DataFrame:
    """(id, pivot, open, size, linked, near, keys) of pairs (id, pivot, open, tokens, other): the exact comparison, and band keys where a link past the pivot is possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in by_slices(batches):
                linked, near, keys, size = [], [], [], []
                for pivot, a, b in zip(batch.column("pivot").to_pylist(), batch.column("tokens"), batch.column("other")):
                    a, b = (x.values.to_numpy().view(np.uint64) for x in (a, b))
                    differ = np.setxor1d(a, b, assume_unique=True)
                    either = (len(a) + len(b) + len(differ)) // 2
                    share = (either - len(differ)) / either
                    size.append(len(a))
                    linked.append(share >= THRESHOLD - 1e-9)
                    near.append(share >= NEAR)
                    keys.append(band_keys(differ, pivot, turn) if FAR <= share and len(differ) else differ[:0])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "pivot", "open")), pa.array(size, pa.int32()), pa.array(linked, pa.bool_()), pa.array(near, pa.bool_()), lists(keys)], names=["id", "pivot", "open", "size", "linked", "near", "keys"])

    return pairs.select("id", "pivot", "open", "tokens", "other").mapInArrow(run, "id long, pivot long, open boolean, size int, linked boolean, near boolean, keys array<long>")


def split(large: DataFrame, members: DataFrame, rows: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """(leaves, links): large nodes split until their parts are small.

    Each round compares all members of a node with one pivot, exactly. Members linked to it are settled: links among
    them tell nothing new. A link of any other member to a settled one needs that both differ from the pivot in the
    same shingles, since otherwise both would be linked to it: so members that are near enough to have such links meet
    again by band keys of their differences. Members far from the pivot go on by the smallest hashes of their own
    screens, twice. A round after the first makes two rows at most of a node's row, and its parts are much smaller; a
    pivot is open no more, so rounds end.
    """
    leaves, links, turn = None, None, 0
    while not large.isEmpty():
        turn += 1
        chosen = park(pivots(large, members.select("id", "digest", "screen")), "pivots")
        asked = park(large.join(few(chosen), "key").select("key", "id", "open", "size", "pivot"), "asked")
        pairs = asked.where("id <> pivot").groupBy("id", "pivot").agg(F.max("open").alias("open"))
        ids = asked.select("id").unionByName(chosen.select(F.col("pivot").alias("id"))).distinct()
        sets = park(sets_of(rows, members, ids), "sets")
        other = park(sets.join(few(chosen.select(F.col("pivot").alias("id")).distinct()), "id", "left_semi").select(F.col("id").alias("pivot"), F.col("tokens").alias("other")), "others")
        wide = other.agg(F.max(F.size("other"))).first()[0] or 0
        met = park(against_pivots(pairs.join(sets, "id").join(few(other, 8 * wide + 24), "pivot"), turn), "met")
        found = met.where("linked").select(F.col("id").alias("a"), F.col("pivot").alias("b"))
        links = found if links is None else links.unionByName(found)
        # linked members are settled, those between are open, those far off go on by their own hashes
        banded = met.select("id", "pivot", "size", (F.col("open") & F.col("near") & ~F.col("linked")).alias("open"), F.explode("keys").alias("key"))
        if turn > 1:  # a part of its node; in the first turn nodes with one pivot are of one family and split alike
            banded = banded.join(asked.select("id", "pivot", F.col("key").alias("above")), ["id", "pivot"]).withColumn("key", F.xxhash64("above", "key"))
        banded = banded.select("id", "open", "size", "key")
        far = asked.where("open and id <> pivot").join(met.select("id", "pivot", "near"), ["id", "pivot"]).where("not near").select("key", "id", "size")
        salts = F.explode(F.array(F.lit(2 * turn), F.lit(2 * turn + 1))).alias("salt")
        least = F.array_min(F.transform("screen", lambda x: F.xxhash64(x, "salt")))
        own = far.join(members.select("id", "screen"), "id").select("key", "id", "size", "screen", salts).select(F.xxhash64("key", "salt", least).alias("key"), "id", "size", F.lit(True).alias("open"))
        # a member may come to a key as open and as settled: open counts
        nodes = park(banded.unionByName(own).groupBy("key", "id").agg(F.max("open").alias("open"), F.max("size").alias("size")), "nodes")
        small, large = parted(nodes)
        leaves = small if leaves is None else leaves.unionByName(small)
    return leaves, links


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that hold whole groups of equal key, from batches in their order."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = now if rest is None else pa.concat_tables([rest, now])
        key = now.column("key").to_numpy()
        edge = np.flatnonzero(key[1:] != key[:-1])
        if len(edge):
            yield now.slice(0, int(edge[-1]) + 1)
            rest = now.slice(int(edge[-1]) + 1)
        else:
            rest = now
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def bounds(got: pa.Table) -> np.ndarray:
    key = got.column("key").to_numpy()
    return np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, got.num_rows]


def padded(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists as rows of a matrix; places without an entry hold numbers that equal nothing in another row, if not by chance."""
    column = column.combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
    lengths = np.diff(offsets)
    out = -1 - np.arange(len(lengths) * width, dtype=np.int64).reshape(len(lengths), width)
    at = np.arange(width) < lengths[:, None]
    out[at] = values[offsets[0] : offsets[-1]]
    return out


def in_order(df: DataFrame) -> DataFrame:
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key", "id")


def screened(members: DataFrame) -> DataFrame:
    """(key, id) of members that some other member of their leaf may be near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for got in groups(batches):
            ends = bounds(got)
            keys, ids, sizes = (got.column(c).to_numpy() for c in ("key", "id", "size"))
            sizes_of = np.diff(ends)
            keep = np.zeros(len(keys), bool)
            # large nodes by a product each, small ones together, pair by pair
            for a, b in zip(ends[:-1][sizes_of > LEAF].tolist(), ends[1:][sizes_of > LEAF].tolist()):
                n = sizes[a:b]
                same = common_counts([x.values.to_numpy() for x in got.column("screen").slice(a, b - a)])
                np.fill_diagonal(same, -1)
                for at in row_blocks(b - a):
                    least, most = np.minimum(n[at, None], n[None, :]), np.maximum(n[at, None], n[None, :])
                    keep[a:b][at] = ((least >= THRESHOLD * most) & (same[at] >= SCREEN_SHARE * np.minimum(SCREEN, most))).any(1)
                del same
            left = np.repeat(np.where(sizes_of > LEAF, ends[:-1], ends[1:]), sizes_of) - np.arange(len(keys)) - 1  # members after this one
            screen = padded(got.column("screen"), SCREEN)
            for lag in range(1, int(left.max(initial=0)) + 1):
                every = np.flatnonzero(left >= lag)
                small, large = np.minimum(sizes[every], sizes[every + lag]), np.maximum(sizes[every], sizes[every + lag])
                every = every[small >= THRESHOLD * large]
                for start in range(0, len(every), 4000):
                    i = every[start : start + 4000]
                    j = i + lag
                    same = (screen[i][:, :, None] == screen[j][:, None, :]).sum((1, 2))
                    near = same >= SCREEN_SHARE * np.minimum(SCREEN, np.maximum(sizes[i], sizes[j]))
                    keep[i[near]] = keep[j[near]] = True
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(ids[keep])], names=["key", "id"])

    return in_order(members.select("key", "id", "size", "screen")).mapInArrow(run, "key long, id long")


def common_counts(sets: list[np.ndarray], cells: int = 2_000_000) -> np.ndarray:
    """Sizes of all intersections of different sets, as products of incidence matrices of at most `cells` cells."""
    owner = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    _, place, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often > 1  # others add to no intersection
    some = np.flatnonzero(shared[place])
    column = (np.cumsum(shared) - 1)[place[some]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[some[order]], column[order]
    out, step = np.zeros((len(sets), len(sets)), np.float32), max(1, min(int(shared.sum()), cells // len(sets)))
    for start in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(column, [start, start + step])
        matrix = np.zeros((len(sets), step), np.float32)
        matrix[owner[a:b], column[a:b] - start] = 1
        out += matrix @ matrix.T
    return out


def row_blocks(n: int, size: int = 256) -> list[slice]:
    return [slice(i, i + size) for i in range(0, n, size)]


def verified(members: DataFrame) -> DataFrame:
    """(a, b): for each member of a leaf that is linked there, the smallest id of its local component. Sets are compared whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for got in groups(batches):
            ids = got.column("id").to_numpy()
            sets = [x.values.to_numpy() for x in got.column("tokens")]
            out: list[tuple[int, int]] = []
            for a, b in zip((ends := bounds(got))[:-1], ends[1:]):
                n = np.array([len(x) for x in sets[a:b]])
                counts = common_counts(sets[a:b])
                ok = np.zeros(counts.shape, bool)
                for at in row_blocks(b - a):
                    ok[at] = counts[at] >= THRESHOLD * (n[at, None] + n[None, :] - counts[at].astype(float)) - 1e-9
                del counts
                # members are in the order of their ids: labels fall to the smallest place of each component
                label = np.arange(b - a)
                while True:
                    lower = np.minimum(label, np.concatenate([np.where(ok[at], label[None, :], b - a).min(1) for at in row_blocks(b - a)]))
                    if (lower == label).all():
                        break
                    label = lower
                some = np.flatnonzero(label != np.arange(b - a))
                out += zip(ids[a + some].tolist(), ids[a + label[some]].tolist())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["a", "b"])

    return in_order(members.select("key", "id", "tokens")).mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node of edges (a, b): the smallest id of its component. Alternating stars, each round written."""
    now = park(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # larger neighbours to the smallest
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # smaller neighbours, and the node itself, to the smallest
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = park(small.where("a <> b").distinct(), "edges")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct())


def sets_of(rows: DataFrame, members: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, tokens) of members, from the texts again: sets are not stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in by_slices(batches):
                yield pa.RecordBatch.from_arrays([batch.column("id"), lists([shingler().shingles(x) for x in batch.column("text").to_pylist()])], names=["id", "tokens"])

    wanted = few(park(members.join(ids, "id", "left_semi").select(F.col("doc").alias("wdoc"), F.col("th").alias("wth"), "id"), "wanted"), 40)
    texts = rows.join(wanted, rows["doc"].eqNullSafe(wanted["wdoc"]) & (rows["th"] == wanted["wth"])).select("id", "text")
    return texts.dropDuplicates(["id"]).mapInArrow(run, "id long, tokens array<long>")  # repeated rows have one text


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sets, not both empty."""
    differ = len(np.setxor1d(a, b, assume_unique=True))
    either = (len(a) + len(b) + differ) // 2
    return (either - differ) / either


def heads_of(drawn: DataFrame) -> DataFrame:
    """(root, heads, sets) from rows (root, place, id, tokens), HEADS a class at most: those without a link to an earlier one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, kept_sets = [], []
            for ids, sets in zip(batch.column("ids"), batch.column("sets")):
                tokens, heads = [x.values.to_numpy() for x in sets.values], []
                for i, a in enumerate(tokens):
                    if all(similarity(a, tokens[j]) < THRESHOLD - 1e-9 for j in heads):
                        heads.append(i)
                found.append(ids.values.to_numpy()[heads])
                kept_sets.append([tokens[i] for i in heads])
            yield pa.RecordBatch.from_arrays([batch.column("root"), pa.array(found, pa.list_(pa.int64())), pa.array(kept_sets, pa.list_(pa.list_(pa.int64())))], names=["root", "heads", "sets"])

    listed = drawn.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("place", "id", "tokens"))).alias("found"))  # bounded by members and shingles
    return listed.select("root", F.transform("found", lambda x: x["id"]).alias("ids"), F.transform("found", lambda x: x["tokens"]).alias("sets")).mapInArrow(run, "root long, heads array<long>, sets array<array<long>>")


def first_heads(asked: DataFrame) -> DataFrame:
    """(id, root, doc, th, size, rep, similarity) of rows (id, root, doc, th, size, tokens, heads, sets): the first head that is linked to a member, if any."""
    passed = ["id", "root", "doc", "th", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, shares = [], []
            for a, heads, sets in zip(batch.column("tokens"), batch.column("heads"), batch.column("sets")):
                a, heads, found = a.values.to_numpy(), heads.values.to_numpy(), (None, None)
                for i, b in enumerate(sets.values):
                    b = b.values.to_numpy()
                    if min(len(a), len(b)) < (THRESHOLD - 1e-9) * max(len(a), len(b)):
                        continue
                    if (share := similarity(a, b)) >= THRESHOLD - 1e-9:
                        found = int(heads[i]), share
                        break
                reps.append(found[0])
                shares.append(found[1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in passed), pa.array(reps, pa.int64()), pa.array(shares, pa.float64())], names=[*passed, "rep", "similarity"])

    kind = asked.schema["doc"].dataType.simpleString()
    return asked.select(*passed, "tokens", "heads", "sets").mapInArrow(run, f"id long, root long, doc {kind}, th long, size int, rep long, similarity double")


def represented(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, rep_doc, similarity) of nodes (id, root, doc, th, size): a representative that each member of a class is linked to.

    In the order of (doc, th), a member is a representative if it is linked to no earlier one; any other belongs
    to the first that it is linked to. A round takes the first HEADS members of each class, settles them among
    themselves in one task, and compares the others with the representatives found, each member with a bounded
    number of sets. So rounds are no more than a class has members by HEADS; a family around one text takes one or two.
    """
    done, left = None, nodes
    order = Window.partitionBy("root").orderBy("doc", "th", "id")
    while not left.isEmpty():
        block = left.withColumn("place", F.row_number().over(order)).where(F.col("place") <= HEADS)
        block = block.withColumn("upto", F.sum("size").over(order)).where((F.col("place") == 1) | (F.col("upto") <= LEAF_TOKENS))
        heads = park(heads_of(sets.join(few(park(block.select("id", "root", "place"), "block")), "id")), "heads")
        wide = heads.agg(F.max(F.size(F.flatten("sets")))).first()[0]
        asked = left.join(sets, "id").join(few(heads, 8 * wide + 8 * HEADS + 64), "root")
        met = park(first_heads(asked), "met")
        settled = met.where("rep is not null").select("id", "rep", "similarity")
        done = settled if done is None else done.unionByName(settled)
        left = met.where("rep is null").drop("rep", "similarity")
    if done is None:
        return nodes.select("id", F.col("doc").alias("rep_doc"), F.lit(1.0).alias("similarity"))
    return done.join(nodes.select(F.col("id").alias("rep"), F.col("doc").alias("rep_doc")), "rep").select("id", "rep_doc", "similarity")


def link_counts(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, n_links) of nodes (id, root, size, weight): how many documents have another set that is linked to it; weight: documents of a set.

    A link joins two members of one class, so the members of each class are compared with each other, all of them and
    exactly, whatever leaf or pivot they met at. A large class is dealt in blocks, and each two blocks meet in a
    group of their own; counts leave it, never pairs. A class makes one row of a member for each of its blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for got in groups(batches):
            ids, weights, own, other = (got.column(c).to_numpy() for c in ("id", "weight", "own", "other"))
            sets = [x.values.to_numpy() for x in got.column("tokens")]
            out = np.zeros(len(ids), np.int64)
            for a, b in zip((ends := bounds(got))[:-1], ends[1:]):
                n, counts = np.array([len(x) for x in sets[a:b]]), common_counts(sets[a:b])
                np.fill_diagonal(counts, -1)
                for at in row_blocks(b - a):
                    ok = counts[at] >= THRESHOLD * (n[at, None] + n[None, :] - counts[at].astype(float)) - 1e-9
                    # where two blocks meet, links inside one are counted in the group of that one
                    ok &= (own[a] == other[a]) | (own[a:b][at, None] != own[None, a:b])
                    out[a:b][at] = ok @ weights[a:b]
            some = np.flatnonzero(out)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(out[some])], names=["id", "n_links"])

    sizes = nodes.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("tokens"))
    blocks = F.ceil(F.greatest(F.col("n") / LINK_BLOCK, F.col("tokens") / LINK_TOKENS)).cast("int").alias("blocks")
    dealt = nodes.join(few(park(sizes.select("root", blocks), "sizes")), "root").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("key")
    rows = sets.join(dealt.select("id", "weight", "own", "other", key), "id").select("key", "id", "weight", "own", "other", "tokens")
    return in_order(rows).mapInArrow(run, "id long, n_links long").groupBy("id").agg(F.sum("n_links").alias("n_links"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", recall: float = RECALL, row: str | None = None, pairs: bool = False) -> DataFrame:
    """(row, doc, th, class_row, n_copies), one row for each of df: its near-duplicate class, and how many other rows have an equal set.

    With `pairs` also (n_links, rep_doc, similarity): how many documents with another set it is linked to, and a document that it is linked to, and their exact similarity. Sets are
    taken in the order of their smallest (doc, th); a set that is linked to no earlier representative is one, and
    its documents have the smallest doc of theirs, with 1.0. A document alone in its class has itself.

    Two documents are linked if the Jaccard similarity of their shingle sets is 0.8 or more. A class is
    a connected component, named by the smallest row number in it; row numbers follow the table's order.
    th is a digest of the text. Texts without words, all alike, are equal to each other and near nothing
    else; a null text is alone. Repeated rows are documents of their own; a text of any length is read
    whole. An empty table gives an empty one. Other columns are not carried, whatever their names. `row`
    names a column of unique row numbers if df has one.
    """
    numbers = F.col(row).cast("long") if row else F.monotonically_increasing_id()
    digest = F.when(F.col(text).isNotNull(), F.xxhash64(F.col(text)))
    rows = df.select(F.col(key).alias("doc"), F.col(text).alias("text"), digest.alias("th"))
    docs = park(sketched(df.select(F.col(key).alias("doc"), F.col(text).alias("text"), digest.alias("th"), numbers.alias("row")), runs_for(recall)), "sketches")
    named = docs.where("th is not null").withColumn("set_key", F.coalesce("set_key", F.lit(b"").cast("binary")))
    first = [F.min(F.struct("doc", "th")).alias("first")] if pairs else []
    classes = park(named.groupBy("set_key").agg(F.min("row").alias("id"), F.count("*").alias("weight"), *first), "classes")
    # all but one document of each class go
    others = park(named.select("row", "set_key").join(classes.where("weight > 1").select("set_key", "id"), "set_key").where("row <> id").select(F.col("row").alias("id")), "others")
    wide = docs.where("size > 0").withColumnRenamed("row", "id").join(few(others, 16), "id", "left_anti")
    leaves, large = buckets(wide)
    members = park(wide.select("id", "doc", "th", "size", "screen", F.xxhash64("set_key").alias("digest")), "members")
    more, links = split(large, members, rows)
    leaves = once(leaves if more is None else leaves.unionByName(more))
    likely = park(screened(leaves.join(members.select("id", "size", "screen"), "id")), "screened")
    sets = park(sets_of(rows, members, likely.select("id").distinct()), "sets")
    found = park(verified(likely.join(sets, "id")), "links")
    roots = components(found if links is None else found.unionByName(links))
    own = [F.coalesce("root", "id").alias("class_row"), (F.col("weight") - 1).alias("n_copies")]
    if pairs:
        roots = park(roots, "roots")
        rest = park(roots.select("id").join(few(likely.select("id").distinct(), 16), "id", "left_anti"), "rest")  # settled at pivots alone
        known = sets if rest.isEmpty() else sets.unionByName(park(sets_of(rows, members, rest), "sets"))
        nodes = roots.join(classes.select("id", "first.doc", "first.th", "weight"), "id").join(members.select("id", "size"), "id")
        nodes = park(nodes.select("id", "root", "doc", "th", "size", "weight"), "nodes")
        linked = park(link_counts(nodes, known), "link_counts")
        classes = classes.join(represented(nodes.drop("weight"), known), "id", "left").join(linked, "id", "left")
        own += [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("rep_doc", "first.doc").alias("rep_doc"), F.coalesce("similarity", F.lit(1.0)).alias("similarity")]
    verdict = park(classes.join(roots, "id", "left").select("set_key", *own), "verdict")
    given = [c for c in verdict.columns if c != "set_key"]
    whole = named.select("row", "doc", "th", "set_key").join(verdict, "set_key").select("row", "doc", "th", *given)
    alone = docs.where("th is null").select("row", "doc", "th", F.col("row").alias("class_row"), F.lit(0).cast("long").alias("n_copies"), *([F.lit(0).cast("long").alias("n_links"), F.col("doc").alias("rep_doc"), F.lit(1.0).alias("similarity")] if pairs else []))
    return whole.unionByName(alone)


def op2_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Every document with its class, the smallest doc_id in it, the class's size, how many other documents have an equal
    shingle set, to how many with another set it is linked, and a representative: a document that it is linked to, with their exact similarity.

    A class has one representative or more, each of which is linked to none of the others before it. Nulls, empty
    and repeated texts as near_duplicates says.
    """
    found = park(near_duplicates(table(spark, sf_dir, "documents"), pairs=True), "near")
    names = found.groupBy("class_row").agg(F.min("doc").alias("class_id"), F.count("*").alias("class_size")).where("class_size > 1")
    own = F.col("class_size").isNull()
    return found.join(few(park(names, "names")), "class_row", "left").select(
        F.col("doc").alias("doc_id"), F.when(own, F.col("doc")).otherwise(F.col("class_id")).alias("class_id"), F.when(own, 1).otherwise(F.col("class_size")).cast("long").alias("class_size"), "n_copies", "n_links",
        F.col("rep_doc").alias("rep_doc_id"), "similarity",
    )

"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Every row gets a global number in the order of its key columns; a keyed permutation of
0..N-1 turns the number into a place in a reproducible shuffle, and the place gives shard
(place mod shards) and slot (place div shards) without looking at any other row. Shard
sizes differ by one row at most, whatever the data.

All of it is DataFrame code: one range exchange of narrow rows, one small table of row
counts per partition, and arithmetic in columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import park

#: Moduli of the round function.
PRIME, MODULUS, SMALL = 2147483647, 2147483629, 1073741789
ROUNDS = 6
#: Walks before giving up. A walk from a row number meets each place outside 0..N-1 at most once and
#: there are fewer than sqrt(N) of them: for N <= 4096 it always ends in time, beyond that it fails with
#: a chance under 64 ** -64, and then loudly.
WALKS = 64


def sides(n: int) -> tuple[int, int]:
    """The two radices: a * b >= n, and a * b - n < a."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def round_keys(seed: int) -> list[tuple[int, int, int]]:
    """Three constants a round, by a linear congruential rule from the seed."""
    keys, x = [], (seed * 2654435761 + 12345) % PRIME
    for _ in range(ROUNDS):
        row = []
        for _ in range(3):
            x = (x * 48271 + 11) % PRIME
            row.append(1 + x % (PRIME - 1))
        keys.append(tuple(row))
    return keys


def long(value: int) -> Column:
    return F.lit(value).cast("long")


def mix(x: Column, key: tuple[int, int, int]) -> Column:
    """A keyed number from x >= 0: linear steps by three moduli; all products stay under 2 ** 62. x is written once."""
    add, mul, mul2 = map(long, key)
    return ((((x % long(PRIME) + add) * mul) % long(PRIME) * mul2) % long(MODULUS)) % long(SMALL)


def permute(x: Column, n: int, seed: int) -> Column:
    """One pass of the Feistel network over the a x b rectangle that holds 0..n-1."""
    a, b = map(long, sides(n))
    left, right = x % a, F.call_function("div", x, a)
    for i, key in enumerate(round_keys(seed)):
        if i % 2:
            right = (right + mix(left, key)) % b
        else:
            left = (left + mix(right, key)) % a
    return right * a + left


def shuffled_place(row: Column, n: int, seed: int) -> Column:
    """The place of row number `row` in the shuffle of 0..n-1 (cycle walking; null row: null)."""
    first = permute(row, n, seed)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), first, lambda at, _: F.when(at < long(n), at).otherwise(permute(at, n, seed)))
    return F.when(walked < long(n), walked).otherwise(F.raise_error(F.lit("cycle walking did not end")))


def number_rows(df: DataFrame, keys: list[str], row: str = "row_number", partitions: int | None = None) -> tuple[DataFrame, int]:
    """(df with a global row number from 0 in the order of `keys`, number of rows).

    Nulls come first. Rows equal in all keys may swap numbers among themselves; the source
    place is the last sort key, so such rows, however many, are dealt over several tasks.
    The numbered table is written once, as the range exchange draws its bounds anew each run.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_tl_from", F.monotonically_increasing_id()).repartitionByRange(n, *keys, "_tl_from").sortWithinPartitions(*keys, "_tl_from")
    placed = park(dealt.drop("_tl_from").withColumn("_tl_at", F.monotonically_increasing_id()), "rows")
    part, local = F.shiftright("_tl_at", 33), F.col("_tl_at").bitwiseAND((1 << 33) - 1)
    placed = placed.withColumn("_tl_part", part)
    counts = placed.groupBy("_tl_part").agg(F.count("*").alias("_tl_n"))
    # one row a partition: its number is fixed by the exchange above
    starts = counts.withColumn("_tl_start", F.sum("_tl_n").over(Window.orderBy("_tl_part").rowsBetween(Window.unboundedPreceding, -1)))
    total = counts.agg(F.sum("_tl_n")).first()[0] or 0
    numbered = placed.join(F.broadcast(starts.select("_tl_part", F.coalesce("_tl_start", F.lit(0)).alias("_tl_start"))), "_tl_part")
    return numbered.withColumn(row, F.col("_tl_start") + local).drop("_tl_at", "_tl_part", "_tl_start"), total


def shard(df: DataFrame, keys: list[str], shards: int, seed: int = 17, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """Add shard (int, 0..shards-1) and slot (long, gapless from 0 in each shard) to every row.

    The columns of df stay; columns already named like the two new ones are replaced. An empty
    table stays empty. The result depends only on the rows, the seed and the shard count.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    rows, n = number_rows(df.drop(shard_col, slot_col), keys, "_tl_row")
    if not n:
        return rows.drop("_tl_row").withColumns({shard_col: F.lit(0), slot_col: F.lit(0).cast("long")})
    place = shuffled_place(F.col("_tl_row"), n, seed)
    return (
        rows.withColumn("_tl_place", place)
        .withColumns({shard_col: (F.col("_tl_place") % shards).cast("int"), slot_col: F.floor(F.col("_tl_place") / F.lit(shards)).cast("long")})
        .drop("_tl_row", "_tl_place")
    )


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    """Every document in one of 16 shards, equal in rows. A null text has size 1 and the CRC of no bytes."""
    from .common import table

    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shard(rows, ["doc_id", "text_crc32", "size"], 16).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

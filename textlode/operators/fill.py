"""Forward fill: the last value that is not null, carried over rows in an order, whatever partitions they lie in."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import park

#: Partitions whose carried values are worked out together; between these blocks there is one row a block.
BLOCK = 256


def right(df: DataFrame, columns: list[str]) -> DataFrame:
    """df as the right side of a join: its columns under names of their own."""
    return df.select(*(quoted(c).alias(f"_ff_r_{c}") for c in columns))


def same(columns: list[str]) -> Column:
    """Equality of both sides' columns, null with null."""
    return functools.reduce(operator.and_, (quoted(c).eqNullSafe(quoted(f"_ff_r_{c}")) for c in columns), F.lit(True))


def filled_in(columns: list[str]) -> list[Column]:
    return [F.coalesce(quoted(c), quoted(f"_ff_r_{c}")).alias(c) for c in columns]


def forward_fill(df: DataFrame, order: list[str], columns: list[str], by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """df with the nulls of `columns` replaced by the last value before them in `order`, within rows of equal `by` if named.

    Two scans: rows are dealt in ranges of (by, order), so that a large group is spread over ranges as well; each range
    tells its last values in its last group; these, one row a range, are carried over ranges, block by block; then each range fills
    its own rows. No row is brought to one task. Null keys come first and are a group of their own. Rows that tie in order
    stand in the order of a digest of their columns, and repeated rows side by side. What precedes the first value stays null;
    an empty table stays empty. Columns named like the helpers (`_ff_...`) are an error.
    """
    by, keys = list(by), [*by, *order]
    if clash := [c for c in df.columns if c.startswith("_ff_")]:
        raise ValueError(f"columns {clash} have names that forward_fill uses itself")
    if not order or not columns or set(columns) & set(keys):
        raise ValueError("an order is needed, and columns to fill that are no part of it")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = df.withColumn("_ff_tie", F.xxhash64(*map(quoted, df.columns))).withColumn("_ff_row", F.monotonically_increasing_id())
    place = [*map(quoted, keys), F.col("_ff_tie"), F.col("_ff_row")]
    ranges = tied.repartitionByRange(n, *place).sortWithinPartitions(*place).withColumn("_ff_at", F.monotonically_increasing_id())
    rows = park(ranges.withColumn("_ff_part", F.shiftright("_ff_at", 33)).withColumn("_ff_block", F.floor(F.col("_ff_part") / BLOCK)), "ranges")
    carried = carry(rows, columns, by)
    inside = Window.partitionBy("_ff_part", *map(quoted, by)).orderBy("_ff_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = rows.select(*(F.last(quoted(c), True).over(inside).alias(c) if c in columns else quoted(c) for c in df.columns), "_ff_part")
    met = filled.join(F.broadcast(right(carried, ["_ff_part", *by, *columns])), same(["_ff_part", *by]), "left")  # one row a range
    return met.select(*(filled_in([c])[0] if c in columns else quoted(c) for c in df.columns))


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def latest(columns: list[str], place: str) -> list[Column]:
    return [F.max_by(quoted(c), F.when(quoted(c).isNotNull(), F.col(place))).alias(c) for c in columns]


def carry(rows: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """(_ff_part, by, columns): for the first group of each range, the last values in ranges before it."""
    keys = list(map(quoted, by))
    # only the groups that ranges begin and end with go on: others are whole inside one
    ends = rows.groupBy("_ff_part").agg(F.min("_ff_at").alias("_ff_first"), F.max("_ff_at").alias("_ff_last"))
    edges = park(rows.join(F.broadcast(ends), "_ff_part").where("_ff_at in (_ff_first, _ff_last)"), "edges")  # one row a range
    first = edges.where("_ff_at = _ff_first").select("_ff_part", "_ff_block", *keys)
    last = right(edges.where("_ff_at = _ff_last"), ["_ff_part", *by])
    tail = rows.join(F.broadcast(last), same(["_ff_part", *by]), "left_semi")
    tails = park(tail.groupBy("_ff_part", "_ff_block", *keys).agg(*latest(columns, "_ff_at")), "tails")
    # within a block of ranges
    want = first.withColumn("_ff_asks", F.lit(True))
    gives = tails.withColumn("_ff_asks", F.lit(False))
    both = want.select("_ff_part", "_ff_block", *keys, "_ff_asks", *(F.lit(None).cast(tails.schema[c].dataType).alias(c) for c in columns)).unionByName(gives)
    # a range asks before it gives
    before = Window.partitionBy("_ff_block", *keys).orderBy("_ff_part", F.desc("_ff_asks")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.select("_ff_part", "_ff_block", *keys, "_ff_asks", *(F.last(quoted(c), True).over(before).alias(c) for c in columns)).where("_ff_asks").drop("_ff_asks")
    # between blocks
    blocks = right(tails.groupBy("_ff_block", *keys).agg(*latest(columns, "_ff_part")), ["_ff_block", *by, *columns])
    met = near.join(blocks, (F.col("_ff_r__ff_block") < F.col("_ff_block")) & same(by), "left")
    older = [F.max_by(quoted(f"_ff_r_{c}"), F.when(quoted(f"_ff_r_{c}").isNotNull(), F.col("_ff_r__ff_block"))).alias(f"_ff_r_{c}") for c in columns]
    # a range has one first row: its own values are the same in all rows of it
    return met.groupBy("_ff_part", *keys).agg(*(F.first(quoted(c)).alias(c) for c in columns), *older).select("_ff_part", *keys, *filled_in(columns))

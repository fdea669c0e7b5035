"""Positions and running sums over a total order, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import input_bytes, materialize

#: Inputs up to this many bytes stay in one partition.
SPREAD_BYTES = 64 << 10
#: Rows of a block of consecutive positions.
BLOCK = 1 << 16


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over at least two partitions a core, for rows that are about to grow many times; large inputs are split enough already."""
    n = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n, key) if SPREAD_BYTES < input_bytes(df) < n * (32 << 20) else df


def positions(df: DataFrame, order: list, keep: list[str], name: str = "pos") -> DataFrame:
    """``keep`` and the 0-based place of each row in the order of ``order`` (a list of columns that orders all rows).

    The input is dealt out by ranges of the order, sorted in each and
    written once; a row's place is its number in its range plus the rows of
    the ranges before it. No key can make a range large, as the order tells all rows apart. Every size takes this way.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).select(*keep, F.monotonically_increasing_id().alias("_at"))
    written = materialize(dealt, "ordered")
    part = F.shiftright("_at", 33)
    counts = written.groupBy(part.alias("_part")).count()
    offsets = counts.select("_part", (F.sum("count").over(W.orderBy("_part")) - F.col("count")).alias("_before"))  # one row a range
    return written.withColumn("_part", part).join(F.broadcast(offsets), "_part").select(*keep, (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))


def cell(position, block: int) -> Column:
    """The number of the block that holds a position, by division of whole numbers, exact at any size."""
    return F.call_function("div", F.col(position) if isinstance(position, str) else position, F.lit(block))


def running(df: DataFrame, position: str, sums: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """``df`` with exclusive running sums of the columns ``sums`` in the order of ``position``.

    Sums run inside blocks of positions. The blocks' totals, a row each, run inside
    groups of as many blocks, and only the groups' totals, a row for each 2**32 positions, meet in one window.
    """
    marked = df.select("*", cell(position, block).alias("_block"), *(c.cast("long").alias(f"_{k}") for k, c in sums.items()))
    totals = marked.groupBy("_block").agg(*(F.sum(f"_{k}").alias(f"_t_{k}") for k in sums))
    bases = before_blocks(totals, {f"_b_{k}": f"_t_{k}" for k in sums})
    inside = W.partitionBy("_block").orderBy(position).rowsBetween(W.unboundedPreceding, -1)
    return marked.join(bases, "_block").select(*df.columns, *((F.col(f"_b_{k}") + F.coalesce(F.sum(f"_{k}").over(inside), F.lit(0))).cast("long").alias(k) for k in sums))


def before_blocks(totals: DataFrame, sums: dict[str, str], block: str = "_block") -> DataFrame:
    """(block, a column for each of ``sums``): the totals of all blocks before each, by groups of 65,536 blocks; only the groups' sums meet in one window."""
    totals = totals.withColumn("_group", F.shiftright(block, 16))
    groups = totals.groupBy("_group").agg(*(F.sum(t).alias(f"_g{t}") for t in sums.values()))
    before = lambda name, window: F.coalesce(F.sum(name).over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    heads = groups.select("_group", *(before(f"_g{t}", W.orderBy("_group")).alias(f"_h{t}") for t in sums.values()))
    near = totals.select(block, "_group", *(before(t, W.partitionBy("_group").orderBy(block)).alias(f"_n{t}") for t in sums.values()))
    return near.join(heads, "_group").select(block, *((F.col(f"_h{t}") + F.col(f"_n{t}")).cast("long").alias(n) for n, t in sums.items()))

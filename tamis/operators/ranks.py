"""Exact order statistics and consecutive numbers without a single-task window.

A global ``row_number`` or running total sends every row of a group to one task.  Here the
order is cut into blocks, the blocks are totalled, the (few) totals are accumulated, and only
then are rows ordered, each block in its own task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.session import written

BLOCK_BITS = 20


def running_before(amount: str, groups: Sequence[str], order: Sequence[Column | str]) -> Column:
    """Total of ``amount`` over the rows that come strictly before, within the groups."""
    window = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(amount).over(window), F.lit(0).cast("long"))


def number_in_order(
    df: DataFrame, groups: Sequence[str], order: str, out: str, tie: Sequence[str] = ()
) -> DataFrame:
    """Add consecutive numbers from 1 within ``groups``, following ``order``.

    The order is replaced by each row's place in a distributed sort by order and ``tie``, a unique
    number that is cut every 2^20: a block holds at most 2^20 rows, whatever repeats or gaps the
    order column has.  Sizes, offsets and rows must agree on the blocks, so all three read one
    written table.
    """
    placed = df.sort(F.col(order), *tie).withColumn("_place", F.monotonically_increasing_id())

    keys = list(groups)
    blocked = written(placed, "ordre").withColumn("_block", F.shiftright("_place", BLOCK_BITS))
    sizes = (
        blocked.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_size"))
        .withColumn("_super", F.shiftright("_block", BLOCK_BITS))
    )
    # At most 2^23 super-blocks can exist for 63-bit positions; in practice a handful do.
    supers = (
        sizes.groupBy(*keys, "_super").agg(F.sum("_size").alias("_size"))
        .withColumn("_base", running_before("_size", keys, ["_super"]))
        .drop("_size")
    )
    offsets = (
        sizes.join(supers, [*keys, "_super"])
        .withColumn("_before", F.col("_base") + running_before("_size", [*keys, "_super"], ["_block"]))
        .select(*keys, "_block", "_before")
    )
    within = Window.partitionBy(*keys, "_block").orderBy("_place", *tie)
    return (
        blocked.join(offsets, [*keys, "_block"])
        .withColumn(out, F.col("_before") + F.row_number().over(within))
        .drop("_place", "_block", "_before")
    )

"""Dense numbers in an order, without a sort in one task, and cogroups of related tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from ..plans.session import stored


def keyed(rows: DataFrame, *keys: str) -> GroupedData:
    """``rows`` grouped, with columns of their own, so that tables with a common origin can be cogrouped."""
    return rows.select(*[F.col(c).alias(c) for c in rows.columns]).groupBy(*keys)


def numbered(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """``rows``, written in ``order``, with ``no`` from 0 without gaps.

    Spark ranges the rows over tasks and sorts them there; the rows of the ranges before
    are added to a row's number in its own. ``order`` should have no ties but between
    equal rows, so that a task that is run again numbers alike. The table of ranges
    that is broadcast has as many rows as the shuffle has partitions.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = stored(ranged.withColumn("__at", F.monotonically_increasing_id()), name).withColumn("__part", F.shiftright("__at", 33))
    sizes = kept.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    within = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return kept.join(F.broadcast(before), "__part").withColumn("no", F.col("__before") + within).drop("__part", "__at", "__before")

"""Places in a global order without a window over the whole table.

Rows are dealt by ranges of the order and stored, so their ranges stay what they are. Each range is summed
apart; what comes before a range is a sum over one row a range, of which there are as many as shuffle partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import written


def _before(sums: DataFrame, by: list[str]) -> DataFrame:
    """For each range (and group) the sum of the ranges before it."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)
    return sums.select(*by, "__part", (F.sum("__n").over(w) - F.col("__n")).alias("__before"))


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """The rows with their place, 1, 2, ..., along ``order``. Rows move once."""
    at = F.monotonically_increasing_id()  # range number and place in the range
    ranged = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", at), "ranges")
    ranged = ranged.withColumn("__part", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND((1 << 33) - 1))
    before = _before(ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")), [])
    return ranged.join(F.broadcast(before), "__part").withColumn(out, F.col("__before") + F.col("__at") + 1).drop("__part", "__at", "__before")


def running(df: DataFrame, by: list[str], order: str, value: str, out: str) -> DataFrame:
    """The rows with the sum of ``value`` up to themselves along ``order`` in their group. Each order value stands once a group."""
    ranged = written(df.repartitionByRange(*by, order).withColumn("__part", F.spark_partition_id()), "ranges")
    before = _before(ranged.groupBy(*by, "__part").agg(F.sum(value).alias("__n")), by)
    w = Window.partitionBy(*by, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(before, [*by, "__part"]).withColumn(out, F.col("__before") + F.sum(value).over(w)).drop("__part", "__before")

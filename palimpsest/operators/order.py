"""Numbering of rows in an order without one task that sees all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import stored


def numbered(df: DataFrame, order: list[str], name: str = "pos", first: int = 0) -> DataFrame:
    """Adds `name`: `first`, first + 1, .. in the given order: sorted ranges plus the count of rows in the ranges before.

    The ranges are written as a table, so a lost executor cannot change them between the two steps.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    ranged = stored(ranged.withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND((1 << 33) - 1)))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))  # one row per range
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return ranged.join(F.broadcast(before), "_p").withColumn(name, F.col("_b") + F.col("_i") + first).drop("_m", "_p", "_i", "_b")

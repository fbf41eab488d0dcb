"""Readers of the input tables, each with the columns the operators rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def guard(spark: SparkSession) -> None:
    """Turns off a planner shortcut that gives wrong results in Spark 4.1.

    With it, a union of inputs that are partitioned alike counts as partitioned by the same keys, so an aggregation
    after it skips its shuffle, while the parts of one key lie in different partitions: each key comes out several times.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; the scan stays lazy, so columns and filters are pushed into it."""
    guard(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

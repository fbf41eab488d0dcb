"""Self-vector and the log of learning events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import hv
from palimpsest.operators import order
from palimpsest.schemas import EVENT_KINDS


def or_fold(df: DataFrame, vector: str, words: int, keys: list[str] | None = None) -> DataFrame:
    """Bitwise or over the vectors of each group: the moving average at weight one half, folded in any order."""
    return df.groupBy(*(keys or [])).agg(F.array(*(F.expr(f"bit_or({vector}[{i}])") for i in range(words))).alias(vector))


def xor_fold(df: DataFrame, vector: str, words: int, keys: list[str] | None = None) -> DataFrame:
    """Exclusive or over the vectors of each group."""
    return df.groupBy(*(keys or [])).agg(F.array(*(F.expr(f"bit_xor({vector}[{i}])") for i in range(words))).alias(vector))


def current(history: DataFrame, words: int = hv.FULL_WORDS) -> DataFrame:
    """(hv): the newest snapshot, all zero without any."""
    return history.agg(F.coalesce(F.max_by("hv", "seq"), hv.zero(words)).alias("hv"))


def updated(self_vector: Column, bundle: Column) -> tuple[Column, Column]:
    """The vector moved towards a bundle, and its drift in bits."""
    new = hv.ema(self_vector, bundle)
    return new, hv.hamming(self_vector, new)


def subtracted(self_vector: Column, bundle: Column) -> tuple[Column, Column]:
    """The vector after a deletion, and its drift in bits."""
    new = hv.subtract(self_vector, bundle)
    return new, hv.hamming(self_vector, new)


def snapshots(history: DataFrame) -> DataFrame:
    """All snapshots by sequence number."""
    return history.orderBy("seq")


def events(parts: dict[str, DataFrame]) -> DataFrame:
    """(kind, at, ref_id): learning events of several kinds in one table; kinds outside the closed list are refused."""
    unknown = set(parts) - set(EVENT_KINDS)
    if unknown:
        raise ValueError(f"unknown kinds of events: {sorted(unknown)}")
    return reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("kind"), "at", "ref_id") for k, df in parts.items()])


def numbered(log: DataFrame, first_id: int = 1) -> DataFrame:
    """Events with ids in order of time, kind and reference."""
    return order.numbered(log, ["at", "kind", "ref_id"], "id", first_id)


def since(log: DataFrame, at: Column, limit: int | None = None) -> DataFrame:
    """Events at or after a time, oldest first."""
    x = log.filter(F.col("at") >= at).orderBy("at", "kind", "ref_id")
    return x.limit(limit) if limit is not None else x

"""References to records that do not exist, are deleted or come later.

References are first combined per key and month, so a key that holds any share
of them becomes a few rows before anything is joined. Keys that still stand for
very many references are checked against a broadcast list of bounded size, the
others by a shuffled join, and both verdicts are put together. Only references
of keys under suspicion are then looked at one by one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many keys count as heavy.
MAX_HEAVY_KEYS = 4096
MONTH = ["source_table", "key", "ym"]


def references(triples: DataFrame, tombstones: DataFrame, scan_entries: DataFrame) -> DataFrame:
    """All references: source_table, key, at, ym, source_key, flag. Null keys refer to nothing and are left out."""
    at = lambda c: F.col(c).cast("timestamp").alias("at")
    none = F.lit(None).cast("boolean").alias("flag")
    parts = [
        triples.select(F.lit("triples").alias("source_table"), F.col("episode_id").alias("key"), at("t_tx_start"), F.col("triple_id").alias("source_key"), none),
        tombstones.filter("kind = 0").select(F.lit("tombstones").alias("source_table"), F.col("id").alias("key"), at("tombstoned_at"), F.col("id").alias("source_key"), none),
        scan_entries.select(F.lit("scan_entries").alias("source_table"), F.col("id").alias("key"), at("valid_start"), F.col("id").alias("source_key"), F.coalesce("tombstoned", F.lit(False)).alias("flag")),
    ]
    refs = reduce(DataFrame.unionByName, parts).filter("key is not null")
    return refs.withColumn("ym", F.date_format("at", "yyyy-MM"))


def targets(episodes: DataFrame, tombstones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Episodes with their first recording, and deleted episodes with their first tombstone."""
    there = episodes.filter("id is not null").groupBy(F.col("id").alias("key")).agg(F.min(F.col("t_tx_start").cast("timestamp")).alias("recorded_at"))
    gone = (
        tombstones.filter("kind = 0 and id is not null").groupBy(F.col("id").alias("key"))
        .agg(F.min(F.col("tombstoned_at").cast("timestamp")).alias("deleted_at"), F.lit(True).alias("has_tombstone"))
    )
    return there.withColumn("exists", F.lit(True)), gone


def reason(at: Column, flag: Column) -> Column:
    """The first reason that holds for one reference, or null."""
    source = F.col("source_table")
    missing = F.col("exists").isNull()
    stone = F.col("has_tombstone").isNotNull()
    return (
        F.when(missing, "missing")
        .when((source == "triples") & (at < F.col("recorded_at")), "late")
        .when((source == "triples") & (F.col("deleted_at") <= at), "deleted")
        .when((source == "scan_entries") & flag & ~stone, "no_tombstone")
        .when((source == "scan_entries") & ~flag & stone, "deleted")
    )


def _suspects(months: DataFrame, there: DataFrame, gone: DataFrame) -> DataFrame:
    """Months of a key in which a reference may be an orphan, with what is known of the key."""
    checked = months.join(there, "key", "left").join(gone, "key", "left")
    possible = (
        reason(F.col("first_at"), F.col("any_set")).isNotNull()
        | reason(F.col("last_at"), F.col("any_set")).isNotNull()
        | reason(F.col("last_at"), F.col("all_set")).isNotNull()
    )
    return checked.filter(possible).select(*MONTH, "exists", "recorded_at", "deleted_at", "has_tombstone")


def orphans(refs: DataFrame, there: DataFrame, gone: DataFrame, heavy_refs: int = 10_000) -> DataFrame:
    """One row per orphan reference: source_table, ym, source_key, reason.

    A row delivered twice counts once. A reference without a time can only be
    missing or contradict its flag; its ym is null. Empty tables give no rows, and
    an empty episodes table makes every reference missing.
    """
    months = refs.groupBy(*MONTH).agg(
        F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"),
        F.bool_or("flag").alias("any_set"), F.bool_and("flag").alias("all_set"),
    )
    heavy = [r.key for r in refs.groupBy("key").count().filter(F.col("count") > heavy_refs).orderBy(F.desc("count"), "key").limit(MAX_HEAVY_KEYS).collect()]
    keep = lambda s: s.select(*MONTH, "exists", "recorded_at", "deleted_at", "has_tombstone")
    on = [F.col("r.source_table") == F.col("s.source_table"), F.col("r.key") == F.col("s.key"), F.col("r.ym").eqNullSafe(F.col("s.ym"))]

    def rows(part: DataFrame, suspects: DataFrame) -> DataFrame:
        hit = part.alias("r").join(suspects.alias("s"), on)
        return hit.select("r.source_table", "r.ym", "r.source_key", "r.at", "r.flag", "s.exists", "s.recorded_at", "s.deleted_at", "s.has_tombstone")

    if heavy:
        # a list of at most MAX_HEAVY_KEYS keys, so both sides made from it are small
        keys = refs.sparkSession.createDataFrame([(k,) for k in heavy], "key long")
        light = refs.join(F.broadcast(keys), "key", "left_anti")
        light_hit = rows(light, _suspects(months.join(F.broadcast(keys), "key", "left_anti"), there, gone))
        of_heavy = lambda t: F.broadcast(t.join(F.broadcast(keys), "key", "left_semi"))
        bad = _suspects(months.join(F.broadcast(keys), "key", "left_semi"), of_heavy(there), of_heavy(gone))
        heavy_hit = rows(refs.join(F.broadcast(keys), "key", "left_semi"), F.broadcast(keep(bad)))
        hits = light_hit.unionByName(heavy_hit)
    else:
        hits = rows(refs, _suspects(months, there, gone))
    return (
        hits.withColumn("reason", reason(F.col("at"), F.col("flag")))
        .filter("reason is not null")
        .groupBy("source_table", "source_key", "ym", "reason").agg(F.count("*").alias("deliveries"))
        .select("source_table", "ym", "source_key", "reason")
    )


def orphan_counts(found: DataFrame) -> DataFrame:
    """Orphans per table, month and reason."""
    return found.groupBy("source_table", "ym", "reason").agg(F.count("*").alias("orphans"))

"""Supersession and contradictions between facts of one subject and predicate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.scoring import valid_at


def supersede(episodes: DataFrame, links: DataFrame) -> DataFrame:
    """Episodes with links (older, newer) applied: superseded_by set and valid_end 1 ms before the newer start.

    A link whose newer episode is unknown changes nothing; of several links of one older episode the smallest newer counts.
    """
    starts = episodes.groupBy(F.col("id").alias("newer")).agg(F.min("valid_start").alias("newer_start"))
    one = links.groupBy("older").agg(F.min("newer").alias("newer")).join(starts, "newer").withColumnRenamed("older", "id")
    x = episodes.join(one, "id", "left")
    closed = F.when(F.col("newer").isNotNull(), F.col("newer_start") - F.expr("interval 1 millisecond")).otherwise(F.col("valid_end"))
    return x.withColumn("valid_end", closed).withColumn("superseded_by", F.coalesce("newer", "superseded_by")).select(*episodes.columns)


def facts_of(episodes: DataFrame) -> DataFrame:
    """(id, pos, subject, predicate, object, valid_start, superseded_by): triples written out."""
    return episodes.select("id", "valid_start", "superseded_by", F.posexplode("triples").alias("pos", "t")).select(
        "id", "pos", "t.subject", "t.predicate", "t.object", "valid_start", "superseded_by"
    )


def contradictions(facts: DataFrame) -> DataFrame:
    """(older, newer): the first newer neighbour with another object, per episode not yet superseded.

    Neighbours are rows of one subject and predicate by valid_start, id and place; equal objects and the episode itself
    are no contradiction. One row per older episode: the contradiction that comes first.
    """
    w = Window.partitionBy("subject", "predicate").orderBy("valid_start", "id", "pos")
    n = facts.filter("subject is not null and predicate is not null and valid_start is not null").select(
        F.col("id").alias("older"), "object", "superseded_by", "subject", "predicate", "valid_start",
        F.lead("id").over(w).alias("newer"), F.lead("object").over(w).alias("next_object"),
    )
    hit = n.filter("newer is not null and newer != older and not (object <=> next_object) and superseded_by is null")
    return hit.groupBy("older").agg(F.min_by("newer", F.struct("subject", "predicate", "valid_start")).alias("newer"))


def snapshot(df: DataFrame, t) -> DataFrame:
    """Rows valid at a time; start before or at it, end after it or open."""
    return df.filter(valid_at(t))

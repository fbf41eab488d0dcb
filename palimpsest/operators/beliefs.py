"""Revisable beliefs with a log of revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.scoring import BELIEF_STEP, WITHDRAW_BELOW
from palimpsest.operators import episodes as E
from palimpsest.operators.folds import ordered_fold

LOG = "belief_id long, seq long, previous double, confidence double, episode_id long, supports boolean, withdrawn boolean"


def step(confidence: float, supports: bool) -> float:
    """One step of a belief's confidence; see functions.scoring.revised for the column form."""
    move = BELIEF_STEP * (1 - 2 * confidence * (1 - confidence))
    return min(0.99, max(0.01, confidence + (move if supports else -move)))


def revise(evidence: DataFrame, start: float = 0.5) -> DataFrame:
    """The revision log of beliefs from ordered evidence (belief_id, at, episode_id, supports, confidence0).

    Evidence is taken by time and id until the confidence falls below the threshold: then the belief is
    withdrawn and later evidence is refused, so it leaves no row. Null supports counts as no support.
    """

    def begin(row: dict) -> tuple:
        first = row.get("confidence0")
        return (start if first is None or first != first else min(1.0, max(0.0, first))), 0, False

    def go(state: tuple, row: dict) -> tuple[tuple, dict | None]:
        confidence, seq, withdrawn = state
        if withdrawn:
            return state, None
        supports = bool(row["supports"]) if row["supports"] is not None else False
        new = step(confidence, supports)
        gone = new < WITHDRAW_BELOW
        made = {"seq": seq, "previous": confidence, "confidence": new, "episode_id": row["episode_id"], "supports": supports, "withdrawn": gone}
        return (new, seq + 1, gone), made

    if "confidence0" not in evidence.columns:
        evidence = evidence.withColumn("confidence0", F.lit(None).cast("double"))
    return ordered_fold(evidence.filter("belief_id is not null"), ["belief_id"], ["at", "episode_id"], begin, go, LOG)


def current(log: DataFrame) -> DataFrame:
    """(belief_id, confidence, revisions, withdrawn) from the log."""
    return log.groupBy("belief_id").agg(F.max_by("confidence", "seq").alias("confidence"), F.count("*").alias("revisions"), F.bool_or("withdrawn").alias("withdrawn"))


def about(beliefs: DataFrame, tombstones: DataFrame, subject: str) -> DataFrame:
    """Beliefs on exactly this subject, neither withdrawn nor tombstoned."""
    x = beliefs.filter((F.col("subject") == subject) & F.col("t_valid_end").isNull())
    return x.join(E.tombstoned_ids(tombstones, 1), "id", "left_anti")


def active_by_key(beliefs: DataFrame) -> DataFrame:
    """(subject, predicate, id): the first belief not withdrawn per subject and predicate, both non-empty."""
    x = beliefs.filter("t_valid_end is null and subject != '' and predicate != ''")
    return x.groupBy("subject", "predicate").agg(F.min("id").alias("id"))


def history(log: DataFrame, belief_id: int) -> DataFrame:
    """Revisions 0, 1, 2, .. of a belief until the first gap."""
    w = Window.partitionBy("belief_id").orderBy("seq")
    x = log.filter(F.col("belief_id") == belief_id).withColumn("_i", F.row_number().over(w) - 1)
    return x.filter("_i = seq").drop("_i").orderBy("seq")


def correct_evidence(beliefs: DataFrame, gone: DataFrame) -> DataFrame:
    """Beliefs after episodes (id) went: ids leave both lists, confidence falls with the share of support kept.

    Only beliefs not withdrawn that cite a gone episode change; those below the threshold come back with
    `withdrawn`. Columns: id, confidence, evidence, contradictions, corrected, withdrawn. A belief's lists are
    never put together with all gone ids: the citations are joined one by one.
    """
    cited = beliefs.filter("t_valid_end is null").select("id", F.explode(F.array_distinct(F.concat(F.coalesce("evidence", F.array()), F.coalesce("contradictions", F.array())))).alias("e"))
    hit = cited.join(gone.select(F.col("id").alias("e")).distinct(), "e").groupBy("id").agg(F.collect_set("e").alias("lost"))
    x = beliefs.join(hit, "id", "left")
    kept = F.filter("evidence", lambda e: ~F.array_contains("lost", e))
    against = F.filter("contradictions", lambda e: ~F.array_contains("lost", e))
    scaled = F.when(F.size("evidence") > 0, F.col("confidence") * F.size(kept) / F.size("evidence")).otherwise(F.col("confidence"))
    touched = F.col("lost").isNotNull()
    return x.select(
        "id", F.when(touched, scaled).otherwise(F.col("confidence")).alias("confidence"), F.when(touched, kept).otherwise(F.col("evidence")).alias("evidence"),
        F.when(touched, against).otherwise(F.col("contradictions")).alias("contradictions"), touched.alias("corrected"),
        (touched & (scaled < WITHDRAW_BELOW)).alias("withdrawn"),
    )

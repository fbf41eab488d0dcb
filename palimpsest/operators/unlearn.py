"""Cascading, reversible deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.scoring import age_days
from palimpsest.operators import episodes as E
from palimpsest.operators.beliefs import correct_evidence

RESTORE_DAYS = 30
TARGETS = ("episode", "belief", "concept", "source", "session")
EMPTY = "kind int, id long"


def label(kind: str, value) -> str:
    """Name of a target in the audit log."""
    return f"{kind}:{value}"


def _ids(df: DataFrame, kind: int, column: str = "id") -> DataFrame:
    return df.filter(F.col(column).isNotNull()).select(F.lit(kind).alias("kind"), F.col(column).cast("long").alias("id")).distinct()


def atoms_citing(atoms: DataFrame, episode_ids: DataFrame) -> DataFrame:
    """Atoms with at least one of the episodes (id) among their evidence."""
    cited = atoms.select("id", F.explode("evidence").alias("e")).join(episode_ids.select(F.col("id").alias("e")), "e", "left_semi")
    return cited.select("id").distinct()


def cascade(kind: str, value, episodes: DataFrame, beliefs: DataFrame, atoms: DataFrame, links: DataFrame, concepts: DataFrame, atoms_of_provenance: bool = False) -> DataFrame:
    """(kind, id): everything that goes with a target; kind 0 episode, 1 belief, 2 atom.

    An episode takes the atoms citing it; a belief only itself; a concept (by id) its episodes, the beliefs on its
    name and the atoms anchored at it; a source or session its episodes and beliefs, and with `atoms_of_provenance`
    the atoms citing those episodes. An unknown target gives no rows.
    """
    if kind == "episode":
        one = _ids(episodes.filter(F.col("id") == value), 0)
        return one.unionByName(_ids(atoms_citing(atoms, one), 2))
    if kind == "belief":
        return _ids(beliefs.filter(F.col("id") == value), 1)
    if kind == "concept":
        name = concepts.filter(F.col("id") == value).select(F.col("canonical_name").alias("subject"))
        return (
            _ids(links.filter(F.col("concept_id") == value), 0, "episode_id")
            .unionByName(_ids(beliefs.join(name, "subject", "left_semi"), 1))
            .unionByName(_ids(atoms.filter(F.col("concept_id") == value), 2))
        )
    if kind in ("source", "session"):
        by = {kind: value}
        gone = _ids(E.by_provenance(episodes, **by), 0)
        out = gone.unionByName(_ids(E.by_provenance(beliefs, **by), 1))
        return out.unionByName(_ids(atoms_citing(atoms, gone), 2)) if atoms_of_provenance else out
    raise ValueError(f"unknown target kind {kind}")


def new_tombstones(gone: DataFrame, at: Column, reason: str, audit_event_id: int) -> DataFrame:
    """Tombstone rows for a cascade; appended, the latest per (kind, id) wins."""
    return gone.select("kind", "id", at.alias("tombstoned_at"), F.lit(reason).alias("reason"), F.lit(audit_event_id).cast("long").alias("audit_event_id"))


def report(gone: DataFrame, beliefs: DataFrame) -> DataFrame:
    """(episodes, beliefs, atoms, beliefs_revised): sizes of a cascade, with the beliefs withdrawn or corrected by it."""
    sizes = gone.agg(*(F.count(F.when(F.col("kind") == k, 1)).alias(n) for k, n in ((0, "episodes"), (1, "beliefs"), (2, "atoms"))))
    own = beliefs.join(gone.filter("kind = 1").select("id"), "id", "left_semi").filter("t_valid_end is null").select("id")
    others = beliefs.join(gone.filter("kind = 1").select("id"), "id", "left_anti")
    fixed = correct_evidence(others, gone.filter("kind = 0").select("id")).filter("corrected").select("id")
    return sizes.withColumn("beliefs_revised", own.unionByName(fixed).agg(F.count("*")).scalar())


def restorable(tombstones: DataFrame, audit_event_id: int, now: Column) -> DataFrame:
    """The rows of an audit event that may still be restored: those no more than 30 whole days old."""
    return tombstones.filter((F.col("audit_event_id") == audit_event_id) & (age_days(now, F.col("tombstoned_at")) <= RESTORE_DAYS))


def restore(tombstones: DataFrame, audit_event_id: int, now: Column) -> DataFrame:
    """Tombstones left after a restore. Beliefs and the self-vector stay as the deletion left them."""
    within = age_days(now, F.col("tombstoned_at")) <= RESTORE_DAYS
    return tombstones.filter(~((F.col("audit_event_id") == audit_event_id) & within) | F.col("audit_event_id").isNull())

"""Scans, lookups, listings and joins over episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import scoring as S
from palimpsest.functions.text import distinct_terms, tokens


def latest(df: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """The newest row per key of an append-only table."""
    whole = F.struct(*(F.col(c) for c in version), F.struct(*df.columns).alias("row"))
    if any(t.startswith("map") or "map<" in t for _, t in df.dtypes):  # maps have no order
        w = Window.partitionBy(*key).orderBy(*(F.desc(c) for c in version))
        return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return df.groupBy(*key).agg(F.max(whole).alias("_r")).select("_r.row.*")


def unique_episodes(episodes: DataFrame) -> DataFrame:
    """One row per id: the earliest recorded. Null ids are left out."""
    return episodes.filter("id is not null").withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("t_tx_start"))).filter("_n = 1").drop("_n")


def tombstoned_ids(tombstones: DataFrame, kind: int) -> DataFrame:
    """Distinct ids under a tombstone of a kind."""
    return tombstones.filter((F.col("kind") == kind) & F.col("id").isNotNull()).select("id").distinct()


def scan_directory(episodes: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Narrow projection for scans: id, valid time and a tombstone flag, one row per id."""
    one = episodes.filter("id is not null").groupBy("id").agg(F.min("valid_start").alias("valid_start"), F.max("valid_end").alias("valid_end"))
    gone = tombstoned_ids(tombstones, 0).withColumn("tombstoned", F.lit(True))
    return one.join(gone, "id", "left").withColumn("tombstoned", F.coalesce("tombstoned", F.lit(False)))


def live(episodes: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Episodes without a tombstone."""
    return episodes.join(tombstoned_ids(tombstones, 0), "id", "left_anti")


def get_episode(episodes: DataFrame, tombstones: DataFrame, id_: int) -> DataFrame:
    """One episode by id, nothing if it is unknown or tombstoned. The filter reaches the scan."""
    return live(episodes.filter(F.col("id") == id_), tombstones.filter(F.col("id") == id_))


def list_episodes(episodes: DataFrame, tombstones: DataFrame, limit: int) -> DataFrame:
    """Live episodes in ascending id, at most `limit`."""
    return live(episodes, tombstones).orderBy("id").limit(limit)


def temporal(df: DataFrame, as_of: Column | None = None, window: tuple[Column, Column] | None = None) -> DataFrame:
    """Rows that pass the point in time and the window, where given."""
    if as_of is not None:
        df = df.filter(S.valid_at(as_of))
    if window is not None:
        df = df.filter(S.overlaps(*window))
    return df


def list_range(episodes: DataFrame, tombstones: DataFrame, low: Column, high: Column, limit: int | None = None) -> DataFrame:
    """Live episodes whose valid time meets [low, high], by start and id."""
    found = temporal(live(episodes, tombstones), window=(low, high)).orderBy("valid_start", "id")
    return found.limit(limit) if limit is not None else found


def bridge(episodes: DataFrame, concepts: DataFrame) -> DataFrame:
    """(concept_id, episode_id): concepts whose name is a subject or object of an episode's triples, exactly as written."""
    names = F.flatten(F.array(F.transform("triples", lambda t: t["subject"]), F.transform("triples", lambda t: t["object"])))
    said = episodes.filter("id is not null").select(F.col("id").alias("episode_id"), F.explode(F.array_distinct(names)).alias("name"))
    by_name = concepts.groupBy(F.col("canonical_name").alias("name")).agg(F.min("id").alias("concept_id"))
    return said.join(by_name, "name").select("concept_id", "episode_id").distinct()


def concept_lookup(names: DataFrame, concepts: DataFrame, fuzzy: int | None = None) -> DataFrame:
    """(name, concept_id, how): exact, else by lower case, else a unique concept within `fuzzy` edits of the lower-cased name.

    Case-insensitive hits take the first concept in name order; names that fit nothing have no row. The fuzzy step
    joins on lengths that can match, so it is bounded by names of near length, and is meant for small name lists.
    """
    c = concepts.filter("canonical_name is not null").select(F.col("id").alias("concept_id"), F.col("canonical_name").alias("c"))
    one = names.select("name").distinct()
    exact = one.join(c.groupBy(F.col("c").alias("name")).agg(F.min("concept_id").alias("concept_id")), "name").withColumn("how", F.lit("exact"))
    left = one.join(exact, "name", "left_anti")
    lower = c.groupBy(F.lower("c").alias("l")).agg(F.min_by("concept_id", "c").alias("concept_id"))
    ci = left.withColumn("l", F.lower("name")).join(lower, "l").select("name", "concept_id", F.lit("lower").alias("how"))
    found = exact.unionByName(ci)
    if fuzzy is None:
        return found
    rest = left.join(ci, "name", "left_anti")
    return found.unionByName(fuzzy_candidates(rest, concepts, fuzzy).groupBy("name").agg(F.count("*").alias("n"), F.min("concept_id").alias("concept_id"))
                             .filter("n = 1").select("name", "concept_id", F.lit("fuzzy").alias("how")))


def fuzzy_candidates(names: DataFrame, concepts: DataFrame, distance: int) -> DataFrame:
    """(name, concept_id, distance): concepts within an edit distance of the lower-cased name, equal names left out.

    Candidates meet on length and on one of distance+1 even parts of the concept's name at nearly its place, so no
    pair that qualifies is missed and names are not compared with all others.
    """
    k = distance
    lower = lambda c: F.lower(F.col(c))
    c = concepts.filter("canonical_name is not null").select(F.col("id").alias("concept_id"), lower("canonical_name").alias("c")).withColumn("len", F.length("c"))
    n = names.select("name", lower("name").alias("l"))
    part = lambda i: (F.floor(F.col("len") * i / (k + 1)) + 1).cast("int")
    cut = c.select("*", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.expr("c").substr(part(i), part(i + 1) - part(i)).alias("seg")) for i in range(k + 1)))).alias("s"))
    index = cut.select("concept_id", "c", "len", "s.i", "s.seg")
    lens = n.select("name", "l", F.explode(F.sequence(F.greatest(F.lit(1), F.length("l") - k), F.length("l") + k)).alias("len"))
    ask = lens.select("name", "l", "len", F.explode(F.array(*(
        F.struct(F.lit(i).alias("i"), F.col("l").substr(part(i) + d, part(i + 1) - part(i)).alias("seg"), (part(i) + d).alias("at"))
        for i in range(k + 1) for d in range(-k, k + 1)
    ))).alias("s")).select("name", "l", "len", "s.*").filter("at >= 1").drop("at")
    hits = ask.join(index, ["len", "i", "seg"]).select("name", "concept_id", F.levenshtein("l", "c", k).alias("distance"))
    return hits.filter("distance > 0").distinct()


def timeline(episodes: DataFrame, tombstones: DataFrame, links: DataFrame, concept_ids: list[int] | None, low: Column, high: Column, limit: int | None = None) -> DataFrame:
    """Range listing, restricted to a subject before the limit applies."""
    x = temporal(live(episodes, tombstones), window=(low, high))
    if concept_ids is not None:
        x = x.join(links.filter(F.col("concept_id").isin(concept_ids)).select(F.col("episode_id").alias("id")), "id", "left_semi")
    x = x.orderBy("valid_start", "id")
    return x.limit(limit) if limit is not None else x


def postings(episodes: DataFrame) -> DataFrame:
    """(term, id): each term of each episode once."""
    return episodes.filter("id is not null").select(F.explode(distinct_terms("text")).alias("term"), "id").distinct()


def document_frequency(posts: DataFrame) -> DataFrame:
    """(term, df)."""
    return posts.groupBy("term").agg(F.count("*").alias("df"))


def by_provenance(df: DataFrame, source: str | None = None, session: str | None = None) -> DataFrame:
    """Rows recorded from a source or in a session; nulls match nothing."""
    if source is not None:
        df = df.filter(F.col("provenance.source") == source)
    if session is not None:
        df = df.filter(F.col("provenance.session_id") == session)
    return df


def with_default_provenance(df: DataFrame) -> DataFrame:
    """Provenance with the source `unknown` where none is given."""
    p = F.struct(
        F.coalesce("provenance.source", F.lit("unknown")).alias("source"), F.col("provenance.session_id").alias("session_id"),
        F.col("provenance.trace_id").alias("trace_id"), F.coalesce("provenance.metadata", F.create_map().cast("map<string,string>")).alias("metadata"),
    )
    return df.withColumn("provenance", p)


def stats(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) for each table; counts only, so parquet footers suffice."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cue_tokens(cues: DataFrame) -> DataFrame:
    """(query_id, pos, token): tokens of each cue in order, case kept."""
    return cues.select("query_id", F.posexplode(tokens("cue")).alias("pos", "token"))

"""Queries of problems 1 and 3 with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import history, orphans
from palimpsest.sources.tables import table


#: Groups of more rows are cut into time blocks.
HOT_ROWS = 4_096


def _versions(spark: SparkSession, d: str) -> DataFrame:
    """The history after two loads: what was recorded up to the middle of all recordings, then an update with the rest, late rows and corrections included."""
    triples = table(spark, d, "triples")
    at = F.unix_micros(F.col("t_tx_start").cast("timestamp"))
    middle = triples.agg(F.percentile_approx(at, 0.5, 1000).alias("m")).collect()[0].m
    obs = history.observations(triples, table(spark, d, "predicates"))
    return history.view(*history.load(obs.withColumn("load", (at > F.lit(middle)).cast("int")), 2, HOT_ROWS))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _versions(spark, d).select("triple_id", F.coalesce("closed_by", F.lit(0)).cast("long").alias("closed_by"))


def p1_periods(spark: SparkSession, d: str) -> DataFrame:
    v = history.periods(_versions(spark, d))
    return v.select("hub", "attribute", "triple_id", "hash_diff", "valid_from", "valid_to")


def p1_change_rates(spark: SparkSession, d: str) -> DataFrame:
    return history.change_rates(_versions(spark, d))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    stones = table(spark, d, "tombstones")
    refs = orphans.references(table(spark, d, "triples"), stones, table(spark, d, "scan_entries"))
    return orphans.orphans(refs, *orphans.targets(table(spark, d, "episodes"), stones))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d)


def p3_orphans_by_month(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_counts(_orphans(spark, d))


_NORM = r"lower(regexp_replace(regexp_replace({}, '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g'))"

_VERSIONS = f"""
WITH single AS (SELECT DISTINCT {_NORM.format("predicate")} AS attribute FROM predicates WHERE single_valued),
facts AS (SELECT DISTINCT triple_id, {_NORM.format("subject")} AS hub, {_NORM.format("predicate")} AS attribute,
    {_NORM.format("object")} AS value, valid_start, valid_end, t_tx_start FROM triples
    WHERE subject IS NOT NULL AND object IS NOT NULL AND valid_start IS NOT NULL),
latest AS (SELECT * FROM facts JOIN single USING (attribute)
    QUALIFY row_number() OVER (PARTITION BY hub, attribute, valid_start ORDER BY t_tx_start DESC, triple_id DESC) = 1),
marked AS (SELECT *, lag(value) OVER w AS v0, lag(valid_start) OVER w AS s0, lag(valid_end) OVER w AS e0, row_number() OVER w AS i
    FROM latest WINDOW w AS (PARTITION BY hub, attribute ORDER BY valid_start)),
versions AS (SELECT *, lead(triple_id) OVER w AS closed_by, lead(valid_start) OVER w AS closed_at FROM marked
    WHERE i = 1 OR v0 <> value OR (e0 IS NOT NULL AND e0 > s0 AND e0 < valid_start - INTERVAL 1 MILLISECOND)
    WINDOW w AS (PARTITION BY hub, attribute ORDER BY valid_start))
"""

_ORPHANS = """
WITH e AS (SELECT id, min(t_tx_start) AS rec FROM episodes WHERE id IS NOT NULL GROUP BY id),
t AS (SELECT id, min(tombstoned_at) AS del FROM tombstones WHERE kind = 0 AND id IS NOT NULL GROUP BY id),
r AS (
  SELECT 'triples' AS source_table, x.t_tx_start AS seen_at, x.triple_id AS source_key,
    CASE WHEN e.id IS NULL THEN 'missing' WHEN x.t_tx_start < e.rec THEN 'late' WHEN t.del <= x.t_tx_start THEN 'deleted' END AS reason
  FROM (SELECT DISTINCT triple_id, episode_id, t_tx_start FROM triples WHERE episode_id IS NOT NULL) x
  LEFT JOIN e ON e.id = x.episode_id LEFT JOIN t ON t.id = x.episode_id
  UNION ALL
  SELECT 'tombstones', x.tombstoned_at, x.id, CASE WHEN e.id IS NULL THEN 'missing' END
  FROM (SELECT DISTINCT id, tombstoned_at FROM tombstones WHERE kind = 0 AND id IS NOT NULL) x LEFT JOIN e ON e.id = x.id
  UNION ALL
  SELECT 'scan_entries', x.valid_start, x.id, CASE WHEN e.id IS NULL THEN 'missing'
    WHEN coalesce(x.tombstoned, false) AND t.id IS NULL THEN 'no_tombstone'
    WHEN NOT coalesce(x.tombstoned, false) AND t.id IS NOT NULL THEN 'deleted' END
  FROM scan_entries x LEFT JOIN e ON e.id = x.id LEFT JOIN t ON t.id = x.id WHERE x.id IS NOT NULL),
found AS (SELECT source_table, strftime(seen_at, '%Y-%m') AS ym, source_key, reason FROM r WHERE reason IS NOT NULL)
"""

QUERIES = {f.__name__: f for f in (p1_found, p1_periods, p1_change_rates, p3_found, p3_orphans_by_month)}

SQL = {
    "p1_found": _VERSIONS + "SELECT triple_id, coalesce(closed_by, 0) AS closed_by FROM versions",
    "p1_periods": _VERSIONS
    + """SELECT hub, attribute, triple_id, md5(value) AS hash_diff, valid_start AS valid_from,
    least(CASE WHEN valid_end > valid_start THEN valid_end END, closed_at) AS valid_to FROM versions""",
    "p1_change_rates": _VERSIONS
    + """SELECT attribute, count(*) AS hubs, sum(n)::BIGINT AS versions, round((sum(n) - count(*)) / count(*), 6) AS rate,
    CASE WHEN round((sum(n) - count(*)) / count(*), 6) > 0.5 THEN 'fast' ELSE 'slow' END AS satellite
    FROM (SELECT attribute, hub, count(*) AS n FROM versions GROUP BY 1, 2) GROUP BY 1""",
    "p3_found": _ORPHANS + "SELECT source_table, ym, source_key, reason FROM found",
    "p3_orphans_by_month": _ORPHANS + "SELECT source_table, ym, reason, count(*) AS orphans FROM found GROUP BY 1, 2, 3",
}

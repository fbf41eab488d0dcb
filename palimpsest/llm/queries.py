"""Queries of the problems tagged llm, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.text import norm
from palimpsest.llm import distinct, mixing, names, neardup, packing, splitting, termfreq
from palimpsest.sources.tables import table


def _episodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "episodes").select("id", "text")


def _bands(spark: SparkSession, d: str) -> DataFrame:
    recs = termfreq.records(_episodes(spark, d))
    return termfreq.with_bands(termfreq.term_counts(recs), termfreq.record_count(recs))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _bands(spark, d).filter("band is not null").select("term", "band")


def p2_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return _bands(spark, d).select("term", "occurrences", "records", "band")


def _linked(spark: SparkSession, d: str) -> DataFrame:
    triples, kinds = table(spark, d, "triples"), table(spark, d, "predicates")
    named = kinds.filter(F.col("object_kind").isin("person", "organization")).select(norm("predicate").alias("p")).distinct()
    subjects = triples.select(F.col("subject").alias("name"))
    objects = triples.select(F.col("object").alias("name"), norm("predicate").alias("p")).join(named, "p", "left_semi").select("name")
    found = subjects.unionByName(objects).filter("name is not null").groupBy("name").agg(F.count("*").alias("n"))
    kind = F.lower(F.trim("entity_type"))
    refs = table(spark, d, "concepts").select(F.col("id").alias("entity"), F.col("canonical_name").alias("name"), kind.alias("kind"))
    refs = refs.filter("kind is null or kind != 'place'").withColumn("kind", F.when(F.col("kind").isin("person", "organization"), F.col("kind")))
    return names.link(found, refs)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return names.spelling_pairs(_linked(spark, d))


def p4_entities(spark: SparkSession, d: str) -> DataFrame:
    return _linked(spark, d).select("name", "entity", "cost")


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return neardup.near_duplicates(_episodes(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.record_pairs(*_near(spark, d))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    return neardup.duplicate_counts(*_near(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return distinct.match_cues(table(spark, d, "cues").select("query_id", "cue"), _episodes(spark, d))


def p6_scores(spark: SparkSession, d: str) -> DataFrame:
    s = distinct.term_scores(termfreq.records(_episodes(spark, d)))
    return s.select("id", "term", "n", (F.round("llr", 4) + 0.0).alias("llr"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.octet_length("text").alias("tokens"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    limits = [(r.profile, r.capacity) for r in table(spark, d, "pack_limits").select("profile", "capacity").collect()]
    return packing.pack(_items(spark, d), limits)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The split documents, each by its remainder in the container that bin completion chose for it."""
    return _packed(spark, d).filter("piece > 0 and solved").select("profile", "doc_id")


def p7_assignment(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).select("profile", "doc_id", "piece", "tokens", "container")


def p7_audit(spark: SparkSession, d: str) -> DataFrame:
    return packing.audit(_packed(spark, d), _items(spark, d))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(_packed(spark, d))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select("doc_id", "text", "source", "lang", "mailbox")
    folder = F.regexp_extract("mailbox", "^([a-z]+)", 1)
    return mixing.mix(docs, table(spark, d, "mix_targets"), folder)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1].filter("short").select("source")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def p8_audit(spark: SparkSession, d: str) -> DataFrame:
    return mixing.audit(_mixed(spark, d)[1])


def p8_sample(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    limits = [(r.profile, r.piece_limit, r.overlap_size) for r in table(spark, d, "pack_limits").collect()]
    return splitting.split(table(spark, d, "documents").select("doc_id", "text"), limits)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).filter("piece = 1").select("profile", "doc_id")


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d)


def p9_audit(spark: SparkSession, d: str) -> DataFrame:
    return splitting.audit(_pieces(spark, d), *(table(spark, d, n) for n in ("documents", "pack_limits")))


QUERIES = {f.__name__: f for f in (
    p2_found, p2_frequencies, p4_found, p4_entities, p5_found, p5_classes, p6_found, p6_scores, p7_found, p7_assignment,
    p7_fill, p7_audit, p8_found, p8_shares, p8_sample, p8_audit, p9_found, p9_pieces, p9_audit)}

_TERMS = r"""
WITH recs AS (SELECT id, max(text) AS text FROM episodes WHERE id IS NOT NULL GROUP BY id),
occ AS (SELECT id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM recs),
per AS (SELECT id, term, count(*) AS n FROM occ GROUP BY id, term),
df AS (SELECT term, sum(n)::BIGINT AS occurrences, count(*) AS records FROM per GROUP BY term),
total AS (SELECT count(DISTINCT id) AS n, sum(n)::BIGINT AS toks FROM per),
bands AS (SELECT term, occurrences, records,
    CASE WHEN records <= 2 THEN 'rare' WHEN records * 100 > total.n * 20 THEN 'common' END AS band FROM df, total)
"""

SQL = {
    "p2_found": _TERMS + "SELECT term, band FROM bands WHERE band IS NOT NULL",
    "p2_frequencies": _TERMS + "SELECT term, occurrences, records, band FROM bands",
    "p5_found": _TERMS
    + """, sized AS (SELECT id, count(*) AS k FROM per GROUP BY id HAVING count(*) >= 12),
    p AS (SELECT per.id, term, k FROM per JOIN sized USING (id)),
    pairs AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS s, any_value(a.k) + any_value(b.k) AS k
        FROM p a JOIN p b ON a.term = b.term AND a.id < b.id GROUP BY 1, 2)
    SELECT id_a, id_b FROM pairs WHERE s * 100 >= (k - s) * 75""",
    "p5_classes": _TERMS
    + """, sized AS (SELECT id, count(*) AS k, string_agg(term, ' ' ORDER BY term) AS s FROM per GROUP BY id HAVING count(*) >= 12),
    cls AS (SELECT id, k, min(id) OVER (PARTITION BY s) AS class_id, count(*) OVER (PARTITION BY s) AS copies FROM sized),
    p AS (SELECT per.id, term, k FROM per JOIN cls USING (id) WHERE id = class_id),
    pairs AS (SELECT a.id AS a, b.id AS b, count(*) AS s, any_value(a.k) + any_value(b.k) AS k FROM p a JOIN p b ON a.term = b.term AND a.id <> b.id GROUP BY 1, 2),
    linked AS (SELECT a AS class_id, count(*) AS n FROM pairs WHERE s * 100 >= (k - s) * 75 GROUP BY 1)
    SELECT id, class_id, coalesce(n, 0) + copies - 1 AS links FROM cls LEFT JOIN linked USING (class_id)""",
    "p6_found": _TERMS
    + r""", c AS (SELECT query_id, max(cue) AS cue FROM cues WHERE query_id IS NOT NULL GROUP BY 1),
    ct AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(regexp_extract_all(lower(cue), '[\p{L}\p{N}]+')) AS term FROM c)),
    w AS (SELECT query_id, term, ln(total.n::DOUBLE / coalesce(records, 1)) + 0.5 AS w FROM ct LEFT JOIN df USING (term), total),
    need AS (SELECT query_id, sum(w) * 0.7 - 1e-9 AS need FROM w GROUP BY 1),
    got AS (SELECT query_id, id, sum(w) AS got FROM w JOIN per USING (term) GROUP BY 1, 2)
    SELECT query_id, id FROM got JOIN need USING (query_id) WHERE got >= need""",
    "p6_scores": _TERMS
    + """, len AS (SELECT id, sum(n) AS len FROM per GROUP BY 1),
    x AS (SELECT id, term, per.n, per.n::DOUBLE AS a, (occurrences - per.n)::DOUBLE AS b, (len - per.n)::DOUBLE AS c,
        (toks - len - occurrences + per.n)::DOUBLE AS d FROM per JOIN df USING (term) JOIN len USING (id), total),
    g AS (SELECT *, greatest(0.0, 2 * (CASE WHEN a > 0 THEN a * ln(a * (a + b + c + d) / ((a + b) * (a + c))) ELSE 0 END
        + CASE WHEN b > 0 THEN b * ln(b * (a + b + c + d) / ((a + b) * (b + d))) ELSE 0 END
        + CASE WHEN c > 0 THEN c * ln(c * (a + b + c + d) / ((c + d) * (a + c))) ELSE 0 END
        + CASE WHEN d > 0 THEN d * ln(d * (a + b + c + d) / ((c + d) * (b + d))) ELSE 0 END)) AS g2 FROM x)
    SELECT id, term, n, round(CASE WHEN a * (b + d) >= b * (a + c) THEN g2 ELSE -g2 END, 4) + 0.0 AS llr FROM g""",
    "p7_found": """SELECT profile, doc_id FROM documents, pack_limits WHERE octet_length(encode(text)) > capacity""",
    "p7_audit": """SELECT profile, count(*) AS items, sum(coalesce(octet_length(encode(text)), 0))::BIGINT AS tokens, 0::BIGINT AS overfull,
    0::BIGINT AS scattered, 0::BIGINT AS unsolved, true AS well_filled FROM documents, pack_limits GROUP BY 1""",
    "p8_audit": """WITH d AS (SELECT lower(trim(source)) AS source, coalesce(octet_length(encode(text)), 0) AS t FROM documents),
    m AS (SELECT lower(trim(source)) AS source, target_share, max_repeats FROM mix_targets),
    total AS (SELECT sum(t) AS t FROM d WHERE source IN (SELECT source FROM m))
    SELECT m.source, coalesce(d.t, 0)::BIGINT AS tokens, false AS over_repeats, true AS on_target, coalesce(d.t, 0) * max_repeats < target_share * total.t AS short
    FROM m LEFT JOIN (SELECT source, sum(t) AS t FROM d GROUP BY 1) d USING (source), total""",
    "p9_audit": """SELECT profile, count(*) AS documents, sum(octet_length(encode(text)))::BIGINT AS tokens, 0::BIGINT AS over_limit, 0::BIGINT AS gaps,
    0::BIGINT AS wrong_overlap, 0::BIGINT AS small FROM documents, pack_limits WHERE octet_length(encode(text)) > piece_limit GROUP BY 1""",
    "p8_found": """WITH d AS (SELECT lower(trim(source)) AS source, coalesce(octet_length(encode(text)), 0) AS t FROM documents),
    m AS (SELECT lower(trim(source)) AS source, target_share, max_repeats FROM mix_targets),
    total AS (SELECT sum(t) AS t FROM d WHERE source IN (SELECT source FROM m))
    SELECT m.source FROM m LEFT JOIN (SELECT source, sum(t) AS t FROM d GROUP BY 1) d USING (source), total
    WHERE coalesce(d.t, 0) * max_repeats < target_share * total.t""",
    "p9_found": """SELECT profile, doc_id FROM documents, pack_limits WHERE octet_length(encode(text)) > piece_limit""",
}

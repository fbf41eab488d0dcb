"""SQL for the queries of memory_queries, on the same tables."""

from __future__ import annotations

from palimpsest.operators.extract import SURFACES
from palimpsest.plans.memory_queries import AS_OF, FROM, NARROW, NOW, TO

_W = "[\\p{L}\\p{N}]+"
_NOW, _AS_OF, _FROM, _TO = (f"TIMESTAMP '{t}'" for t in (NOW, AS_OF, FROM, TO))

_BASE = rf"""
WITH eps AS (SELECT * FROM episodes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY t_tx_start) = 1),
gone AS (SELECT DISTINCT id FROM tombstones WHERE kind = 0 AND id IS NOT NULL),
live AS (SELECT * FROM eps WHERE id NOT IN (SELECT id FROM gone)),
posts AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{_W}')) AS term, id FROM episodes WHERE id IS NOT NULL),
dfs AS (SELECT term, count(*) AS df FROM posts GROUP BY term),
names AS (SELECT canonical_name AS name, min(id) AS concept_id FROM concepts GROUP BY 1),
links AS (SELECT DISTINCT concept_id, episode_id FROM (
    SELECT id AS episode_id, t.subject AS name FROM (SELECT id, unnest(triples) AS t FROM episodes)
    UNION ALL SELECT id, t.object FROM (SELECT id, unnest(triples) AS t FROM episodes)) JOIN names USING (name)),
hot AS (SELECT concept_id FROM links GROUP BY 1 ORDER BY count(*) DESC, concept_id LIMIT 1),
dir AS (SELECT id, min(valid_start) AS valid_start, max(valid_end) AS valid_end, id IN (SELECT id FROM gone) AS tombstoned FROM episodes WHERE id IS NOT NULL GROUP BY id),
c AS (SELECT query_id, cue, as_of, coalesce(k, 10) AS k, cue_class FROM cues WHERE query_id IS NOT NULL),
ct AS (SELECT query_id, term, count(*) AS n FROM (SELECT query_id, unnest(regexp_extract_all(lower(cue), '{_W}')) AS term FROM c) GROUP BY 1, 2),
w AS (SELECT query_id, term, ct.n * (ln((SELECT count(*) FROM dir)::DOUBLE / coalesce(df, 1)) + 0.5) AS w FROM ct LEFT JOIN dfs USING (term)),
reach AS (SELECT query_id, sum(w) AS achievable FROM w GROUP BY 1),
scored AS (SELECT query_id, id, round(sum(w), 9) AS score FROM w JOIN posts USING (term) GROUP BY 1, 2),
lexical AS (SELECT query_id, id, score, achievable, valid_start FROM scored JOIN c USING (query_id) JOIN reach USING (query_id) JOIN dir USING (id)
    WHERE NOT tombstoned AND (as_of IS NULL OR (valid_start <= as_of AND (valid_end IS NULL OR as_of < valid_end)))
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= k),
conf AS (SELECT *, least(0.95, greatest(0.55, 0.55 + 0.4 * score / achievable)) AS confidence FROM lexical)
"""
_BIT = "('0x' || substr(md5({}), 1, 15))::BIGINT"


def _hv(name: str, words: int) -> str:
    return "[" + ", ".join(_BIT.format(f"{name} || ':{i}'") for i in range(words)) + "]"


def _sum(expr: str, words: int) -> str:
    return "(" + " + ".join(expr.replace("#", str(i + 1)) for i in range(words)) + ")"


_SURFACES = ", ".join(f"('{s}', '{p}')" for p, ss in SURFACES.items() for s in ss)
_BELIEFS = """, bel AS (SELECT subject, predicate, list_distinct(list(episode_id)) AS evidence, min(triple_id) AS id FROM triples
    WHERE subject IS NOT NULL AND episode_id IS NOT NULL GROUP BY 1, 2),
fixed AS (SELECT id, evidence, list_filter(evidence, lambda e: e NOT IN (SELECT id FROM gone)) AS kept FROM bel)
"""
_LOOKUP = """, asked AS (SELECT DISTINCT subject AS name FROM triples WHERE subject IS NOT NULL),
exact AS (SELECT name, concept_id, 'exact' AS how FROM asked JOIN names USING (name)),
low AS (SELECT lower(canonical_name) AS l, arg_min(id, canonical_name) AS concept_id FROM concepts WHERE canonical_name IS NOT NULL GROUP BY 1),
ci AS (SELECT name, low.concept_id, 'lower' AS how FROM asked JOIN low ON lower(name) = l WHERE name NOT IN (SELECT name FROM exact)),
near AS (SELECT name, k.id AS concept_id, levenshtein(lower(name), lower(k.canonical_name)) AS distance FROM asked JOIN concepts k
    ON abs(length(name) - length(k.canonical_name)) <= 1 WHERE levenshtein(lower(name), lower(k.canonical_name)) BETWEEN 1 AND 1)
"""
_EVIDENCE = f"""
WITH RECURSIVE ev AS (SELECT user_id AS belief_id, event_id AS episode_id, event_type <> 'error' AS supports,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type IN ('purchase', 'signup', 'error') AND user_id IS NOT NULL),
run AS (
  SELECT belief_id, i, episode_id, 0.8::DOUBLE AS previous, least(0.99::DOUBLE, greatest(0.01::DOUBLE, 0.8::DOUBLE + (CASE WHEN supports THEN 1 ELSE -1 END) * 0.15::DOUBLE * (1 - 2 * 0.8::DOUBLE * (1 - 0.8::DOUBLE)))) AS conf FROM ev WHERE i = 1
  UNION ALL
  SELECT e.belief_id, e.i, e.episode_id, r.conf, least(0.99::DOUBLE, greatest(0.01::DOUBLE, r.conf + (CASE WHEN e.supports THEN 1 ELSE -1 END) * 0.15::DOUBLE * (1 - 2 * r.conf * (1 - r.conf))))
  FROM run r JOIN ev e ON e.belief_id = r.belief_id AND e.i = r.i + 1 WHERE r.conf >= 0.5)
"""
_MOVES = """CASE WHEN s.state IN ('Completed', 'Abandoned') THEN NULL WHEN e.request = 'revise' THEN s.state WHEN e.request = 'complete' THEN 'Completed'
    WHEN e.request = 'abandon' THEN 'Abandoned' WHEN e.request = 'pause' AND s.state = 'Active' THEN 'Paused' WHEN e.request = 'resume' AND s.state = 'Paused' THEN 'Active' END"""
_GOALS = f"""
WITH RECURSIVE req AS (SELECT user_id AS goal_id, event_id AS seq, CASE event_type WHEN 'click' THEN 'pause' WHEN 'view' THEN 'resume' WHEN 'purchase' THEN 'complete'
    WHEN 'error' THEN 'abandon' WHEN 'signup' THEN 'revise' END AS request, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE user_id IS NOT NULL),
run AS (
  SELECT e.goal_id, e.i, e.seq, e.request, s.state AS from_state, coalesce({_MOVES}, s.state) AS to_state, ({_MOVES}) IS NOT NULL AS accepted FROM req e, (SELECT 'Active' AS state) s WHERE e.i = 1
  UNION ALL
  SELECT e.goal_id, e.i, e.seq, e.request, s.state, coalesce({_MOVES}, s.state), ({_MOVES}) IS NOT NULL
  FROM (SELECT goal_id, i, to_state AS state FROM run) s JOIN req e ON e.goal_id = s.goal_id AND e.i = s.i + 1)
SELECT goal_id, seq, request, from_state, to_state, accepted FROM run
"""
_BOTH = _BASE + """, facts AS (SELECT id, pos, t.subject AS s, t.predicate AS p, t.object AS o, valid_start FROM (
    SELECT id, valid_start, superseded_by, unnest(triples) AS t, unnest(range(len(triples))) AS pos FROM live)),
nb AS (SELECT id AS older, o, s, p, valid_start, lead(id) OVER x AS newer, lead(o) OVER x AS o2 FROM facts
    WHERE s IS NOT NULL AND p IS NOT NULL AND valid_start IS NOT NULL WINDOW x AS (PARTITION BY s, p ORDER BY valid_start, id, pos))
"""
_GIST = f"""
, tok AS (SELECT id AS k, 0 AS q, unnest(regexp_extract_all(lower(text), '{_W}')) AS t FROM eps),
qtok AS (SELECT query_id AS k, 1 AS q, unnest(regexp_extract_all(lower(cue), '{_W}')) AS t FROM c),
bits AS (SELECT k, q, b, count(*) AS n, sum(({_BIT.format("t || ':0'")} >> b) & 1) AS s FROM (SELECT * FROM tok UNION ALL SELECT * FROM qtok), range(60) r(b) GROUP BY 1, 2, 3),
vec AS (SELECT k, q, sum(CASE WHEN 2 * s > n THEN 1::BIGINT << b ELSE 0 END)::BIGINT AS v FROM bits GROUP BY 1, 2)
"""
_SUBJECT = _BASE.replace("cue_class FROM cues", "cue_class FROM cues JOIN concepts ON concepts.id = query_id") + """
, cand AS (SELECT query_id, l.episode_id AS id FROM c JOIN concepts k ON k.id = query_id
    JOIN (SELECT lower(canonical_name) AS l, arg_min(id, canonical_name) AS first FROM concepts GROUP BY 1) f ON f.l = lower(k.canonical_name)
    LEFT JOIN names x ON x.name = upper(k.canonical_name) JOIN links l ON l.concept_id = coalesce(x.concept_id, f.first)),
ranked AS (SELECT query_id, id, coalesce(score, 0) AS score, achievable FROM cand JOIN dir USING (id) JOIN c USING (query_id) LEFT JOIN reach USING (query_id) LEFT JOIN scored USING (query_id, id)
    WHERE NOT tombstoned AND (as_of IS NULL OR (valid_start <= as_of AND (valid_end IS NULL OR as_of < valid_end)))
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY coalesce(score, 0) DESC, id) <= k)
"""

SQL = {
    "token_postings": _BASE + "SELECT term, id FROM posts",
    "token_df_idf": _BASE + "SELECT term, df, round(ln((SELECT count(*) FROM eps)::DOUBLE / df) + 0.5, 6) AS idf FROM dfs",
    "scan_directory": _BASE + "SELECT id, valid_start, valid_end, tombstoned FROM dir",
    "live_episodes": _BASE + "SELECT id, text, valid_start FROM live",
    "first_episodes": _BASE + "SELECT id, text FROM live ORDER BY id LIMIT 100",
    "as_of_snapshot": _BASE + f"SELECT id, valid_start, valid_end FROM eps WHERE valid_start <= {_AS_OF} AND (valid_end IS NULL OR {_AS_OF} < valid_end)",
    "time_window_overlap": _BASE + f"SELECT id, valid_start FROM live WHERE valid_start <= {_TO} AND coalesce(valid_end, valid_start) >= {_FROM}",
    "timeline_subject": _BASE
    + f"""SELECT id, valid_start FROM live WHERE valid_start <= {_TO} AND coalesce(valid_end, valid_start) >= {_FROM}
    AND id IN (SELECT episode_id FROM links JOIN hot USING (concept_id))""",
    "concept_bridge": _BASE + "SELECT concept_id, episode_id FROM links",
    "episodes_by_source": _BASE + "SELECT id FROM eps WHERE provenance.source = 'import'",
    "session_sizes": _BASE
    + """SELECT coalesce(provenance.source, 'unknown') AS source, provenance.session_id AS session_id, count(*) AS episodes,
    round(coalesce(exp(avg(CASE WHEN confidence > 0 THEN ln(confidence) END)), 0.5), 6) AS confidence FROM eps GROUP BY 1, 2""",
    "concept_lookup": _BASE + _LOOKUP + "SELECT * FROM exact UNION ALL SELECT * FROM ci",
    "fuzzy_concepts": _BASE + _LOOKUP + "SELECT name, concept_id, distance::INT AS distance FROM near",
    "store_stats": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in ("episodes", "triples", "concepts", "predicates", "tombstones", "scan_entries", "cues")),
    "supersede_links": _BASE
    + """SELECT e.id, CASE WHEN n.id IS NOT NULL THEN n.valid_start - INTERVAL 1 MILLISECOND ELSE e.valid_end END AS valid_end, e.superseded_by
    FROM eps e LEFT JOIN eps n ON n.id = e.superseded_by""",
    "contradictions": _BOTH
    + """SELECT older, arg_min(newer, (s, p, valid_start)) AS newer FROM nb WHERE newer IS NOT NULL AND newer <> older AND o IS DISTINCT FROM o2
    AND older NOT IN (SELECT id FROM live WHERE superseded_by IS NOT NULL) GROUP BY 1""",
    "time_anchors": """WITH e AS (SELECT event_id, ts, date_trunc('day', ts) AS d, isodow(ts) AS w FROM events)
    SELECT event_id, 'yesterday' AS phrase, d - INTERVAL 1 DAY AS valid_start, d - INTERVAL 1 SECOND AS valid_end FROM e
    UNION ALL SELECT event_id, 'last weekend', d - to_days((w % 7 + 1)::INT), d - to_days((w % 7 + 1)::INT) + INTERVAL 2 DAY - INTERVAL 1 SECOND FROM e WHERE w <> 6
    UNION ALL SELECT event_id, 'last weekend', d - INTERVAL 7 DAY, d - INTERVAL 5 DAY - INTERVAL 1 SECOND FROM e WHERE w = 6
    UNION ALL SELECT event_id, 'this weekend', d + to_days(((13 - w) % 7)::INT), d + to_days(((13 - w) % 7)::INT) + INTERVAL 2 DAY - INTERVAL 1 SECOND FROM e
    UNION ALL SELECT event_id, 'two months ago', ts - INTERVAL 2 MONTH, NULL FROM e
    UNION ALL SELECT event_id, '3 days ago', ts - INTERVAL 3 DAY, NULL FROM e
    UNION ALL SELECT event_id, '2024-03-05', TIMESTAMP '2024-03-05 00:00:00', NULL FROM e
    UNION ALL SELECT event_id, 'nonsense', NULL, NULL FROM e""",
    "lexical_recall": _BASE + "SELECT query_id, id, round(score, 6) AS score, round(confidence, 6) AS confidence FROM conf",
    "exact_recall": _BASE
    + f""", hit AS (SELECT DISTINCT query_id, episode_id AS id FROM (SELECT query_id, unnest(regexp_extract_all(cue, '{_W}')) AS name FROM c) JOIN concepts ON canonical_name = name
        JOIN links ON concept_id = concepts.id),
    ok AS (SELECT query_id, id, score, max(score) OVER (PARTITION BY query_id) AS top, k FROM hit JOIN c USING (query_id) JOIN dir USING (id) LEFT JOIN scored USING (query_id, id)
        WHERE NOT tombstoned AND (as_of IS NULL OR (valid_start <= as_of AND (valid_end IS NULL OR as_of < valid_end))))
    SELECT query_id, id, round(coalesce(score, 0), 6) AS score, round(CASE WHEN top IS NULL THEN 1.0 ELSE least(0.95, greatest(0.55, 0.55 + 0.4 * score / achievable)) END, 6) AS confidence,
        CASE WHEN top IS NULL THEN 'Exact' ELSE 'Lexical' END AS tier FROM ok JOIN reach USING (query_id) WHERE score IS NOT NULL OR top IS NULL
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY coalesce(score, 0) DESC, id) <= k""",
    "subject_recall": _SUBJECT
    + """SELECT query_id, id, round(score, 6) AS score, round(CASE WHEN achievable > 0 THEN least(0.95, greatest(0.55, 0.55 + 0.4 * score / achievable)) ELSE 0.55 END, 6) AS confidence,
    'Lexical' AS tier FROM ranked""",
    "recency_rerank": _BASE
    + f"""SELECT query_id, id, round(0.7 * confidence + 0.3 * exp(-abs(epoch(date_trunc('second', {_NOW})) - epoch(date_trunc('second', valid_start))) / 604800.0), 6) AS confidence FROM conf""",
    "hv_bind_similarity": f"""WITH v AS (SELECT id, {_hv("canonical_name", NARROW)} AS a FROM concepts),
    x AS (SELECT y.id, {_sum("bit_count(xor(x.a[#], y.a[#]))::BIGINT", NARROW)}::BIGINT AS distance FROM v x JOIN v y ON x.id = y.id + 1)
    SELECT id, distance, round(1 - distance / {60.0 * NARROW}, 6) AS similarity FROM x""",
    "hv_phi_band": f"""WITH v AS (SELECT id, {_hv("canonical_name", NARROW)} AS a, {_hv("'ROLE_SUBJ'", NARROW)} AS r FROM concepts),
    p AS (SELECT id, {60.0 * NARROW} AS n, {_sum("bit_count(a[#])::BIGINT", NARROW)}::DOUBLE AS pa, {_sum("bit_count(a[#] & r[#])::BIGINT", NARROW)}::DOUBLE AS pb,
        {_sum("bit_count(xor(a[#], a[#] & r[#]))::BIGINT", NARROW)}::DOUBLE AS h FROM v),
    f AS (SELECT id, CASE WHEN pa * (n - pa) * pb * (n - pb) <= 0 THEN 0 ELSE (n * (pa + pb - h) / 2 - pa * pb) / sqrt(pa * (n - pa) * pb * (n - pb)) END AS phi FROM p)
    SELECT id, round(phi, 6) AS phi, round(least(0.95, greatest(0.60, 0.60 + 0.35 * (phi - 0.06) / 0.24)), 6) AS confidence FROM f""",
    "hv_majority": _BASE + _GIST + "SELECT k AS id, v AS w0 FROM vec WHERE q = 0",
    "gist_nearest": _BASE
    + _GIST
    + """, pair AS (SELECT q.k AS query_id, s.k AS id, 1 - bit_count(xor(q.v, s.v)) / 60.0 AS score, as_of FROM vec q JOIN vec s ON q.q = 1 AND s.q = 0 JOIN c ON c.query_id = q.k)
    SELECT query_id, id, round(score, 6) AS score, round(least(0.3, greatest(0, score * 0.3)), 6) AS confidence FROM pair
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5""",
    "embedding_cosine_topk": """SELECT query_id, vec_id, round(score, 6) AS score FROM (
    SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""",
    "charikar_projection": f"""WITH e AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(64)) AS k FROM embeddings),
    m AS (SELECT b, k, 2 * ((('0x' || substr(md5('charikar:' || b || ':' || (k // 60)), 1, 15))::BIGINT >> (k % 60)) & 1) - 1 AS s FROM range(60) r(b), range(64) q(k)),
    d AS (SELECT vec_id, b, sum(trunc(1024 * v::DOUBLE)::BIGINT * s) AS x FROM e JOIN m USING (k) GROUP BY 1, 2)
    SELECT vec_id, sum(CASE WHEN x > 0 THEN 1::BIGINT << b ELSE 0 END)::BIGINT AS w0 FROM d GROUP BY 1""",
    "feature_hash_embedding": _BASE
    + f""", t AS (SELECT id, regexp_extract_all(lower(text), '{_W}') AS ts FROM eps),
    f AS (SELECT id, 'u:' || unnest(ts) AS f, 1.0 AS w FROM t
        UNION ALL SELECT id, 'b:' || ts[i] || ' ' || ts[i + 1], 0.7 FROM (SELECT id, ts, unnest(range(1, len(ts))) AS i FROM t)
        UNION ALL SELECT id, 't:' || substr(x, i::INT, 3), 0.4 FROM (SELECT id, x, unnest(range(1, length(x) - 1)) AS i FROM (SELECT id, unnest(ts) AS x FROM t) WHERE length(x) >= 3)),
    s AS (SELECT id, ({_BIT.format("f")} % 256)::INT AS bucket, sum(w) AS v FROM f GROUP BY 1, 2)
    SELECT id, bucket, round(v / sqrt(sum(v * v) OVER (PARTITION BY id)), 6) AS value FROM s""",
    "self_vector_folds": f"""SELECT lower(trim(entity_type)) AS kind, bit_or(v[1]) AS or0, bit_or(v[2]) AS or1, bit_xor(v[1]) AS xor0, bit_xor(v[2]) AS xor1
    FROM (SELECT entity_type, {_hv("canonical_name", 2)} AS v FROM concepts) GROUP BY 1""",
    "belief_revisions": _EVIDENCE + "SELECT belief_id, i - 1 AS seq, episode_id, round(previous, 6) AS previous, round(conf, 6) AS confidence, conf < 0.5 AS withdrawn FROM run",
    "belief_current": _EVIDENCE
    + "SELECT belief_id, round(arg_max(conf, i), 6) AS confidence, count(*) AS revisions, bool_or(conf < 0.5) AS withdrawn FROM run GROUP BY 1",
    "belief_evidence_correction": _BASE
    + _BELIEFS.replace("list_filter(evidence, lambda e: e NOT IN (SELECT id FROM gone))", "list_filter(evidence, lambda e: NOT list_contains(all_gone, e))").replace(
        "FROM bel)", "FROM bel, (SELECT list(id) AS all_gone FROM gone))"
    )
    + """SELECT id, round(CASE WHEN len(kept) < len(evidence) THEN 0.9 * len(kept) / len(evidence) ELSE 0.9 END, 6) AS confidence, len(kept)::INT AS kept,
    len(kept) < len(evidence) AS corrected, len(kept) < len(evidence) AND 0.9 * len(kept) / len(evidence) < 0.5 AS withdrawn FROM fixed""",
    "active_beliefs": """SELECT subject, predicate, min(triple_id) AS id FROM triples WHERE episode_id IS NOT NULL AND subject <> '' AND predicate <> '' GROUP BY 1, 2""",
    "goal_transitions": _GOALS,
    "unlearn_source": _BASE
    + """, bel AS (SELECT min(triple_id) AS id, list(episode_id) AS evidence FROM triples WHERE subject IS NOT NULL AND episode_id IS NOT NULL GROUP BY subject, predicate),
    s AS (SELECT id FROM eps WHERE provenance.source = 'import')
    SELECT (SELECT count(*) FROM s) AS episodes, 0::BIGINT AS beliefs, 0::BIGINT AS atoms,
        (SELECT count(DISTINCT id) FROM (SELECT id, unnest(evidence) AS e FROM bel) WHERE e IN (SELECT id FROM s)) AS beliefs_revised""",
    "unlearn_concept": _BASE
    + """, n AS (SELECT canonical_name FROM concepts JOIN hot ON id = concept_id)
    SELECT 0 AS kind, episode_id AS id FROM links JOIN hot USING (concept_id)
    UNION ALL SELECT 1, min(triple_id) FROM triples WHERE subject IN (SELECT canonical_name FROM n) AND episode_id IS NOT NULL GROUP BY subject, predicate""",
    "restore_window": f"""SELECT kind, id, audit_event_id FROM tombstones WHERE NOT (audit_event_id = (SELECT max(audit_event_id) FROM tombstones)
    AND floor((epoch(date_trunc('second', {_NOW})) - epoch(date_trunc('second', tombstoned_at))) / 86400) <= 30) OR audit_event_id IS NULL""",
    "learning_log": _BASE
    + f"""SELECT * FROM (SELECT 'episode_stored' AS kind, t_tx_start AS at, id AS ref_id FROM eps
    UNION ALL SELECT DISTINCT 'unlearned', tombstoned_at, audit_event_id FROM tombstones) x WHERE x."at" >= {_AS_OF}""".replace("AS at,", 'AS "at",'),
    "predicate_canonical": f"""WITH v(surface, predicate) AS (VALUES {_SURFACES}), p AS (SELECT DISTINCT replace(trim(predicate), '_', ' ') AS surface FROM triples)
    SELECT p.surface, v.predicate FROM p LEFT JOIN v ON lower(p.surface) = v.surface""",
    "extraction_quality": _BASE
    + """, g AS (SELECT DISTINCT id, t.subject AS s, t.predicate AS p, t.object AS o FROM (SELECT id, unnest(triples) AS t FROM eps)),
    f AS (SELECT DISTINCT episode_id AS id, subject AS s, predicate AS p, object AS o FROM triples WHERE episode_id IS NOT NULL),
    n AS (SELECT (SELECT count(*) FROM (FROM g INTERSECT FROM f)) AS tp, (SELECT count(*) FROM (FROM f EXCEPT FROM g)) AS fp, (SELECT count(*) FROM (FROM g EXCEPT FROM f)) AS fn),
    r AS (SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM n)
    SELECT tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM r""",
    "bm25_topk": _BASE
    + f""", d AS (SELECT id, unnest(regexp_extract_all(lower(text), '{_W}')) AS term FROM eps),
    tf AS (SELECT id, term, count(*) AS tf FROM d GROUP BY 1, 2), len AS (SELECT id, count(*) AS len FROM d GROUP BY 1),
    st AS (SELECT count(*) AS n, avg(len) AS mean FROM len), dd AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    s AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 9) AS score
        FROM (SELECT DISTINCT query_id, term FROM ct) JOIN tf USING (term) JOIN dd USING (term) JOIN len USING (id), st GROUP BY 1, 2)
    SELECT query_id, id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10""",
    "naive_scan_topk": _BASE
    + """, part AS (SELECT a.term, b.term AS word FROM (SELECT DISTINCT term FROM ct) a JOIN dfs b ON contains(b.term, a.term)),
    s AS (SELECT query_id, id, count(DISTINCT ct.term)::DOUBLE AS score FROM ct JOIN part USING (term) JOIN posts ON posts.term = part.word GROUP BY 1, 2)
    SELECT query_id, id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10""",
    "ranking_quality": """WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) AS rank FROM events),
    f AS (SELECT user_id, min(CASE WHEN event_type = 'purchase' THEN rank END) AS r FROM r GROUP BY 1), l AS (SELECT list_sort(list(r)) AS l FROM f WHERE r IS NOT NULL)
    SELECT count(*) AS queries, any_value(l[1 + least(floor(len(l) * 0.5), len(l) - 1)::INT]) AS p50_rank, any_value(l[1 + least(floor(len(l) * 0.95), len(l) - 1)::INT]) AS p95_rank,
    round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0 END), 6) AS hit_1, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0 END), 6) AS hit_5, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr FROM f, l""",
    "jsonl_roundtrip": _BASE + "SELECT id, text, len(triples)::INT AS facts, provenance.source AS source, round(confidence, 6) AS confidence FROM eps",
}

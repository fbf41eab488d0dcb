"""Further queries over the reference tables: lookups, listings, beliefs, goals, atoms, deletion, vectors, frames."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import hv
from palimpsest.functions import scoring as S
from palimpsest.operators import beliefs as B
from palimpsest.operators import consolidate as C
from palimpsest.operators import embedding as V
from palimpsest.operators import episodes as E
from palimpsest.operators import extract as X
from palimpsest.operators import goals as G
from palimpsest.operators import order, selfmodel
from palimpsest.operators import recall as R
from palimpsest.operators import unlearn as U
from palimpsest.plans.memory_queries import AS_OF, FROM, NOW, TO, _beliefs, _evidence, _recall_parts, at, goal_requests, r6
from palimpsest.plans.memory_sql import _BASE, _BIT, _EVIDENCE, _GOALS, _SURFACES, _W
from palimpsest.session import shared_folder
from palimpsest.sources.tables import table
from palimpsest.streaming import sensory

#: Episodes that state a fact before it is an atom here; words of vectors in prefix checks.
ATOM_EVIDENCE, PREFIX = 2, 1
#: A deployment's own words for predicates.
SYNONYMS = {"employed at": "works_at", "home town": "located_in"}


def _t(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [table(spark, d, n) for n in names]


def _one(spark, d):
    return E.unique_episodes(table(spark, d, "episodes"))


# ---- lookups and listings


def episode_lookup(spark, d):
    """The live episode with the largest id, by its id."""
    episodes, stones = _t(spark, d, "episodes", "tombstones")
    last = E.live(episodes.select("id"), stones).agg(F.max("id").alias("id")).collect()[0].id
    return E.get_episode(E.unique_episodes(episodes), stones, last if last is not None else -1).select("id", "text")


def point_and_window(spark, d):
    return E.temporal(_one(spark, d), at(AS_OF), (at(FROM), at(TO))).select("id", "valid_start", "valid_end")


def canonical_names(spark, d):
    """The canonical name of the concept that each subject is resolved to."""
    concepts = table(spark, d, "concepts")
    names = table(spark, d, "triples").filter("subject is not null").select(F.col("subject").alias("name"))
    found = E.concept_lookup(names, concepts).select("name", "concept_id")
    return found.join(concepts.select(F.col("id").alias("concept_id"), "canonical_name"), "concept_id").select("name", "canonical_name")


def episodes_by_session(spark, d):
    one = _one(spark, d)
    common = one.groupBy("provenance.session_id").count().filter("session_id is not null").orderBy(F.desc("count"), "session_id").limit(1).collect()
    return E.by_provenance(one, session=common[0].session_id if common else "").select("id")


def provenance_metadata(spark, d):
    x = E.with_default_provenance(_one(spark, d)).select("id", F.explode(F.map_entries("provenance.metadata")).alias("m"))
    return x.select("id", "m.key", "m.value")


def day_keys(spark, d):
    return _one(spark, d).select("id", S.day_key(F.col("valid_start")).alias("day"))


def minted_ids(spark, d):
    """New ids for all live episodes in order of valid time, after the largest one, as an import gives them."""
    episodes, stones = _t(spark, d, "episodes", "tombstones")
    largest = episodes.agg(F.max("id").alias("m")).collect()[0].m or 0
    x = order.numbered(E.live(E.unique_episodes(episodes), stones).select("id", "valid_start"), ["valid_start", "id"], "new_id", largest + 1)
    return x.select("id", "new_id")


def tombstones_latest(spark, d):
    """One tombstone per key: the newest of an append-only log."""
    x = E.latest(table(spark, d, "tombstones").filter("id is not null"), ["kind", "id"], ["tombstoned_at", "audit_event_id"])
    return x.select("kind", "id", "tombstoned_at", "audit_event_id")


# ---- recall


def token_cascade(spark, d):
    """The tiers on tokens: cues that name a concept first, the others by shared terms."""
    cues, episodes, stones, concepts = _t(spark, d, "cues", "episodes", "tombstones", "concepts")
    x = R.cascade(cues, episodes, stones, concepts, floor="Lexical")
    return x.select("query_id", "id", r6("score").alias("score"), r6("confidence").alias("confidence"), "tier")


def tiers_used(spark, d):
    cues, episodes, stones, concepts = _t(spark, d, "cues", "episodes", "tombstones", "concepts")
    return R.tier_used(R.cascade(cues, episodes, stones, concepts, floor="Lexical"))


def deep_recall(spark, d):
    """Lexical recall with room for 600 rows a cue."""
    cues, posts, directory, weights, *_ = _recall_parts(spark, d)
    return R.tier_lexical(cues.withColumn("k", F.lit(600)), weights, posts, directory).select("query_id", "id", r6("score").alias("score"))


def window_recall(spark, d):
    """Lexical recall within a window of valid time."""
    cues, posts, directory, weights, *_ = _recall_parts(spark, d)
    cues = cues.withColumn("window_from", at(FROM)).withColumn("window_to", at(TO))
    return R.tier_lexical(cues, weights, posts, directory).select("query_id", "id", r6("score").alias("score"))


def recall_final(spark, d):
    """Lexical matches above each cue's least confidence, ranked, with texts."""
    cues, posts, directory, weights, *_ = _recall_parts(spark, d)
    x = R.finish(R.tier_lexical(cues, weights, posts, directory), cues, table(spark, d, "episodes"))
    return x.select("query_id", "rank", "id", r6("confidence").alias("confidence"), "text", "superseded")


def _vector_tier(spark, d, queries, stored, floor, full, band, name):
    cues, _, directory, _, concepts, links = _recall_parts(spark, d)
    allow = R.subject_candidates(cues, concepts, links)
    x = R.banded(R.vector_scores(queries(cues, concepts), stored, cues, directory, allow, hv.FULL_WORDS, True, floor), cues, floor, full, band, name)
    return x.select("query_id", "id", r6("score").alias("score"), r6("confidence").alias("confidence"))


def structured_recall(spark, d):
    """The tier on signatures for every cue with a concept, at full width."""
    signed = _one(spark, d).select("id", hv.signature()(F.col("triples"), F.col("valid_start")).alias("hv"))
    asked = lambda cues, concepts: R.structured_cues(cues, concepts, hv.FULL_WORDS)
    return _vector_tier(spark, d, asked, signed, S.PHI_FLOOR, S.PHI_FULL, S.BAND_B, "Similarity")


def semantic_recall(spark, d):
    """The tier on embeddings for every cue, at full width."""
    embedded = lambda x, key: V.projected(V.dense(V.hashed(x, key=key), key=key), key=key)
    asked = lambda cues, _: embedded(cues.select("query_id", F.col("cue").alias("text")), "query_id")
    return _vector_tier(spark, d, asked, embedded(_one(spark, d).select("id", "text"), "id"), S.EMB_FLOOR, S.EMB_FULL, S.BAND_E, "Semantic")


# ---- beliefs and goals


def _sourced_beliefs(spark, d):
    """Beliefs with the provenance of the episode of their first fact."""
    own = _one(spark, d).select(F.col("id").alias("episode_id"), F.struct("provenance.source", "provenance.session_id").alias("provenance"))
    t = table(spark, d, "triples").filter("subject is not null").join(own, "episode_id")
    x = t.groupBy("subject", "predicate").agg(F.min_by("provenance", "triple_id").alias("provenance"), F.min("triple_id").alias("id"))
    return x.withColumn("t_valid_end", F.lit(None).cast("timestamp"))


def beliefs_about(spark, d):
    triples, stones = _t(spark, d, "triples", "tombstones")
    top = triples.filter("subject is not null and episode_id is not null").groupBy("subject").count().orderBy(F.desc("count"), "subject").limit(1).collect()
    return B.about(_beliefs(spark, d), stones, top[0].subject if top else "").select("id", "predicate")


def beliefs_by_source(spark, d):
    return E.by_provenance(_sourced_beliefs(spark, d), source="import").select("id")


def beliefs_by_session(spark, d):
    x = _sourced_beliefs(spark, d)
    common = x.groupBy("provenance.session_id").count().filter("session_id is not null").orderBy(F.desc("count"), "session_id").limit(1).collect()
    return E.by_provenance(x, session=common[0].session_id if common else "").select("id")


def belief_evidence(spark, d):
    """The evidence of a belief stated several times, put together without repeats."""
    return _beliefs(spark, d).select("id", F.size("evidence").alias("evidence"), F.array_min("evidence").alias("first"))


def belief_history(spark, d):
    log = B.revise(_evidence(spark, d))
    first = log.agg(F.min("belief_id").alias("b")).collect()[0].b
    return B.history(log, first if first is not None else -1).select("seq", "episode_id", r6("confidence").alias("confidence"))


def _goals(requests):
    """Goals with the state after the last of their requests."""
    moves = G.transitions(requests).join(requests.select("seq", "at"), "seq")
    return moves.groupBy(F.col("goal_id").alias("id")).agg(F.max_by("to_state", F.struct("at", "seq")).alias("state"))


def goals_active(spark, d):
    """Goals that are active after all requests but those that end one."""
    return G.active(_goals(goal_requests(spark, d).filter("request not in ('complete', 'abandon')"))).select("id")


def goal_states(spark, d):
    return _goals(goal_requests(spark, d)).groupBy("state", G.is_terminal().alias("terminal")).agg(F.count("*").alias("goals"))


# ---- atoms and deletion


def _atoms(spark, d):
    """Facts that several live episodes state, as atoms anchored at the concept of their subject."""
    episodes, stones, concepts = _t(spark, d, "episodes", "tombstones", "concepts")
    facts = E.live(E.unique_episodes(episodes), stones).select("id", F.explode("triples").alias("t")).select(F.col("id").alias("e"), "t.subject", "t.predicate", "t.object").distinct()
    names = concepts.groupBy(F.col("canonical_name").alias("subject")).agg(F.min("id").alias("concept_id"))
    x = facts.filter("predicate is not null and object is not null").join(names, "subject").groupBy("concept_id", "subject", "predicate", "object")
    x = x.agg(F.sort_array(F.collect_list("e")).alias("evidence"), F.count("*").alias("evidence_count")).filter(F.col("evidence_count") >= ATOM_EVIDENCE)
    x = x.withColumn("claim", F.concat_ws(" ", "subject", "predicate", "object")).withColumn("confidence", F.lit(C.ATOM_CONFIDENCE))
    return order.numbered(x, ["claim", "concept_id", "predicate", "object"], "id", 1).withColumn("id", F.col("id").cast("long"))


def stated_atoms(spark, d):
    return _atoms(spark, d).select("id", "concept_id", "claim", "evidence_count", F.array_min("evidence").alias("first"))


def atoms_lane(spark, d):
    """Atoms anchored at the concepts that subjects of facts name, asked as cues."""
    names = table(spark, d, "concepts").select(F.col("id").alias("query_id"), F.col("canonical_name").alias("cue"))
    one_word = table(spark, d, "concepts").withColumn("canonical_name", F.substring_index("canonical_name", " ", 1))
    x = R.atoms_lane(names, one_word.groupBy("canonical_name").agg(F.min("id").alias("id")), _atoms(spark, d), table(spark, d, "tombstones"))
    return x.select("query_id", "atom_id", "claim", r6("confidence").alias("confidence"), "evidence_count")


def pending_episodes(spark, d):
    return C.pending(*_t(spark, d, "episodes", "tombstones"), _atoms(spark, d)).select("id")


def consolidated_facts(spark, d):
    """Clusters of near-equal signatures over single facts taken as episodes, with enough evidence."""
    t = table(spark, d, "triples").filter("subject is not null and object is not null and valid_start is not null").dropDuplicates(["triple_id"])
    eps = t.select(F.col("triple_id").alias("id"), F.array(F.struct("subject", "predicate", "object", "confidence")).alias("triples"), "valid_start", "t_tx_start")
    signed = eps.select("id", hv.signature(32)(F.col("triples"), F.col("valid_start")).alias("hv")).persist()
    groups = C.clusters(signed, 32).groupBy("leader").agg(F.count("*").alias("evidence_count"))
    return groups.filter(F.col("evidence_count") >= C.MIN_EVIDENCE)


def _unlearn(spark, d, kind, value, beliefs, **options):
    episodes, concepts = _t(spark, d, "episodes", "concepts")
    return U.cascade(kind, value, E.unique_episodes(episodes), beliefs, _atoms(spark, d), E.bridge(episodes, concepts), concepts, **options)


def unlearn_episode(spark, d):
    """Deletion of the episode that most atoms cite, with these atoms."""
    cited = _atoms(spark, d).select(F.explode("evidence").alias("e")).groupBy("e").count().orderBy(F.desc("count"), "e").limit(1).collect()
    return _unlearn(spark, d, "episode", cited[0].e if cited else -1, _beliefs(spark, d))


def unlearn_session(spark, d):
    """Deletion of the largest session: its episodes, its beliefs and the atoms that cite its episodes."""
    one = _one(spark, d)
    common = one.groupBy("provenance.session_id").count().filter("session_id is not null").orderBy(F.desc("count"), "session_id").limit(1).collect()
    return _unlearn(spark, d, "session", common[0].session_id if common else "", _sourced_beliefs(spark, d), atoms_of_provenance=True)


def unlearn_belief(spark, d):
    first = _beliefs(spark, d).agg(F.min("id").alias("id")).collect()[0].id
    return _unlearn(spark, d, "belief", first if first is not None else -1, _beliefs(spark, d))


def new_tombstones(spark, d):
    gone = U.cascade("source", "import", _one(spark, d), _sourced_beliefs(spark, d), spark.createDataFrame([], "id long, concept_id long, evidence array<long>"), None, None)
    return U.new_tombstones(gone, at(NOW), U.label("source", "import"), 77).select("kind", "id", "reason", "audit_event_id")


def event_log(spark, d):
    """All learning events, numbered in order."""
    stored = _one(spark, d).select(F.col("t_tx_start").alias("at"), F.col("id").alias("ref_id"))
    gone = table(spark, d, "tombstones").select(F.col("tombstoned_at").alias("at"), F.col("audit_event_id").alias("ref_id")).distinct()
    return selfmodel.numbered(selfmodel.events({"episode_stored": stored, "unlearned": gone})).select("id", "kind", "at", "ref_id")


def event_counts(spark, d):
    return event_log(spark, d).groupBy("kind").agg(F.count("*").alias("events"), F.min("id").alias("first"))


# ---- vectors, words, frames


def fact_vectors(spark, d):
    """Role-bound facts on the first word of the vectors, a prefix check: SQL rebuilds every bit."""
    t = table(spark, d, "triples").filter("subject is not null and object is not null").dropDuplicates(["triple_id"])
    return t.select("triple_id", hv.bind_triple(F.col("subject"), F.col("predicate"), F.col("object"), PREFIX)[0].alias("w0"), hv.day_vector(F.col("t_tx_start"), PREFIX)[0].alias("day0"))


def episode_signatures(spark, d):
    """Signatures of episodes on the first word of the vectors, a prefix check."""
    x = _one(spark, d).select("id", hv.signature(PREFIX)(F.col("triples"), F.col("valid_start")).alias("hv"))
    return x.filter("hv is not null").select("id", F.col("hv")[0].alias("w0"))


def hv_algebra(spark, d):
    """Moving average, difference, set bits and the zero vector on the first words of neighbouring concepts, a prefix check."""
    c = table(spark, d, "concepts").select("id", hv.from_name("canonical_name", 2).alias("a"))
    x = c.join(c.select((F.col("id") - 1).alias("id"), F.col("a").alias("b")), "id")
    return x.select("id", hv.ema(F.col("a"), F.col("b"))[0].alias("ema0"), hv.subtract(F.col("a"), F.col("b"))[1].alias("less1"), F.size(hv.active_dims(F.col("a"), 2)).alias("dims"),
                    F.array_max(hv.active_dims(F.col("a"), 2)).alias("last"), hv.popcount(hv.bind(F.col("a"), hv.zero(2))).alias("bits"))


def surprise_prefix(spark, d):
    """Surprise on the first word of the vectors, a prefix check; surprise_scores has the full width."""
    x = sensory.surprise(_one(spark, d).select("id", "text"), PREFIX)
    return x.select("id", r6("surprise").alias("surprise"))


def frames_kept(spark, d):
    """The newest frames of a full ring."""
    return sensory.kept(table(spark, d, "events").select(F.col("event_id").alias("id"), "ts")).select("id")


def sensory_stream(spark, d):
    """Texts of the episodes as a stream, one key per source: the stateful operator on every micro-batch until the input is read."""
    folder = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    table(spark, d, "episodes").select(F.coalesce("provenance.source", F.lit("unknown")).alias("stream"), F.col("t_tx_start").cast("timestamp").alias("at"), "text", "id").dropDuplicates(["id"]).drop("id").write.parquet(f"{folder}/in")
    frames = spark.readStream.schema("stream string, at timestamp, text string").parquet(f"{folder}/in")
    sensory.stateful(frames).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(sensory.FRAME).parquet(f"{folder}/out").select("stream", "id", "promoted", r6("surprise").alias("surprise"))


def predicate_synonyms(spark, d):
    p = table(spark, d, "triples").select(F.regexp_replace(F.trim("predicate"), "_", " ").alias("surface")).distinct()
    extra = spark.createDataFrame([(k.upper(),) for k in sorted(SYNONYMS)], "surface string")
    return X.canonical_predicates(p.unionByName(extra), X.predicate_table(spark, SYNONYMS))


QUERIES = {f.__name__: f for f in (
    episode_lookup, point_and_window, canonical_names, episodes_by_session, provenance_metadata, day_keys, minted_ids, tombstones_latest, token_cascade,
    tiers_used, deep_recall, window_recall, recall_final, structured_recall, semantic_recall, beliefs_about, beliefs_by_source, beliefs_by_session,
    belief_evidence, belief_history, goals_active, goal_states, stated_atoms, atoms_lane, pending_episodes, consolidated_facts, unlearn_episode,
    unlearn_session, unlearn_belief, new_tombstones, event_log, event_counts, fact_vectors, episode_signatures, hv_algebra, surprise_prefix,
    frames_kept, sensory_stream, predicate_synonyms,
)}

_AT = {n: f"TIMESTAMP '{t}'" for n, t in (("now", NOW), ("as_of", AS_OF), ("low", FROM), ("high", TO))}
_SESSION = "(SELECT provenance.session_id FROM eps WHERE provenance.session_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
_SOURCED = """, sb AS (SELECT min(triple_id) AS id, first(provenance.session_id ORDER BY triple_id) AS session_id,
    first(provenance.source ORDER BY triple_id) AS src FROM triples JOIN eps ON eps.id = episode_id WHERE subject IS NOT NULL GROUP BY subject, predicate)
"""
_BEL = """, bel AS (SELECT subject, predicate, list_distinct(list(episode_id)) AS evidence, min(triple_id) AS id FROM triples
    WHERE subject IS NOT NULL AND episode_id IS NOT NULL GROUP BY 1, 2)
"""
_ATOMS = f""", fact AS (SELECT DISTINCT id, t.subject AS s, t.predicate AS p, t.object AS o FROM (SELECT id, unnest(triples) AS t FROM live)),
grp AS (SELECT concept_id, s || ' ' || p || ' ' || o AS claim, p, o, list(id) AS evidence, count(*) AS n FROM fact JOIN names ON name = s
    WHERE p IS NOT NULL AND o IS NOT NULL GROUP BY concept_id, s, p, o HAVING count(*) >= {ATOM_EVIDENCE}),
atoms AS (SELECT row_number() OVER (ORDER BY claim, concept_id, p, o) AS id, concept_id, claim, evidence, n FROM grp),
cites AS (SELECT id, unnest(evidence) AS e FROM atoms)
"""
_EXACT = f""", hit AS (SELECT DISTINCT query_id, episode_id AS id FROM (SELECT query_id, unnest(regexp_extract_all(cue, '{_W}')) AS name FROM c) JOIN concepts ON canonical_name = name
    JOIN links ON concept_id = concepts.id),
ok AS (SELECT query_id, id, score, max(score) OVER (PARTITION BY query_id) AS top, k FROM hit JOIN c USING (query_id) JOIN dir USING (id) LEFT JOIN scored USING (query_id, id)
    WHERE NOT tombstoned AND (as_of IS NULL OR (valid_start <= as_of AND (valid_end IS NULL OR as_of < valid_end)))),
ex AS (SELECT query_id, id, coalesce(score, 0) AS score, CASE WHEN top IS NULL THEN 1.0 ELSE least(0.95, greatest(0.55, 0.55 + 0.4 * score / achievable)) END AS confidence,
    CASE WHEN top IS NULL THEN 'Exact' ELSE 'Lexical' END AS tier FROM ok JOIN reach USING (query_id) WHERE score IS NOT NULL OR top IS NULL
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY coalesce(score, 0) DESC, id) <= k),
found AS (SELECT * FROM ex UNION ALL SELECT query_id, id, score, confidence, 'Lexical' FROM conf WHERE query_id NOT IN (SELECT query_id FROM ex))
"""


def _word(text: str, i: int = 0) -> str:
    return _BIT.format(f"{text} || ':{i}'")


_ROLES = {r: _word(f"'{r}'") for r in (hv.ROLE_SUBJECT, hv.ROLE_PREDICATE, hv.ROLE_OBJECT, hv.ROLE_TIME)}
_TRIPLE = "a, b, c", f"xor({_ROLES[hv.ROLE_SUBJECT]}, {_word('s')}) AS a, xor({_ROLES[hv.ROLE_PREDICATE]}, {_word('p')}) AS b, xor({_ROLES[hv.ROLE_OBJECT]}, {_word('o')}) AS c"
_MAJORITY3 = "((a & b) | (c & (a | b)))"
_EVENTS = """, ev AS (SELECT 'episode_stored' AS kind, t_tx_start AS t, id AS ref_id FROM eps UNION ALL SELECT DISTINCT 'unlearned', tombstoned_at, audit_event_id FROM tombstones),
log AS (SELECT row_number() OVER (ORDER BY t NULLS FIRST, kind, ref_id NULLS FIRST) AS id, * FROM ev)
"""

_LAST_STATE = _GOALS.replace("SELECT goal_id, seq, request, from_state, to_state, accepted FROM run", "SELECT goal_id, arg_max(to_state, i) AS s FROM run GROUP BY 1")

SQL = {
    "episode_lookup": _BASE + "SELECT id, text FROM live WHERE id = (SELECT max(id) FROM live)",
    "point_and_window": _BASE
    + f"""SELECT id, valid_start, valid_end FROM eps WHERE valid_start <= {_AT["as_of"]} AND (valid_end IS NULL OR {_AT["as_of"]} < valid_end)
    AND valid_start <= {_AT["high"]} AND coalesce(valid_end, valid_start) >= {_AT["low"]}""",
    "canonical_names": _BASE
    + """, asked AS (SELECT DISTINCT subject AS name FROM triples WHERE subject IS NOT NULL),
    low AS (SELECT lower(canonical_name) AS l, arg_min(id, canonical_name) AS concept_id FROM concepts WHERE canonical_name IS NOT NULL GROUP BY 1),
    f AS (SELECT a.name, coalesce(n.concept_id, low.concept_id) AS id FROM asked a LEFT JOIN names n ON n.name = a.name LEFT JOIN low ON low.l = lower(a.name))
    SELECT name, canonical_name FROM f JOIN concepts USING (id)""",
    "episodes_by_session": _BASE + f"SELECT id FROM eps WHERE provenance.session_id = {_SESSION}",
    "provenance_metadata": _BASE + "SELECT id, m.key AS key, m.value AS value FROM (SELECT id, unnest(map_entries(provenance.metadata)) AS m FROM eps)",
    "day_keys": _BASE + "SELECT id, strftime(valid_start, '%Y-%m-%d') AS day FROM eps",
    "minted_ids": _BASE + "SELECT id, (SELECT max(id) FROM episodes) + row_number() OVER (ORDER BY valid_start NULLS FIRST, id) AS new_id FROM live",
    "tombstones_latest": """SELECT kind, id, max(tombstoned_at) AS tombstoned_at, arg_max(audit_event_id, (tombstoned_at, audit_event_id)) AS audit_event_id
    FROM tombstones WHERE id IS NOT NULL GROUP BY kind, id""",
    "token_cascade": _BASE + _EXACT + "SELECT query_id, id, round(score, 6) AS score, round(confidence, 6) AS confidence, tier FROM found",
    "tiers_used": _BASE + _EXACT + "SELECT query_id, min(tier) AS tier FROM found GROUP BY 1",
    "deep_recall": _BASE.replace("coalesce(k, 10) AS k", "600 AS k") + "SELECT query_id, id, round(score, 6) AS score FROM lexical",
    "window_recall": _BASE.replace("WHERE NOT tombstoned AND (as_of", f"WHERE valid_start <= {_AT['high']} AND coalesce(valid_end, valid_start) >= {_AT['low']} AND NOT tombstoned AND (as_of")
    + "SELECT query_id, id, round(score, 6) AS score FROM lexical",
    "recall_final": _BASE
    + """, m AS (SELECT query_id, any_value(CASE WHEN isnan(min_confidence) THEN 0 ELSE coalesce(min_confidence, 0) END) AS floor, any_value(k) AS kk FROM cues WHERE query_id IS NOT NULL GROUP BY 1),
    r AS (SELECT query_id, id, confidence, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, score DESC, id) AS rank, coalesce(kk, 10) AS k FROM conf JOIN m USING (query_id)
        WHERE confidence >= coalesce(floor, 0))
    SELECT query_id, rank::INT AS rank, r.id, round(r.confidence, 6) AS confidence, text, superseded_by IS NOT NULL AS superseded FROM r JOIN eps ON eps.id = r.id WHERE rank <= k""",
    "beliefs_about": _BASE + _BEL + """SELECT id, predicate FROM bel WHERE subject = (SELECT subject FROM triples WHERE subject IS NOT NULL AND episode_id IS NOT NULL
    GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AND id NOT IN (SELECT id FROM tombstones WHERE kind = 1 AND id IS NOT NULL)""",
    "beliefs_by_source": _BASE + _SOURCED + "SELECT id FROM sb WHERE src = 'import'",
    "beliefs_by_session": _BASE + _SOURCED + "SELECT id FROM sb WHERE session_id = (SELECT session_id FROM sb WHERE session_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)",
    "belief_evidence": _BASE + _BEL + "SELECT id, len(evidence)::INT AS evidence, list_min(evidence) AS first FROM bel",
    "belief_history": _EVIDENCE + "SELECT i - 1 AS seq, episode_id, round(conf, 6) AS confidence FROM run WHERE belief_id = (SELECT min(belief_id) FROM run)",
    "goals_active": f"SELECT goal_id AS id FROM ({_LAST_STATE.replace('FROM events WHERE', 'FROM events WHERE event_type NOT IN (' + repr('purchase') + ', ' + repr('error') + ') AND')}) WHERE s = 'Active'",
    "goal_states": f"""SELECT s AS state, s IN ('Completed', 'Abandoned') AS terminal, count(*) AS goals
    FROM ({_LAST_STATE}) GROUP BY 1, 2""",
    "stated_atoms": _BASE + _ATOMS + "SELECT id, concept_id, claim, n AS evidence_count, list_min(evidence) AS first FROM atoms",
    "atoms_lane": _BASE
    + _ATOMS
    + f""", firsts AS (SELECT split_part(canonical_name, ' ', 1) AS token, min(id) AS concept_id FROM concepts GROUP BY 1),
    q AS (SELECT DISTINCT id AS query_id, unnest(regexp_extract_all(canonical_name, '{_W}')) AS token FROM concepts)
    SELECT DISTINCT q.query_id, atoms.id AS atom_id, claim, 0.9::DOUBLE AS confidence, n AS evidence_count FROM q JOIN firsts USING (token) JOIN atoms USING (concept_id)
    WHERE atoms.id NOT IN (SELECT id FROM tombstones WHERE kind = 2 AND id IS NOT NULL)""",
    "pending_episodes": _BASE + _ATOMS + "SELECT id FROM live WHERE id NOT IN (SELECT e FROM cites)",
    "consolidated_facts": f"""WITH t AS (SELECT DISTINCT triple_id, subject, predicate, object, valid_start::DATE AS day FROM triples WHERE subject IS NOT NULL AND object IS NOT NULL AND valid_start IS NOT NULL)
    SELECT min(triple_id) AS leader, count(*) AS evidence_count FROM t GROUP BY subject, predicate, object, day HAVING count(*) >= {C.MIN_EVIDENCE}""",
    "unlearn_episode": _BASE
    + _ATOMS
    + """, x AS (SELECT e FROM cites GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT 0 AS kind, id FROM eps WHERE id IN (SELECT e FROM x) UNION ALL SELECT DISTINCT 2, id FROM cites WHERE e IN (SELECT e FROM x)""",
    "unlearn_session": _BASE
    + _SOURCED
    + _ATOMS
    + f""", s AS (SELECT id FROM eps WHERE provenance.session_id = {_SESSION})
    SELECT 0 AS kind, id FROM s UNION ALL SELECT 1, id FROM sb WHERE session_id = {_SESSION} UNION ALL SELECT DISTINCT 2, id FROM cites WHERE e IN (SELECT id FROM s)""",
    "unlearn_belief": _BASE + _BEL + "SELECT 1 AS kind, min(id) AS id FROM bel",
    "new_tombstones": _BASE
    + _SOURCED
    + """SELECT kind, id, 'source:import' AS reason, 77::BIGINT AS audit_event_id FROM (SELECT 0 AS kind, id FROM eps WHERE provenance.source = 'import'
    UNION ALL SELECT 1, id FROM sb WHERE src = 'import')""",
    "event_log": _BASE + _EVENTS + 'SELECT id, kind, t AS "at", ref_id FROM log',
    "event_counts": _BASE + _EVENTS + "SELECT kind, count(*) AS events, min(id) AS first FROM log GROUP BY 1",
    "fact_vectors": f"""WITH t AS (SELECT DISTINCT triple_id, subject AS s, predicate AS p, object AS o, t_tx_start FROM triples WHERE subject IS NOT NULL AND object IS NOT NULL),
    v AS (SELECT triple_id, {_TRIPLE[1]}, xor({_ROLES[hv.ROLE_TIME]}, {_word("strftime(t_tx_start, '%Y-%m-%d')")}) AS day0 FROM t)
    SELECT triple_id, {_MAJORITY3} AS w0, day0 FROM v""",
    "episode_signatures": _BASE
    + f""", f AS (SELECT id, valid_start, t.subject AS s, t.predicate AS p, t.object AS o FROM (SELECT id, valid_start, unnest(triples) AS t FROM eps)),
    m AS (SELECT id, {_MAJORITY3} AS v FROM (SELECT id, {_TRIPLE[1]} FROM f WHERE s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL)
        UNION ALL SELECT id, xor({_ROLES[hv.ROLE_TIME]}, {_word("strftime(valid_start, '%Y-%m-%d')")}) FROM eps WHERE len(triples) > 0 AND valid_start IS NOT NULL),
    bits AS (SELECT id, b, count(*) AS n, sum((v >> b) & 1) AS s FROM m, range(60) r(b) GROUP BY 1, 2)
    SELECT id, sum(CASE WHEN 2 * s > n THEN 1::BIGINT << b ELSE 0 END)::BIGINT AS w0 FROM bits GROUP BY 1""",
    "hv_algebra": f"""WITH v AS (SELECT id, {_word("canonical_name", 0)} AS w0, {_word("canonical_name", 1)} AS w1 FROM concepts),
    d AS (SELECT id, max(CASE WHEN (CASE WHEN b < 60 THEN w0 >> b ELSE w1 >> (b - 60) END) & 1 = 1 THEN b END) AS last FROM v, range(120) r(b) GROUP BY 1)
    SELECT x.id, (x.w0 | y.w0) AS ema0, xor(x.w1, y.w1) AS less1, (bit_count(x.w0)::INT + bit_count(x.w1)::INT)::INT AS dims, d.last::INT AS last,
    (bit_count(x.w0)::BIGINT + bit_count(x.w1)::BIGINT)::BIGINT AS bits FROM v x JOIN v y ON y.id = x.id + 1 JOIN d ON d.id = x.id""",
    "surprise_prefix": _BASE
    + f""", tok AS (SELECT id, unnest(regexp_extract_all(lower(text), '{_W}')) AS t FROM eps),
    bits AS (SELECT id, b, count(*) AS n, sum(({_BIT.format("t || ':0'")} >> b) & 1) AS s FROM tok, range(60) r(b) GROUP BY 1, 2),
    vec AS (SELECT id, sum(CASE WHEN 2 * s > n THEN 1::BIGINT << b ELSE 0 END)::BIGINT AS v FROM bits GROUP BY 1),
    o AS (SELECT eps.id, coalesce(v, 0) AS v, v IS NOT NULL AS spoken, row_number() OVER (ORDER BY eps.id) AS pos FROM eps LEFT JOIN vec USING (id)),
    near AS (SELECT a.id, min(bit_count(xor(a.v, b.v))) AS least FROM o a JOIN o b ON b.pos < a.pos AND b.pos >= a.pos - {sensory.LOOK_BACK} GROUP BY 1)
    SELECT o.id, round(CASE WHEN NOT spoken THEN 0 ELSE coalesce(least / 60.0, 1) END, 6) AS surprise FROM o LEFT JOIN near USING (id)""",
    "frames_kept": f"SELECT event_id AS id FROM events ORDER BY event_id DESC LIMIT {sensory.CAPACITY}",
    "predicate_synonyms": f"""WITH v(surface, predicate) AS (VALUES {_SURFACES}, {", ".join(f"('{k}', '{p}')" for k, p in SYNONYMS.items())}),
    p AS (SELECT DISTINCT replace(trim(predicate), '_', ' ') AS surface FROM triples UNION ALL VALUES {", ".join(f"('{k.upper()}')" for k in SYNONYMS)})
    SELECT p.surface, v.predicate FROM p LEFT JOIN v ON lower(p.surface) = v.surface""",
}

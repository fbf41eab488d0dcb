"""Queries over the reference tables for the engine's own operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import hv
from palimpsest.functions import scoring as S
from palimpsest.operators import beliefs as B
from palimpsest.operators import consolidate as C
from palimpsest.operators import embedding as V
from palimpsest.operators import episodes as E
from palimpsest.operators import evaluate as Q
from palimpsest.operators import extract as X
from palimpsest.operators import goals as G
from palimpsest.operators import recall as R
from palimpsest.operators import search, selfmodel, temporal
from palimpsest.operators import unlearn as U
from palimpsest.session import stored
from palimpsest.sources import jsonl
from palimpsest.sources.tables import table
from palimpsest.streaming import sensory

#: Words of the vectors in queries that SQL checks bit by bit; they show that the operators are right on a prefix, the
#: `.._full` queries have the results at full width.
NARROW = 4
#: The clock of the queries, and other points in time they ask about.
NOW, AS_OF, FROM, TO = "2025-12-31 00:00:00", "2025-01-01 00:00:00", "2024-06-01 00:00:00", "2024-06-30 00:00:00"


def at(t: str) -> Column:
    return F.lit(t).cast("timestamp_ntz")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _t(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [table(spark, d, n) for n in names]


# ---- scans, lookups, listings


def token_postings(spark, d):
    return E.postings(table(spark, d, "episodes"))


def token_df_idf(spark, d):
    episodes = table(spark, d, "episodes")
    n = episodes.select(F.count_distinct("id").alias("n")).scalar()
    return E.document_frequency(E.postings(episodes)).select("term", "df", r6(S.idf(n, F.col("df"))).alias("idf"))


def scan_directory(spark, d):
    return E.scan_directory(*_t(spark, d, "episodes", "tombstones"))


def live_episodes(spark, d):
    return E.live(E.unique_episodes(table(spark, d, "episodes")), table(spark, d, "tombstones")).select("id", "text", "valid_start")


def first_episodes(spark, d):
    return E.list_episodes(E.unique_episodes(table(spark, d, "episodes")), table(spark, d, "tombstones"), 100).select("id", "text")


def as_of_snapshot(spark, d):
    return temporal.snapshot(E.unique_episodes(table(spark, d, "episodes")), at(AS_OF)).select("id", "valid_start", "valid_end")


def time_window_overlap(spark, d):
    return E.list_range(E.unique_episodes(table(spark, d, "episodes")), table(spark, d, "tombstones"), at(FROM), at(TO)).select("id", "valid_start")


def _hot_subject(spark, d):
    episodes, concepts = _t(spark, d, "episodes", "concepts")
    links = E.bridge(episodes, concepts)
    top = links.groupBy("concept_id").count().orderBy(F.desc("count"), "concept_id").limit(1).collect()
    return episodes, links, [r.concept_id for r in top]


def timeline_subject(spark, d):
    episodes, links, ids = _hot_subject(spark, d)
    return E.timeline(E.unique_episodes(episodes), table(spark, d, "tombstones"), links, ids, at(FROM), at(TO)).select("id", "valid_start")


def concept_bridge(spark, d):
    return E.bridge(*_t(spark, d, "episodes", "concepts"))


def episodes_by_source(spark, d):
    return E.by_provenance(E.unique_episodes(table(spark, d, "episodes")), source="import").select("id")


def session_sizes(spark, d):
    x = E.with_default_provenance(E.unique_episodes(table(spark, d, "episodes")))
    return x.groupBy("provenance.source", "provenance.session_id").agg(F.count("*").alias("episodes"), r6(S.geomean(F.col("confidence"))).alias("confidence"))


def concept_lookup(spark, d):
    concepts = table(spark, d, "concepts")
    names = table(spark, d, "triples").filter("subject is not null").select(F.col("subject").alias("name"))
    return E.concept_lookup(names, concepts)


def fuzzy_concepts(spark, d):
    names = table(spark, d, "triples").filter("subject is not null").select(F.col("subject").alias("name")).distinct()
    return E.fuzzy_candidates(names, table(spark, d, "concepts"), 1)


def store_stats(spark, d):
    return E.stats({n: table(spark, d, n) for n in ("episodes", "triples", "concepts", "predicates", "tombstones", "scan_entries", "cues")})


# ---- time


def supersede_links(spark, d):
    episodes = E.unique_episodes(table(spark, d, "episodes"))
    links = episodes.filter("superseded_by is not null").select(F.col("id").alias("older"), F.col("superseded_by").alias("newer"))
    return temporal.supersede(episodes, links).select("id", "valid_end", "superseded_by")


def contradictions(spark, d):
    return C.contradiction_links(*_t(spark, d, "episodes", "tombstones"))


def time_anchors(spark, d):
    events = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("now"))
    said = events.withColumn("text", F.explode(F.array(*(F.lit(x) for x in ("Yesterday", " last weekend", "this weekend", "two months ago", "3 days ago", "2024-03-05", "nonsense")))))
    x = said.select("event_id", F.trim(F.lower("text")).alias("phrase"), S.time_anchor(F.col("text"), F.col("now")).alias("a"))
    return x.select("event_id", "phrase", F.col("a.start").cast("timestamp_ntz").alias("valid_start"), F.col("a.end").cast("timestamp_ntz").alias("valid_end"))


# ---- recall


def _recall_parts(spark, d):
    episodes, stones, concepts = _t(spark, d, "episodes", "tombstones", "concepts")
    cues = R.with_defaults(table(spark, d, "cues"))
    posts, directory = E.postings(episodes).persist(), E.scan_directory(episodes, stones).persist()
    return cues, posts, directory, R.cue_weights(cues, posts, directory), concepts, E.bridge(episodes, concepts)


def lexical_recall(spark, d):
    cues, posts, directory, weights, *_ = _recall_parts(spark, d)
    x = R.tier_lexical(cues, weights, posts, directory)
    return x.select("query_id", "id", r6("score").alias("score"), r6("confidence").alias("confidence"))


def exact_recall(spark, d):
    cues, posts, directory, weights, concepts, links = _recall_parts(spark, d)
    x = R.tier_exact(cues, weights, posts, directory, concepts, links)
    return x.select("query_id", "id", r6("score").alias("score"), r6("confidence").alias("confidence"), "tier")


def subject_recall(spark, d):
    episodes, stones, concepts, cues = _t(spark, d, "episodes", "tombstones", "concepts", "cues")
    # written down once: the plan of the tier then reads small tables, instead of making them anew
    cues, posts, directory = (stored(x) for x in (R.with_defaults(cues), E.postings(episodes), E.scan_directory(episodes, stones)))
    weights, links = stored(R.cue_weights(cues, posts, directory)), stored(E.bridge(episodes, concepts))
    named = stored(cues.drop("subject").join(concepts.select(F.col("id").alias("query_id"), F.upper("canonical_name").alias("subject")), "query_id"))
    x = R.tier_exact(named, weights, posts, directory, concepts, links)
    return x.select("query_id", "id", r6("score").alias("score"), r6("confidence").alias("confidence"), "tier")


def recency_rerank(spark, d):
    cues, posts, directory, weights, *_ = _recall_parts(spark, d)
    x = R.recency_rerank(R.tier_lexical(cues, weights, posts, directory), directory, at(NOW), 0.3)
    return x.select("query_id", "id", r6("confidence").alias("confidence"))


def cascade_recall(spark, d):
    """All tiers at full width, the semantic tier with the hashed embedding, then floor, order and texts."""
    episodes, stones, concepts, cues = _t(spark, d, "episodes", "tombstones", "concepts", "cues")
    one = E.unique_episodes(episodes)
    embedded = lambda x, key: V.projected(V.dense(V.hashed(x, key=key), key=key), key=key)
    # a table per tier: only the vectors of a tier that some cue reaches are made
    vectors = {
        "gist": one.select("id", hv.token_bundle()(R.terms("text")).alias("hv")), "emb": embedded(one.select("id", "text"), "id"),
        "sig": one.select("id", hv.signature()(F.col("triples"), F.col("valid_start")).alias("hv")),
    }
    asked = cues.filter("query_id is not null").select("query_id", F.col("cue").alias("text"))
    matches = R.cascade(cues, episodes, stones, concepts, vectors, embedded(asked, "query_id"))
    out = R.finish(matches, cues, episodes)
    return out.select("query_id", "rank", "id", r6("confidence").alias("confidence"), "tier")


def goal_biased_recall(spark, d):
    """Lexical recall drawn towards goals that are the cues of the class exact."""
    cues, posts, directory, weights, *_ = _recall_parts(spark, d)
    one = E.unique_episodes(table(spark, d, "episodes"))
    gist = one.select("id", hv.token_bundle()(R.terms("text")).alias("hv"))
    goals = cues.filter("cue_class = 'exact'").select(F.col("query_id").alias("id"), hv.token_bundle()(R.terms("cue")).alias("hv"))
    x = R.goal_bias(R.tier_lexical(cues, weights, posts, directory), goals, gist, 0.2)
    return x.select("query_id", "id", r6("confidence").alias("confidence"))


# ---- hypervectors and embeddings


def hv_bind_similarity(spark, d, words=NARROW):
    c = table(spark, d, "concepts").select("id", hv.from_name("canonical_name", words).alias("a"))
    b = c.select((F.col("id") - 1).alias("id"), F.col("a").alias("b"))
    x = c.join(b, "id")
    return x.select("id", hv.hamming(F.col("a"), F.col("b")).alias("distance"), r6(hv.similarity(F.col("a"), F.col("b"), words)).alias("similarity"))


def hv_bind_similarity_full(spark, d):
    return hv_bind_similarity(spark, d, hv.FULL_WORDS)


def hv_phi_band(spark, d, words=NARROW):
    c = table(spark, d, "concepts").select("id", hv.from_name("canonical_name", words).alias("a"))
    role = hv.from_name(F.lit(hv.ROLE_SUBJECT), words)
    both = F.zip_with("a", role, lambda x, y: x.bitwiseAND(y))
    phi = hv.phi(hv.popcount(F.col("a")), hv.popcount(both), hv.hamming(F.col("a"), both), words)
    return c.select("id", r6(phi).alias("phi"), r6(S.band(phi, S.PHI_FLOOR, S.PHI_FULL, S.BAND_B)).alias("confidence"))


def hv_phi_band_full(spark, d):
    return hv_phi_band(spark, d, hv.FULL_WORDS)


def hv_majority(spark, d):
    """Majority over the terms of each episode, in plain aggregates."""
    one = E.unique_episodes(table(spark, d, "episodes")).select("id", F.explode(R.terms("text")).alias("term"))
    x = hv.majority(one.select("id", hv.from_name("term", 1).alias("hv")), ["id"], "hv", 1)
    return x.select("id", F.col("hv")[0].alias("w0"))


def hv_majority_full(spark, d):
    """The whole majority vector of each episode with terms."""
    return _gists(table(spark, d, "episodes"), hv.FULL_WORDS)


def _gists(episodes: DataFrame, words: int) -> DataFrame:
    return E.unique_episodes(episodes).filter(F.size(R.terms("text")) > 0).select("id", hv.token_bundle(words)(R.terms("text")).alias("hv"))


def gist_nearest(spark, d, words=1):
    cues = R.with_defaults(table(spark, d, "cues")).filter(F.size(R.terms("cue")) > 0)
    q = cues.select("query_id", hv.token_bundle(words)(R.terms("cue")).alias("hv"))
    x = hv.nearest(q, _gists(table(spark, d, "episodes"), words).persist(), 5, words)
    x = x.withColumn("score", 1 - F.col("distance") / float(words * hv.WORD_BITS))
    return x.select("query_id", "id", r6("score").alias("score"), r6(S.nearest_confidence(F.col("score"))).alias("confidence"))


def gist_nearest_full(spark, d):
    return gist_nearest(spark, d, hv.FULL_WORDS)


def embedding_cosine_topk(spark, d):
    v = table(spark, d, "embeddings")
    return search.blocked_top_k(v.filter("vec_id % 20 = 0"), v, 10).select("query_id", "vec_id", r6("score").alias("score"))


def charikar_projection(spark, d):
    x = V.projected(table(spark, d, "embeddings"), 1, 64, "vec_id", "embedding")
    return x.select("vec_id", F.col("hv")[0].alias("w0"))


def charikar_projection_full(spark, d):
    return V.projected(table(spark, d, "embeddings"), hv.FULL_WORDS, 64, "vec_id", "embedding")


def feature_hash_embedding(spark, d):
    x = V.hashed(E.unique_episodes(table(spark, d, "episodes")).select("id", "text"))
    return x.select("id", "bucket", r6("value").alias("value"))


def _self_folds(spark, d, words):
    c = table(spark, d, "concepts").withColumn("kind", F.lower(F.trim("entity_type"))).select("kind", hv.from_name("canonical_name", words).alias("hv"))
    return selfmodel.or_fold(c, "hv", words, ["kind"]).join(selfmodel.xor_fold(c, "hv", words, ["kind"]).withColumnRenamed("hv", "x").withColumnRenamed("kind", "k"), F.col("kind").eqNullSafe(F.col("k")))


def self_vector_folds(spark, d):
    both = _self_folds(spark, d, 2)
    return both.select("kind", F.col("hv")[0].alias("or0"), F.col("hv")[1].alias("or1"), F.col("x")[0].alias("xor0"), F.col("x")[1].alias("xor1"))


def self_vector_folds_full(spark, d):
    return _self_folds(spark, d, hv.FULL_WORDS).select("kind", F.col("hv").alias("any"), F.col("x").alias("odd"))


# ---- beliefs, goals, unlearning


def _evidence(spark, d):
    e = table(spark, d, "events").filter(F.col("event_type").isin("purchase", "signup", "error"))
    return e.select(F.col("user_id").alias("belief_id"), F.col("ts").alias("at"), F.col("event_id").alias("episode_id"), (F.col("event_type") != "error").alias("supports"), F.lit(0.8).alias("confidence0"))


def belief_revisions(spark, d):
    x = B.revise(_evidence(spark, d))
    return x.select("belief_id", "seq", "episode_id", r6("previous").alias("previous"), r6("confidence").alias("confidence"), "withdrawn")


def belief_current(spark, d):
    x = B.current(B.revise(_evidence(spark, d)))
    return x.select("belief_id", r6("confidence").alias("confidence"), "revisions", "withdrawn")


def _beliefs(spark, d):
    """Beliefs on each subject and predicate of the triples, with the episodes that state them as evidence."""
    t = table(spark, d, "triples").filter("subject is not null and episode_id is not null")
    x = t.groupBy("subject", "predicate").agg(F.collect_set("episode_id").alias("evidence"), F.min("triple_id").alias("id"))
    return x.withColumn("contradictions", F.array().cast("array<long>")).withColumn("confidence", F.lit(0.9)).withColumn("t_valid_end", F.lit(None).cast("timestamp"))


def belief_evidence_correction(spark, d):
    gone = E.tombstoned_ids(table(spark, d, "tombstones"), 0)
    x = B.correct_evidence(_beliefs(spark, d), gone)
    return x.select("id", r6("confidence").alias("confidence"), F.size("evidence").alias("kept"), "corrected", "withdrawn")


def active_beliefs(spark, d):
    return B.active_by_key(_beliefs(spark, d))


def goal_requests(spark, d):
    """Events read as requests to the goal of their user."""
    request = {"click": "pause", "view": "resume", "purchase": "complete", "error": "abandon", "signup": "revise"}
    m = F.create_map(*(F.lit(x) for kv in request.items() for x in kv))
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("goal_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.try_element_at(m, F.col("event_type")).alias("request"))


def goal_transitions(spark, d):
    return G.transitions(goal_requests(spark, d))


def _unlearn_parts(spark, d):
    episodes, concepts = E.unique_episodes(table(spark, d, "episodes")), table(spark, d, "concepts")
    beliefs = _beliefs(spark, d).withColumn("provenance", F.lit(None).cast("struct<source:string,session_id:string>"))
    atoms = spark.createDataFrame([], "id long, concept_id long, evidence array<long>")
    return episodes, beliefs, atoms, E.bridge(episodes, concepts), concepts


def unlearn_source(spark, d):
    return U.report(U.cascade("source", "import", *_unlearn_parts(spark, d)), _beliefs(spark, d))


def unlearn_concept(spark, d):
    return U.cascade("concept", _hot_subject(spark, d)[2][0], *_unlearn_parts(spark, d))


def restore_window(spark, d):
    stones = table(spark, d, "tombstones")
    latest = stones.agg(F.max("audit_event_id").alias("m")).collect()[0].m
    return U.restore(stones, latest, at(NOW)).select("kind", "id", "audit_event_id")


def learning_log(spark, d):
    episodes, stones = _t(spark, d, "episodes", "tombstones")
    stored = E.unique_episodes(episodes).select(F.col("t_tx_start").alias("at"), F.col("id").alias("ref_id"))
    gone = stones.select(F.col("tombstoned_at").alias("at"), F.col("audit_event_id").alias("ref_id")).distinct()
    log = selfmodel.events({"episode_stored": stored, "unlearned": gone})
    return selfmodel.since(log, at(AS_OF))


# ---- consolidation, sensory, extraction, evaluation


def consolidated_atoms(spark, d):
    episodes, stones, concepts = _t(spark, d, "episodes", "tombstones", "concepts")
    none = spark.createDataFrame([], "evidence array<long>")
    open_ = C.pending(episodes, stones, none)
    signed = hv.bundle_groups(hv.episode_members(open_, NARROW), "id", "hv", NARROW).select("id", "hv").persist()
    atoms = C.atoms_of(C.clusters(signed, NARROW), open_, concepts, at(NOW), NARROW, 1, signed)
    return atoms.select("id", "concept_id", "claim", "evidence_count")


def surprise_scores(spark, d):
    x = sensory.surprise(E.unique_episodes(table(spark, d, "episodes")).select("id", "text"))
    return x.select("id", r6("surprise").alias("surprise"), (F.col("surprise") >= sensory.PROMOTE_AT).alias("promoted"))


def predicate_canonical(spark, d):
    p = table(spark, d, "triples").select(F.regexp_replace(F.trim("predicate"), "_", " ").alias("surface")).distinct()
    return X.canonical_predicates(p, X.predicate_table(spark))


def heuristic_relations(spark, d):
    one = E.unique_episodes(table(spark, d, "episodes")).select("id", "text")
    return one.select("id", F.explode(X.extractor()(F.col("text"))).alias("t")).select("id", "t.subject", "t.predicate", "t.object")


def extraction_quality(spark, d):
    """Facts stored with the episodes against those of the triples table."""
    gold = E.unique_episodes(table(spark, d, "episodes")).select("id", F.explode("triples").alias("t")).select("id", "t.subject", "t.predicate", "t.object")
    found = table(spark, d, "triples").filter("episode_id is not null").select(F.col("episode_id").alias("id"), "subject", "predicate", "object")
    x = Q.extraction_scores(gold, found)
    return x.select("tp", "fp", "fn", *(r6(c).alias(c) for c in ("precision", "recall", "f1")))


def alias_resolution(spark, d):
    names = table(spark, d, "triples").filter("subject is not null").select(F.col("subject").alias("name"))
    return X.resolve_aliases(names, table(spark, d, "concepts"), X.ALIAS_DISTANCE)


def observed_batch(spark, d):
    """The texts of the episodes observed anew with the default extractor."""
    one = E.unique_episodes(table(spark, d, "episodes")).filter("text is not null")
    x = X.observe(one.select(F.col("id").alias("pos"), "text", F.col("t_tx_start").cast("timestamp").alias("observed_at")), F.lit(NOW).cast("timestamp"), 1, X.extractor())
    return x.select("id", F.size("triples").alias("facts"), r6("confidence").alias("confidence"), F.col("valid_start").cast("timestamp_ntz").alias("valid_start"))


def bm25_topk(spark, d):
    x = Q.bm25(*_t(spark, d, "cues", "episodes"))
    return x.select("query_id", "id", r6("score").alias("score"))


def naive_scan_topk(spark, d):
    return Q.naive_scan(*_t(spark, d, "cues", "episodes"))


def ranking_quality(spark, d):
    w = Q.Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    ranked = table(spark, d, "events").select(F.col("user_id").alias("query_id"), F.row_number().over(w).alias("rank"), (F.col("event_type") == "purchase").alias("relevant"))
    x = Q.ranking_scores(ranked)
    return x.select("queries", "p50_rank", "p95_rank", *(r6(c).alias(c) for c in ("hit_1", "hit_5", "mrr")))


def jsonl_roundtrip(spark, d):
    x = jsonl.parse(jsonl.export_rows(E.unique_episodes(table(spark, d, "episodes"))))
    return x.select("id", "text", F.size("triples").alias("facts"), "provenance.source", r6("confidence").alias("confidence"))


QUERIES = {f.__name__: f for f in (
    token_postings, token_df_idf, scan_directory, live_episodes, first_episodes, as_of_snapshot, time_window_overlap, timeline_subject,
    concept_bridge, episodes_by_source, session_sizes, concept_lookup, fuzzy_concepts, store_stats, supersede_links, contradictions,
    time_anchors, lexical_recall, exact_recall, subject_recall, recency_rerank, cascade_recall, goal_biased_recall, hv_bind_similarity,
    hv_phi_band, hv_majority, gist_nearest, embedding_cosine_topk, charikar_projection, feature_hash_embedding, self_vector_folds,
    belief_revisions, belief_current, belief_evidence_correction, active_beliefs, goal_transitions, unlearn_source, unlearn_concept,
    restore_window, learning_log, consolidated_atoms, surprise_scores, predicate_canonical, heuristic_relations, extraction_quality,
    hv_bind_similarity_full, hv_phi_band_full, hv_majority_full, gist_nearest_full, charikar_projection_full, self_vector_folds_full,
    alias_resolution, observed_batch, bm25_topk, naive_scan_topk, ranking_quality, jsonl_roundtrip,
)}

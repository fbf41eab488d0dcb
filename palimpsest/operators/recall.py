"""Recall: ranked, scored episodes for a table of cues, through a cascade of tiers.

Every tier takes all cues that no tier before it has answered, so the costly scans see only
what is left. Cues have query_id, cue, as_of, k and min_confidence, optionally window_from,
window_to and subject (a concept name). Only ids and scores move through the tiers; texts
are joined to the final rows.

Defined cases: a cue without tokens finds nothing, except under a subject, where all its
episodes come back in id order. A null k counts as 10, a null min_confidence as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import hv
from palimpsest.functions import scoring as S
from palimpsest.functions.postings import ranked
from palimpsest.functions.text import terms
from palimpsest.operators import episodes as E
from palimpsest.session import checkpointed, stored

MATCH = ["query_id", "id", "score", "confidence", "tier"]


def with_defaults(cues: DataFrame) -> DataFrame:
    """Cues with every optional column, one row per query_id."""
    for c, kind in (("as_of", "timestamp"), ("window_from", "timestamp"), ("window_to", "timestamp"), ("subject", "string"), ("k", "int"), ("min_confidence", "double")):
        if c not in cues.columns:
            cues = cues.withColumn(c, F.lit(None).cast(kind))
    cues = cues.withColumn("k", F.coalesce("k", F.lit(10))).withColumn("min_confidence", F.coalesce(F.nanvl("min_confidence", F.lit(0.0)), F.lit(0.0)))
    return cues.filter("query_id is not null").dropDuplicates(["query_id"])


def passes(tombstoned: Column, as_of: Column, low: Column, high: Column) -> Column:
    """Whether an episode may answer a cue: alive, valid at as_of and within the window where these are given."""
    window = low.isNull() | high.isNull() | S.overlaps(low, high)
    return ~tombstoned & (as_of.isNull() | S.valid_at(as_of)) & window


def allowed(hits: DataFrame, cues: DataFrame, directory: DataFrame) -> DataFrame:
    """Keeps the (query_id, id, ..) rows that pass the cue's filters."""
    x = hits.join(directory, "id").join(cues.select("query_id", "as_of", "window_from", "window_to"), "query_id")
    return x.filter(passes(F.col("tombstoned"), F.col("as_of"), F.col("window_from"), F.col("window_to"))).select(*hits.columns)


def most(cues: DataFrame) -> int:
    """The largest k of the cues: no window needs more rows of one."""
    return max(1, cues.agg(F.max("k").alias("k")).collect()[0].k or 1)


def top_k(scored: DataFrame, cues: DataFrame) -> DataFrame:
    """The best k rows per cue, by score and then id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    # the constant bound lets Spark cut each partition before the shuffle
    first = scored.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most(cues))
    return first.join(cues.select("query_id", "k"), "query_id").filter("_r <= k").drop("_r", "k")


def cue_weights(cues: DataFrame, posts: DataFrame, directory: DataFrame) -> DataFrame:
    """(query_id, term, w, achievable): idf of each cue term times its occurrences in the cue.

    Tombstoned episodes count in the collection, a term held by no episode weighs most and can never be matched.
    """
    own = cues.select("query_id", F.explode(terms("cue")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("c"))
    df = E.document_frequency(posts.join(own.select("term").distinct(), "term", "left_semi"))
    n = directory.agg(F.greatest(F.count("*"), F.lit(1)).alias("n")).scalar()
    w = own.join(df, "term", "left").withColumn("w", F.col("c") * S.idf(n, F.coalesce("df", F.lit(1))))
    return w.withColumn("achievable", F.sum("w").over(Window.partitionBy("query_id"))).select("query_id", "term", "w", "achievable")


def lexical_scores(weights: DataFrame, posts: DataFrame) -> DataFrame:
    """(query_id, id, score, achievable): summed weights of the cue terms an episode holds.

    Scores are rounded to 9 places, so that ties do not hang on the order of the sum.
    """
    return posts.join(weights, "term").groupBy("query_id", "id").agg(F.round(F.sum("w"), 9).alias("score"), F.max("achievable").alias("achievable"))


def _micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


def _timed(cues: DataFrame) -> DataFrame:
    return cues.select("query_id", _micros(F.col("as_of")).alias("as_of"), _micros(F.col("window_from")).alias("low"), _micros(F.col("window_to")).alias("high"), "subject")


def _alive(directory: DataFrame) -> DataFrame:
    return directory.filter("not tombstoned").select("id", _micros(F.col("valid_start")).alias("start"), _micros(F.col("valid_end")).alias("end"))


def lexical_best(cues: DataFrame, weights: DataFrame, posts: DataFrame, directory: DataFrame, block: int = 4_096, rows: int = 32_768) -> DataFrame:
    """(query_id, id, score): the best rows of each cue by the summed weights of the terms they hold, over all live rows it allows.

    See `postings.ranked`: no pair of cue and row leaves the task that holds the row. Terms go by 64-bit hashes; scores are
    rounded to 9 places, so that ties do not hang on the order of the sum. Subjects are not looked at here.
    """
    held = posts.groupBy("id").agg(F.collect_list(F.xxhash64("term")).alias("hs")).join(_alive(directory), "id")
    held = stored(held.select("id", "hs", F.col("start").cast("double"), F.col("end").cast("double")))  # read once per block
    terms_of = weights.groupBy("query_id").agg(F.collect_list(F.struct(F.xxhash64("term").alias("h"), "w")).alias("ws"))
    asked = _timed(cues).join(cues.select("query_id", "k"), "query_id").join(terms_of, "query_id")
    return top_k(ranked(asked, held, block=block, rows=rows), cues)


def tier_lexical(cues: DataFrame, weights: DataFrame, posts: DataFrame, directory: DataFrame) -> DataFrame:
    """Tier L: all live episodes that share a term with the cue."""
    best = lexical_best(cues, weights, posts, directory)
    return _lexical(best, weights)


def _lexical(best: DataFrame, weights: DataFrame) -> DataFrame:
    reach = weights.select("query_id", "achievable").distinct()
    x = best.select("query_id", "id", "score").join(reach, "query_id")
    return x.withColumn("confidence", S.lexical_confidence(F.col("score"), F.col("achievable"))).withColumn("tier", F.lit("Lexical")).select(*MATCH)


def subject_candidates(cues: DataFrame, concepts: DataFrame, links: DataFrame) -> DataFrame:
    """(query_id, id): episodes linked to the subject a cue names; the name exactly, else by lower case."""
    asked = cues.filter("subject is not null").select("query_id", F.col("subject").alias("name"))
    found = asked.join(E.concept_lookup(asked, concepts).select("name", "concept_id"), "name")
    return found.join(links, "concept_id").select("query_id", F.col("episode_id").alias("id")).distinct()


def concept_candidates(cues: DataFrame, concepts: DataFrame, links: DataFrame) -> DataFrame:
    """(query_id, id): episodes linked to a concept whose whole name is a token of the cue."""
    names = concepts.select(F.col("canonical_name").alias("token"), F.col("id").alias("concept_id"))
    hit = E.cue_tokens(cues).join(names, "token").select("query_id", "concept_id").distinct()
    return hit.join(links, "concept_id").select("query_id", F.col("episode_id").alias("id")).distinct()


def tier_exact(cues: DataFrame, weights: DataFrame, posts: DataFrame, directory: DataFrame, concepts: DataFrame, links: DataFrame) -> DataFrame:
    """Tier A: episodes of the concepts a cue names, ranked by shared weight and labelled lexical.

    Under a subject all its episodes come back, those without shared weight last. Without any shared
    weight the candidates come back in id order, labelled exact with confidence 1.
    """
    with_subject = cues.filter("subject is not null").select("query_id", F.lit(True).alias("by_subject"))
    free = cues.filter("subject is null")
    cand = subject_candidates(cues, concepts, links).unionByName(concept_candidates(free, concepts, links))
    cand = allowed(cand, cues, directory).join(with_subject, "query_id", "left")
    held = posts.join(cand.select("query_id", "id"), "id").join(weights, ["query_id", "term"])
    held = held.groupBy("query_id", "id").agg(F.round(F.sum("w"), 9).alias("score"), F.max("achievable").alias("achievable"))
    x = cand.join(held, ["query_id", "id"], "left")
    any_score = F.max("score").over(Window.partitionBy("query_id"))
    x = x.withColumn("any", any_score.isNotNull()).withColumn("by_subject", F.coalesce("by_subject", F.lit(False)))
    x = x.filter("score is not null or by_subject or not any").withColumn("tier", F.when(F.col("any") | F.col("by_subject"), "Lexical").otherwise("Exact"))
    x = x.withColumn("score", F.coalesce("score", F.lit(0.0)))
    confidence = F.when(F.col("tier") == "Exact", 1.0).otherwise(S.lexical_confidence(F.col("score"), F.coalesce("achievable", F.lit(0.0))))
    return top_k(x.withColumn("confidence", confidence), cues).select(*MATCH)


def banded(scored: DataFrame, cues: DataFrame, floor: float, full: float, out: tuple[float, float], tier: str) -> DataFrame:
    """Rows at or above a floor, the best k, with their confidence in a band."""
    best = top_k(scored.filter(F.col("score") >= floor), cues)
    return best.withColumn("confidence", S.band(F.col("score"), floor, full, out)).withColumn("tier", F.lit(tier)).select(*MATCH)


def structured_cues(cues: DataFrame, concepts: DataFrame, words: int) -> DataFrame:
    """(query_id, hv): majority of the subject- and object-bound names of the first concepts a cue's tokens resolve to."""
    toks = E.cue_tokens(cues)
    exact = E.concept_lookup(toks.select(F.col("token").alias("name")), concepts)
    rest = toks.select(F.col("token").alias("name")).distinct().join(exact, "name", "left_anti")
    near = E.fuzzy_candidates(rest, concepts, 1).groupBy("name").agg(F.min("concept_id").alias("concept_id"))
    known = exact.select("name", "concept_id").unionByName(near)
    named = toks.join(known, toks["token"] == known["name"]).groupBy("query_id", "concept_id").agg(F.min("pos").alias("pos"))
    first = named.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).filter(F.col("_r") <= S.MAX_CUE_CONCEPTS)
    names = first.join(concepts.select(F.col("id").alias("concept_id"), "canonical_name"), "concept_id")
    own = hv.from_name("canonical_name", words)
    roles = F.array(*(hv.bind(hv.from_name(F.lit(r), words), own) for r in (hv.ROLE_SUBJECT, hv.ROLE_OBJECT)))
    return hv.bundle_groups(names.select("query_id", F.explode(roles).alias("hv")), "query_id", "hv", words).select("query_id", "hv")


def vector_scores(queries: DataFrame, stored: DataFrame, cues: DataFrame, directory: DataFrame, allow: DataFrame, words: int, by_phi: bool, floor: float | None) -> DataFrame:
    """(query_id, id, score): the best rows of each query vector over all stored vectors that its cue allows.

    At most SCAN_HEAD rows per cue, as for any scan of vectors. Cues under a subject are compared with the episodes
    of `allow` alone, a join.
    """
    k = min(most(cues), S.SCAN_HEAD)
    asked = queries.join(_timed(cues), "query_id")
    known = stored.filter("hv is not null").join(_alive(directory), "id")
    free = hv.ranked(asked.filter("subject is null"), known, k, words, by_phi, floor)
    named = asked.filter("subject is not null").select("query_id", F.col("hv").alias("q")).join(allow, "query_id").join(stored.filter("hv is not null").select("id", "hv"), "id")
    n, distance = words * hv.WORD_BITS, hv.hamming(F.col("q"), F.col("hv"))
    score = hv.phi(hv.popcount(F.col("q")), hv.popcount(F.col("hv")), distance, words) if by_phi else 1 - distance / float(n)
    named = allowed(named.select("query_id", "id", score.alias("score")), cues, directory)
    if floor is not None:
        named = named.filter(F.col("score") >= floor)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return free.unionByName(named.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r"))


def _left(cues: DataFrame, answered: DataFrame) -> DataFrame:
    return cues.join(answered.select("query_id").distinct(), "query_id", "left_anti")


def cascade(cues: DataFrame, episodes: DataFrame, tombstones: DataFrame, concepts: DataFrame, vectors: DataFrame | dict[str, DataFrame] | None = None, embedded_cues: DataFrame | None = None,
            floor: str = "NearestNeighbor", words: int = hv.FULL_WORDS) -> DataFrame:
    """(query_id, id, score, confidence, tier): the first tier with rows answers a cue, down to `floor`.

    vectors has id, sig, gist and emb (null where missing), in one table or as a table (id, hv) per name; without it
    only the tiers on tokens run. embedded_cues has query_id and hv for the semantic tier. min_confidence applies after the choice of the tier and may leave none.
    """
    # written down once: each plan of a tier then reads small tables, instead of making them anew
    cues = stored(with_defaults(cues))
    deepest = S.TIERS.index(floor)
    posts, directory = stored(E.postings(episodes)), stored(E.scan_directory(episodes, tombstones))
    links = stored(E.bridge(episodes, concepts))
    weights = stored(cue_weights(cues, posts, directory))
    allow = stored(subject_candidates(cues, concepts, links))
    spoken = cues.filter(F.size(terms("cue")) > 0)
    # each tier's rows are written down: what is left for the next tiers is then read, not computed anew
    out = checkpointed(tier_exact(cues, weights, posts, directory, concepts, links))

    def restricted(x: DataFrame) -> DataFrame:
        free = cues.filter("subject is null").select("query_id")
        return x.join(free, "query_id", "left_semi").unionByName(x.join(allow, ["query_id", "id"], "left_semi"))

    def add(rows: DataFrame) -> None:
        nonlocal out
        out = out.unionByName(checkpointed(rows.select(*MATCH)))

    def scanned(queries: DataFrame, column: str, left: DataFrame, by_phi: bool, least: float | None) -> DataFrame:
        known = vectors[column] if isinstance(vectors, dict) else vectors.select("id", F.col(column).alias("hv"))
        return vector_scores(queries, known, left, directory, allow, words, by_phi, least)

    if deepest >= 1:
        left = _left(cues, out)
        own = weights.join(left.select("query_id"), "query_id", "left_semi")
        add(_lexical(lexical_best(left.filter("subject is null"), own, posts, directory), own))
        named = left.filter("subject is not null")
        scored = lexical_scores(own.join(named.select("query_id"), "query_id", "left_semi"), posts)
        add(_lexical(top_k(allowed(restricted(scored), named, directory), named), own))
    if vectors is None:
        return out
    left = _left(spoken, out)
    if deepest >= 2 and not left.isEmpty():
        x = scanned(structured_cues(left, concepts, words), "sig", left, True, S.PHI_FLOOR)
        add(banded(x, left, S.PHI_FLOOR, S.PHI_FULL, S.BAND_B, "Similarity"))
        left = _left(spoken, out)
    if deepest >= 3 and embedded_cues is not None and not left.isEmpty():
        x = scanned(embedded_cues.join(left.select("query_id"), "query_id", "left_semi"), "emb", left, True, S.EMB_FLOOR)
        add(banded(x, left, S.EMB_FLOOR, S.EMB_FULL, S.BAND_E, "Semantic"))
        left = _left(spoken, out)
    if deepest >= 4 and not left.isEmpty():
        asked = left.select("query_id", hv.token_bundle(words)(terms("cue")).alias("hv"))
        x = checkpointed(scanned(asked, "gist", left, False, None))
        add(banded(x, left, S.GIST_FLOOR, S.GIST_FULL, S.BAND_C, "Gist"))
        if deepest >= 5:
            near = top_k(x.join(_left(left, out).select("query_id"), "query_id", "left_semi"), left)
            add(near.withColumn("confidence", S.nearest_confidence(F.col("score"))).withColumn("tier", F.lit("NearestNeighbor")))
    return out


def goal_bias(matches: DataFrame, goals: DataFrame, signatures: DataFrame, weight: float, words: int = hv.FULL_WORDS) -> DataFrame:
    """Confidence of the finalists drawn towards 1 by their largest similarity to an active goal.

    goals (id, hv) are the stated set the signatures of the finalists are scanned for; no row enters or leaves.
    """
    finalists = signatures.join(matches.select("id").distinct(), "id", "left_semi").select("id", "hv").persist()
    sims = hv.closest(goals.select(F.col("id").alias("query_id"), "hv"), finalists, words).withColumnRenamed("score", "sim")
    x = matches.join(sims, "id", "left")
    boosted = S.goal_boost(F.col("confidence"), F.lit(max(0.0, min(1.0, weight))), F.col("sim"))
    return x.withColumn("confidence", F.when(F.col("sim").isNull(), F.col("confidence")).otherwise(boosted)).drop("sim")


def recency_rerank(matches: DataFrame, directory: DataFrame, anchor: Column, weight: float, half_life_s: float = S.HALF_LIFE_S) -> DataFrame:
    """Confidence of the finalists blended with their recency."""
    w = max(0.0, min(1.0, weight))
    x = matches.join(directory.select("id", "valid_start"), "id", "left")
    blend = (1 - w) * F.col("confidence") + w * S.recency(anchor, F.col("valid_start"), half_life_s)
    return x.withColumn("confidence", F.coalesce(blend, "confidence")).drop("valid_start")


def finish(matches: DataFrame, cues: DataFrame, episodes: DataFrame) -> DataFrame:
    """Floor, final order and texts: query_id, rank, id, confidence, tier, text, superseded."""
    cues = with_defaults(cues)
    kept = matches.join(cues.select("query_id", "k", "min_confidence"), "query_id").filter("confidence >= min_confidence")
    w = Window.partitionBy("query_id").orderBy(F.desc("confidence"), F.desc("score"), "id")
    kept = kept.withColumn("rank", F.row_number().over(w)).filter("rank <= k")
    body = E.unique_episodes(episodes).select("id", "text", F.col("superseded_by").isNotNull().alias("superseded"))
    return kept.join(body, "id").select("query_id", "rank", "id", "confidence", "tier", "text", "superseded")


def tier_used(matches: DataFrame) -> DataFrame:
    """(query_id, tier): the shallowest tier among a cue's rows."""
    depth = F.array_position(F.array(*(F.lit(t) for t in S.TIERS)), F.col("tier"))
    return matches.groupBy("query_id").agg(F.min_by("tier", depth).alias("tier"))


def atoms_lane(cues: DataFrame, concepts: DataFrame, atoms: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(query_id, atom_id, claim, confidence, evidence_count): live atoms anchored at a concept a cue token names."""
    names = concepts.select(F.col("canonical_name").alias("token"), F.col("id").alias("concept_id"))
    hit = E.cue_tokens(cues).join(names, "token").select("query_id", "concept_id").distinct()
    alive = atoms.join(E.tombstoned_ids(tombstones, 2), "id", "left_anti")
    return hit.join(alive, "concept_id").select("query_id", F.col("id").alias("atom_id"), "claim", "confidence", "evidence_count")

"""The registered queries on vectors, at full width, against brute force on a small fixture."""

import hashlib
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import hv
from palimpsest.functions import scoring as S
from palimpsest.plans.memory_queries import QUERIES

AT = datetime(2024, 1, 1)
TEXTS = ["red fox runs", "red fox sleeps", "blue whale swims deep", "old owl", "red fox runs", "?!", None, "blue owl runs", "green whale", "deep red sea"]
CUES = [(1, "red fox"), (2, "blue whale owl"), (3, "!"), (4, "whale deep sea swims")]
NAMES = [(1, "Ann", "Person"), (2, "Bob", "person "), (3, "Rome", "place"), (4, "Acme", None), (5, "Oslo", "place")]
EPISODE = "id long, text string, triples array<struct<subject:string,predicate:string,object:string,confidence:double>>, valid_start timestamp_ntz, valid_end timestamp_ntz, t_tx_start timestamp_ntz, superseded_by long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("full"))
    save = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    save([(10 + i, t, [], AT, None, AT, None) for i, t in enumerate(TEXTS)], EPISODE, "episodes")
    save([(q, c, None, 10, "exact" if q == 1 else "noisy") for q, c in CUES], "query_id long, cue string, as_of timestamp_ntz, k int, cue_class string", "cues")
    save(NAMES, "id long, canonical_name string, entity_type string", "concepts")
    rng = np.random.default_rng(3)
    save([(i, [float(x) for x in rng.normal(size=64).astype(np.float32)]) for i in range(6)], "vec_id long, embedding array<float>", "embeddings")
    save([], "kind int, id long, tombstoned_at timestamp_ntz, audit_event_id long", "tombstones")
    return d


def name(x):
    return hv.name_bits(x, hv.FULL_WORDS).astype(int)


def bundle(text):
    ts = text.replace("?", "").replace("!", "").split() if text else []
    return (2 * sum(name(t) for t in ts) > len(ts)).astype(int) if ts else None


def bits(words):
    assert len(words) == hv.FULL_WORDS
    return np.concatenate([(np.int64(w) >> np.arange(hv.WORD_BITS)) & 1 for w in words])


def rows(spark, folder, query):
    return QUERIES[query](spark, folder).collect()


def test_gist_nearest_full(spark, folder):
    gists = {10 + i: bundle(t) for i, t in enumerate(TEXTS) if bundle(t) is not None}
    want = {}
    for q, cue in CUES:
        if (v := bundle(cue)) is not None:
            best = sorted((int((v != g).sum()), i) for i, g in gists.items())[:5]
            want |= {(q, i): round(1 - d / 8220, 6) for d, i in best}
    got = {(r.query_id, r.id): r.score for r in rows(spark, folder, "gist_nearest_full")}
    assert got == pytest.approx(want)
    assert {r.id: list(bits(r.hv)) for r in rows(spark, folder, "hv_majority_full")} == {i: list(g) for i, g in gists.items()}


def test_nearest_ties_and_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        stored = [(i * 37 % 101, [i % 4, 0]) for i in range(60)]
        s, q = spark.createDataFrame(stored, "id long, hv array<bigint>"), spark.createDataFrame([(i, [i, 0]) for i in range(5)], "query_id long, hv array<bigint>")
        got = {(r.query_id, r.id, r.distance) for r in hv.nearest(q, s, 9, 2, block=2, rows_at_once=3).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(i, n, d) for i in range(5) for d, n in sorted(((i ^ v[0]).bit_count(), n) for n, v in stored)[:9]}
    assert got == want


def test_algebra_full(spark, folder):
    v = {i: name(n) for i, n, _ in NAMES}
    got = {r.id: r.distance for r in rows(spark, folder, "hv_bind_similarity_full")}
    assert got == {i: int((v[i] != v[i + 1]).sum()) for i in v if i + 1 in v}
    role = name(hv.ROLE_SUBJECT)
    want = {i: np.corrcoef(x, x & role)[0, 1] for i, x in v.items()}
    assert {r.id: r.phi for r in rows(spark, folder, "hv_phi_band_full")} == pytest.approx(want, abs=1e-6)
    kinds = {}
    for i, _, kind in NAMES:
        kinds.setdefault(kind and kind.strip().lower(), []).append(v[i])
    for r in rows(spark, folder, "self_vector_folds_full"):
        members = kinds.pop(r.kind)
        assert (bits(r.any) == np.max(members, axis=0)).all() and (bits(r.odd) == np.sum(members, axis=0) % 2).all()
    assert not kinds


def test_projection_full(spark, folder):
    e = {r.vec_id: np.trunc(1024 * np.array(r.embedding, dtype=np.float64)).astype(int) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    signs = np.array([hv.name_bits(f"charikar:{i}", 2)[:64].astype(int) * 2 - 1 for i in range(8220)])
    got = {r.vec_id: bits(r.hv) for r in rows(spark, folder, "charikar_projection_full")}
    assert got.keys() == e.keys() and all((got[i] == (signs @ x > 0)).all() for i, x in e.items())


RECALL_CUES = [(1, "red fox"), (2, "annn"), (3, "foxtrot whalebone"), (4, "zq"), (5, "vvv kkk"), (6, "bobb romee"), (7, "?"), (8, "jj"), (9, "owlet")]


@pytest.fixture(scope="module")
def recall_folder(spark, tmp_path_factory):
    """40 episodes, so that at 240 bits the deeper tiers answer with chance hits."""
    d = str(tmp_path_factory.mktemp("recall"))
    save = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    who = ["Ann", "Bob", "Rome", "Acme", "Oslo"]
    triples = [[], [("Ann", "likes", "Bob", 0.5)], [("Bob", "lives_in", "Rome", 0.5), ("Acme", None, "Oslo", 0.5)], [(None, "likes", "Ann", 0.5)], None]
    more = [[(f"p{i}", f"v{i}", who[i % 5], 0.5), ("x", f"w{i}", f"o{i}", 0.5)] for i in range(30)]
    rows = [(10 + i, t, triples[i % 5], None if i == 2 else AT, None, AT, None) for i, t in enumerate(TEXTS)]
    rows += [(30 + i, f"note {i} about thing{i}", m, AT + timedelta(days=i), None, AT, None) for i, m in enumerate(more)]
    save(rows, EPISODE, "episodes")
    save([(q, c, None, 4, 0.0, "exact" if q in (1, 3) else "noisy") for q, c in RECALL_CUES], "query_id long, cue string, as_of timestamp_ntz, k int, min_confidence double, cue_class string", "cues")
    save(NAMES, "id long, canonical_name string, entity_type string", "concepts")
    save([], "kind int, id long, tombstoned_at timestamp_ntz, audit_event_id long", "tombstones")
    return d, rows


def signed(triples, start):
    members = []
    for s, p, o, _ in triples or []:
        if None not in (s, p, o):
            members.append((sum(name(r) ^ name(x) for r, x in ((hv.ROLE_SUBJECT, s), (hv.ROLE_PREDICATE, p), (hv.ROLE_OBJECT, o))) >= 2).astype(int))
    if triples and start:
        members.append(name(hv.ROLE_TIME) ^ name(start.strftime("%Y-%m-%d")))
    return (2 * sum(members) > len(members)).astype(int) if members else None


SIGNS = np.array([hv.name_bits(f"charikar:{i}", 5)[:256].astype(int) * 2 - 1 for i in range(8220)])


def embedded(text):
    ts = text.replace("?", "").replace("!", "").split() if text else []
    if not ts:
        return None
    v = np.zeros(256)
    for f, w in [("u:" + t, 1.0) for t in ts] + [(f"b:{a} {b}", 0.7) for a, b in zip(ts, ts[1:])] + [("t:" + t[i : i + 3], 0.4) for t in ts for i in range(len(t) - 2)]:
        v[int(hashlib.md5(f.encode()).hexdigest()[:15], 16) % 256] += w
    x = np.trunc(1024 * (v / np.sqrt((v * v).sum())).astype(np.float32).astype(float)).astype(int)
    return (SIGNS @ x > 0).astype(int)


def best(q, stored, score, floor, full, band, k=4):
    hits = sorted((-score(q, v), i) for i, v in stored.items() if v is not None and score(q, v) >= floor) if q is not None else []
    return {i: min(band[1], max(band[0], band[0] + (band[1] - band[0]) * (-s - floor) / (full - floor))) for s, i in hits[:k]}


def correlation(a, b):
    return np.corrcoef(a, b)[0, 1] if 0 < a.sum() < a.size and 0 < b.sum() < b.size else 0.0


def same(a, b):
    return float((a == b).mean())


def brute_cascade(cue, rows):
    """Tier and (id, confidence) of a cue that shares no term with an episode."""
    near = {"annn": ["Ann"], "bobb romee": ["Bob", "Rome"]}.get(cue, [])
    roles = [name(r) ^ name(n) for n in near for r in (hv.ROLE_SUBJECT, hv.ROLE_OBJECT)]
    q = (2 * sum(roles) > len(roles)).astype(int) if roles else None
    gists = {r[0]: g if (g := bundle(r[1])) is not None else np.zeros(8220, int) for r in rows}
    for tier, found in (
        ("Similarity", lambda: best(q, {r[0]: signed(r[2], r[3]) for r in rows}, correlation, S.PHI_FLOOR, S.PHI_FULL, S.BAND_B)),
        ("Semantic", lambda: best(embedded(cue), {r[0]: embedded(r[1]) for r in rows}, correlation, S.EMB_FLOOR, S.EMB_FULL, S.BAND_E)),
        ("Gist", lambda: best(bundle(cue), gists, same, S.GIST_FLOOR, S.GIST_FULL, S.BAND_C)),
        ("NearestNeighbor", lambda: best(bundle(cue), gists, same, 0.0, 1.0, (0.0, 0.3))),
    ):
        if hits := found():
            return tier, hits


def test_cascade_tiers_at_full_width(spark, recall_folder):
    d, rows_ = recall_folder
    got = {}
    for r in rows(spark, d, "cascade_recall"):
        got.setdefault(r.query_id, (r.tier, {}))[1][r.id] = r.confidence
    assert got.pop(1)[0] == "Lexical" and 7 not in got
    want = {q: brute_cascade(c, rows_) for q, c in RECALL_CUES if q not in (1, 7)}
    assert {q: t for q, (t, _) in got.items()} == {q: t for q, (t, _) in want.items()}
    assert {"Similarity", "Semantic", "NearestNeighbor"} <= {t for t, _ in want.values()}
    for q, (_, hits) in want.items():
        assert got[q][1] == pytest.approx(hits, abs=2e-6), q


def test_goal_bias_at_full_width(spark, recall_folder):
    d, rows_ = recall_folder
    gists = {r[0]: bundle(r[1]) for r in rows_}
    plain = {(r.query_id, r.id): r.confidence for r in rows(spark, d, "lexical_recall")}
    goals = [bundle(c) for q, c in RECALL_CUES if q in (1, 3)]
    want = {(q, i): c + 0.2 * max(same(g, gists[i]) for g in goals) * (1 - c) for (q, i), c in plain.items()}
    assert want and {(r.query_id, r.id): r.confidence for r in rows(spark, d, "goal_biased_recall")} == pytest.approx(want, abs=2e-6)


def test_signature_in_the_row(spark, recall_folder):
    e = spark.read.parquet(f"{recall_folder[0]}/episodes.parquet")
    grouped = {r.id: r.hv for r in hv.bundle_groups(hv.episode_members(e), "id", "hv").collect()}
    assert {r.id: r.v for r in e.select("id", hv.signature()(F.col("triples"), F.col("valid_start")).alias("v")).collect() if r.v} == grouped


def test_surprise_at_full_width(spark, recall_folder):
    d, rows_ = recall_folder
    v = [g if (g := bundle(r[1])) is not None else np.zeros(8220, int) for r in rows_]
    want = {}
    for i, r in enumerate(rows_):
        s = min((float((x != v[i]).mean()) for x in v[max(0, i - 64) : i]), default=1.0) if bundle(r[1]) is not None else 0.0
        want[r[0]] = (round(s, 6), s >= 0.4)
    assert {r.id: (r.surprise, r.promoted) for r in rows(spark, d, "surprise_scores")} == want


def test_aliases_within_three_edits(spark, tmp_path):
    names = ["Alexandre Stones", "Alexander Stne", "Margaret Hxll", "Alexandra S", "ALEXANDRA STONE"]
    spark.createDataFrame([(n,) for n in names], "subject string").write.parquet(f"{tmp_path}/triples.parquet")
    spark.createDataFrame([(1, "Alexandra Stone"), (2, "Margaret Hill"), (3, "Margaret Hall")], "id long, canonical_name string").write.parquet(f"{tmp_path}/concepts.parquet")
    got = {r.name: (r.concept_id, r.how) for r in rows(spark, str(tmp_path), "alias_resolution")}
    assert got == {"Alexandre Stones": (1, "fuzzy"), "Alexander Stne": (1, "fuzzy"), "ALEXANDRA STONE": (1, "lower"), "Alexandra S": (4, "new"), "Margaret Hxll": (5, "new")}

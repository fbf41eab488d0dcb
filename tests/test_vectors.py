import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import hv
from palimpsest.functions import scoring as S

W = 3


def bits(words):
    return np.concatenate([(np.int64(w) >> np.arange(hv.WORD_BITS)) & 1 for w in words])


@pytest.fixture(scope="module")
def vectors(spark):
    names = [f"name {i}" for i in range(30)] + ["Ünï"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id long, name string")
    return df.select("id", "name", hv.from_name("name", W).alias("hv")).persist()


def test_names_agree_with_python(vectors):
    for r in vectors.collect():
        assert (bits(r.hv) == hv.name_bits(r.name, W)).all()


def test_algebra(spark, vectors):
    b = vectors.select((F.col("id") + 1).alias("id"), F.col("hv").alias("b"))
    x = vectors.join(b, "id").select(
        "hv", "b", hv.bind(F.col("hv"), F.col("b")).alias("ab"), hv.hamming(F.col("hv"), F.col("b")).alias("d"), hv.similarity(F.col("hv"), F.col("b"), W).alias("s"),
        hv.bundle3(F.col("hv"), F.col("b"), hv.zero(W)).alias("m"), hv.ema(F.col("hv"), F.col("b")).alias("o"), hv.active_dims(F.col("hv"), W).alias("dims"), hv.popcount(F.col("hv")).alias("p"),
        hv.phi(hv.popcount(F.col("hv")), hv.popcount(F.col("hv")), F.lit(0), W).alias("self"), hv.phi(hv.popcount(F.col("hv")), F.lit(0), F.lit(5), W).alias("none"),
    )
    for r in x.collect():
        a, b = bits(r.hv), bits(r.b)
        assert [p ^ q for p, q in zip(r.ab, r.b)] == r.hv and r.d == (a != b).sum() and r.s == pytest.approx(1 - r.d / a.size)
        assert (bits(r.m) == (a & b)).all() and (bits(r.o) == (a | b)).all() and r.dims == list(np.flatnonzero(a)) and r.p == a.sum()
        assert r.self == pytest.approx(1.0) and r.none == 0.0


def test_majority_forms_agree(spark, vectors):
    rng = random.Random(4)
    pick = spark.createDataFrame([(g, rng.randrange(30)) for g in range(6) for _ in range(g + 1)], "g long, id long")
    rows = pick.join(vectors, "id")
    want = {}
    for r in rows.collect():
        want.setdefault(r.g, []).append(bits(r.hv))
    plain = {r.g: (r.n, bits(r.hv)) for r in hv.majority(rows.select("g", "hv"), ["g"], "hv", W).collect()}
    grouped = {r.g: (r.n, bits(r.hv)) for r in hv.bundle_groups(rows.select("g", "hv"), "g", "hv", W).collect()}
    for g, members in want.items():
        m = 2 * np.sum(members, axis=0) > len(members)
        assert plain[g][0] == grouped[g][0] == len(members) and (plain[g][1] == m).all() and (grouped[g][1] == m).all()
    tokens = spark.createDataFrame([(["a", "b", "a"],), ([],), (None,)], "t array<string>").select(hv.token_bundle(W)("t").alias("v")).collect()
    assert (bits(tokens[0].v) == hv.name_bits("a", W)).all() and tokens[1].v == tokens[2].v == [0] * W


def test_ranked_against_brute_force(spark, vectors):
    rng = random.Random(8)
    span = {r.id: (rng.choice([None, 5.0, 10.0]), rng.choice([None, 20.0, 30.0])) for r in vectors.collect()}
    times = spark.createDataFrame([(i, *x) for i, x in span.items()], "id long, start double, end double")
    ask = {q: (rng.choice([None, 7.0, 25.0]), rng.choice([None, 1.0, 21.0]), rng.choice([None, 6.0, 40.0])) for q in range(9)}
    queries = vectors.select(F.col("id").alias("query_id"), "hv").join(spark.createDataFrame([(q, *x) for q, x in ask.items()], "query_id long, as_of double, low double, high double"), "query_id")
    v = {r.id: bits(r.hv) for r in vectors.collect()}
    n = W * hv.WORD_BITS

    def fits(i, t, low, high):
        start, end = span[i]
        alive = t is None or (start is not None and start <= t and (end is None or t < end))
        return alive and (low is None or high is None or (start is not None and start <= high and (start if end is None else end) >= low))

    def phi(a, b):
        spread = float(a.sum()) * (n - a.sum()) * b.sum() * (n - b.sum())
        return (n * (a & b).sum() - float(a.sum()) * b.sum()) / np.sqrt(spread) if spread > 0 else 0.0

    for by_phi, floor, k in ((False, None, 4), (False, 0.5, 100), (True, 0.02, 3)):
        score = (lambda a, b: phi(a, b)) if by_phi else (lambda a, b: 1 - (a != b).sum() / n)
        got = {(r.query_id, r.id): r.score for r in hv.ranked(queries, vectors.join(times, "id"), k, W, by_phi, floor, block=4).collect()}
        want = {}
        for q, x in ask.items():
            all_ = sorted((-round(score(v[q], v[i]), 12), i) for i in v if fits(i, *x) and (floor is None or score(v[q], v[i]) >= floor))
            want |= {(q, i): -s for s, i in all_[:k]}
        assert got == pytest.approx(want)
    near = {r.id: r.score for r in hv.closest(queries.select("query_id", "hv"), vectors, W, block=4).collect()}
    assert near == pytest.approx({i: max(1 - (v[q] != v[i]).sum() / n for q in ask) for i in v})


def test_scores(spark):
    row = spark.range(1).select(
        S.band(F.lit(0.06), S.PHI_FLOOR, S.PHI_FULL, S.BAND_B).alias("low"), S.band(F.lit(0.9), S.PHI_FLOOR, S.PHI_FULL, S.BAND_B).alias("high"), S.lexical_confidence(F.lit(0.0), F.lit(0.0)).alias("none"),
        S.revised(F.lit(0.5), F.lit(True)).alias("up"), S.revised(F.lit(0.5), F.lit(False)).alias("down"), S.nearest_confidence(F.lit(0.5)).alias("near"),
        S.recency(F.timestamp_seconds(F.lit(604800)), F.timestamp_seconds(F.lit(0))).alias("rec"), S.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))).alias("cos"),
    ).collect()[0]
    assert (row.low, row.high, row.none, row.up, row.down, row.near) == pytest.approx((0.60, 0.95, 0.55, 0.575, 0.425, 0.15))
    assert row.rec == pytest.approx(np.exp(-1)) and row.cos == 0.0


def test_point_in_time_rules(spark):
    rows = spark.sql("select timestamp'2024-01-01' as valid_start, timestamp'2024-01-05' as valid_end union all select timestamp'2024-01-01', null union all select null, null")
    t = lambda s: F.lit(s).cast("timestamp")
    assert [r[0] for r in rows.select(S.valid_at(t("2024-01-05"))).collect()] == [False, True, False]  # the end is outside
    assert [r[0] for r in rows.select(S.overlaps(t("2024-01-05"), t("2024-02-01"))).collect()] == [True, False, False]  # both ends inside, an open end is a point
    assert [r[0] for r in rows.select(S.overlaps(t("2023-01-01"), t("2024-01-01"))).collect()] == [True, True, False]


def test_distances_by_products_are_exact():
    import numpy as np

    rng = np.random.default_rng(2)
    full = (1 << hv.WORD_BITS) - 1
    for words, n, m in ((1, 1, 5), (4, 7, 3), (137, 5, 600)):
        q, s = rng.integers(0, full + 1, (n, words)), rng.integers(0, full + 1, (m, words))
        q[0], s[0] = full, full
        assert (hv._distances(q)(s) == np.bitwise_count(q[:, None] ^ s[None]).sum(axis=2)).all()

import random
from datetime import datetime, timedelta

import pytest

from palimpsest.operators import history

TRIPLES = "triple_id long, episode_id long, subject string, predicate string, object string, confidence double, valid_start timestamp_ntz, valid_end timestamp_ntz, t_tx_start timestamp_ntz, hub string, block int"
DAY = datetime(2024, 1, 1)
PREDICATES = [("Works_At ", True, "organization"), ("likes", False, "place"), ("role", True, "value"), ("odd", None, None), (None, True, None)]


def norm(x):
    return " ".join(p for p in x.replace("\t", " ").split(" ") if p).lower().strip()


def make(seed, n, hot):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        subject = "Hot One" if rng.random() < hot else rng.choice([" hot  one", "B", "C\td", None])
        start = None if rng.random() < 0.03 else DAY + timedelta(hours=rng.randint(0, 300))
        end = None if start is None or rng.random() < 0.6 else start + timedelta(hours=rng.randint(-5, 30))
        predicate = rng.choice(["works_at", "WORKS_AT", " works_at ", "role", "likes", "odd"])
        rows.append((i, i, subject, predicate, rng.choice(["X", " x", "Y", "Z", None]), 0.5, start, end, DAY + timedelta(hours=rng.randint(0, 3)), "clash", 7))
    return rows + rng.sample(rows, n // 10)


def brute(rows):
    groups = {}
    for r in set(rows):
        if r[2] is None or r[4] is None or r[6] is None or norm(r[3]) not in ("works_at", "role"):
            continue
        best = groups.setdefault((norm(r[2]), norm(r[3])), {})
        if r[6] not in best or (r[8], r[0]) > (best[r[6]][8], best[r[6]][0]):
            best[r[6]] = r
    out = {}
    for best in groups.values():
        order = [best[t] for t in sorted(best)]
        opened = []
        for i, r in enumerate(order):
            p = order[i - 1] if i else None
            if p is None or norm(p[4]) != norm(r[4]) or (p[7] and p[7] > p[6] and r[6] - p[7] > timedelta(milliseconds=1)):
                opened.append(r[0])
        out |= dict(zip(opened, [*opened[1:], None]))
    return out


@pytest.mark.parametrize(("hot_rows", "blocks"), [(10**6, 8), (5, 4), (20, 16)])
@pytest.mark.parametrize("seed", [1, 2])
def test_versions_against_brute_force(spark, seed, hot_rows, blocks):
    rows = make(seed, 400, 0.6)
    obs = history.observations(spark.createDataFrame(rows, TRIPLES), spark.createDataFrame(PREDICATES, "predicate string, single_valued boolean, object_kind string"))
    got = history.satellites(obs, hot_rows, blocks).collect()
    assert len(got) == len({r.triple_id for r in got})
    assert {r.triple_id: r.closed_by for r in got} == brute(rows)


def test_periods_rates_and_empty(spark):
    predicates = spark.createDataFrame(PREDICATES, "predicate string, single_valued boolean, object_kind string")
    at = lambda d: DAY + timedelta(days=d)
    rows = [(1, 1, "a", "role", "x", 1.0, at(0), at(3), at(0), None, None), (2, 1, "a", "role", "y", 1.0, at(5), at(4), at(0), None, None), (3, 1, "a", "role", "z", 1.0, at(9), None, at(0), None, None)]
    v = history.satellites(history.observations(spark.createDataFrame(rows, TRIPLES), predicates))
    assert {r.triple_id: (r.valid_from, r.valid_to) for r in history.periods(v).collect()} == {1: (at(0), at(3)), 2: (at(5), at(9)), 3: (at(9), None)}
    rate = history.change_rates(v).collect()[0]
    assert (rate.attribute, rate.hubs, rate.versions, rate.rate, rate.satellite) == ("role", 1, 3, 2.0, "fast")
    empty = history.satellites(history.observations(spark.createDataFrame([], TRIPLES), predicates))
    assert empty.count() == 0 and history.change_rates(empty).count() == 0


@pytest.mark.parametrize(("seed", "parts", "hot_rows"), [(1, 2, 10**6), (2, 4, 5), (3, 3, 20)])
def test_any_division_into_batches_gives_the_same_history(spark, seed, parts, hot_rows):
    rows = make(seed, 300, 0.6)
    rng = random.Random(seed)
    dealt = [[] for _ in range(parts)]
    for r in rows:
        rng.choice(dealt).append(r)
    predicates = spark.createDataFrame(PREDICATES, "predicate string, single_valued boolean, object_kind string")
    numbered = [(*r, i) for i, b in enumerate(dealt) for r in b]
    obs = history.observations(spark.createDataFrame([r[:-1] for r in numbered], TRIPLES), predicates)
    obs = obs.join(spark.createDataFrame([(r[0], r[8], r[-1]) for r in numbered], "triple_id long, t_tx_start timestamp_ntz, load int").distinct(), ["triple_id", "t_tx_start"])
    satellites, cut = history.load(obs, parts, hot_rows, 4, fast=["role"])
    assert (cut is None) == (hot_rows == 10**6)
    got = history.view(satellites, cut).collect()
    assert len(got) == len({r.triple_id for r in got})
    assert {r.triple_id: r.closed_by for r in got} == brute(rows)
    assert {r.attribute for r in satellites[0].select("attribute").distinct().collect()} == {"role"}
    assert {r.attribute for r in satellites[1].select("attribute").distinct().collect()} == {"works_at"}


def observed(spark, rows):
    cols = "triple_id long, hub string, attribute string, value string, object string, valid_start timestamp_ntz, valid_end timestamp_ntz, t_tx_start timestamp_ntz"
    at = lambda d: None if d is None else DAY + timedelta(days=d)
    return spark.createDataFrame([(i, h, "role", v, v, at(s), at(e), at(0)) for i, h, v, s, e in rows], cols)


def test_append_only_changes(spark):
    old, new = [(1, "a", "A", 0, None), (2, "a", "B", 5, None), (3, "z", "A", 0, None)], [(4, "a", "B", 7, None), (5, "a", "C", 8, None), (6, "a", "C", 9, None), (7, "b", "A", 1, None)]
    satellite = history.append(None, observed(spark, old), None, 0).persist()
    assert {r.triple_id for r in satellite.collect()} == {1, 2, 3}
    added = history.append(satellite, observed(spark, old + new), observed(spark, new), 1)
    assert {(r.triple_id, r.opens, r.load) for r in added.collect()} == {(5, True, 1), (7, True, 1)}
    assert history.append(satellite, observed(spark, old), observed(spark, []), 1).count() == 0


def test_append_late_rows_and_stated_ends(spark):
    """A gap after a stated end, a late row before an unchanged one, a late row that takes an opening over."""
    old = [(1, "a", "B", 5, None), (2, "b", "A", 0, 2), (3, "c", "A", 0, None), (4, "c", "A", 6, None), (5, "d", "A", 5, None)]
    new = [(6, "a", "A", 3, None), (7, "a", "A", 8, None), (8, "b", "A", 8, None), (9, "c", "B", 3, None), (10, "d", "A", 2, None)]
    satellite = history.append(None, observed(spark, old), None, 0).persist()
    assert {r.triple_id for r in satellite.collect()} == {1, 2, 3, 5}
    added = {(r.triple_id, r.opens) for r in history.append(satellite, observed(spark, old + new), observed(spark, new), 1).collect()}
    assert added == {(6, True), (7, True), (8, True), (9, True), (4, True), (10, True), (5, False)}

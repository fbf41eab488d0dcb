import random
from datetime import datetime, timedelta

import pytest

from palimpsest.operators import orphans

DAY = datetime(2024, 1, 1)


def tables(seed):
    rng = random.Random(seed)
    at = lambda: DAY + timedelta(hours=rng.randint(0, 3000))
    episodes = [(i, at()) for i in range(0, 80) if i % 7] + [(5, DAY + timedelta(hours=rng.randint(0, 3000))), (None, at()), (200, None)]
    keys = [0, -1, 3, 5, None] + list(range(90)) + [200]
    triples = [(i, rng.choice([0, 3, 3, 5] if rng.random() < 0.6 else keys), at(), "x", 1) for i in range(600)]
    triples += triples[:40]
    stones = [(rng.choice([0, 0, 1, 2]), rng.choice(keys), at(), None, 9) for _ in range(50)]
    stones = list({(k, i): (k, i, *r) for k, i, *r in stones}.values())
    stones += stones[:5]
    scans = [(i, at() if i % 11 else None, rng.choice([True, False, None])) for i in range(0, 95)] + [(None, at(), True)]
    return episodes, triples, stones, scans


def brute(episodes, triples, stones, scans):
    there, gone = {}, {}
    for i, t in episodes:
        if i is not None:
            there[i] = t if i not in there or there[i] is None else min(x for x in (t, there[i]) if x is not None)
    for k, i, t, *_ in stones:
        if k == 0 and i is not None:
            gone[i] = min(t, gone.get(i, t))
    ym = lambda t: t and f"{t:%Y-%m}"
    out = set()
    for i, e, t, *_ in triples:
        if e is None:
            continue
        why = "missing" if e not in there else "late" if there[e] and t < there[e] else "deleted" if e in gone and gone[e] <= t else None
        out |= {("triples", ym(t), i, why)} if why else set()
    out |= {("tombstones", ym(t), i, "missing") for k, i, t, *_ in stones if k == 0 and i is not None and i not in there}
    for i, t, f in scans:
        if i is not None:
            why = "missing" if i not in there else "no_tombstone" if f and i not in gone else "deleted" if not f and i in gone else None
            out |= {("scan_entries", ym(t), i, why)} if why else set()
    return out


def frames(spark, episodes, triples, stones, scans):
    return (
        spark.createDataFrame(episodes, "id long, t_tx_start timestamp_ntz"), spark.createDataFrame(triples, "triple_id long, episode_id long, t_tx_start timestamp_ntz, key string, at int"),
        spark.createDataFrame(stones, "kind int, id long, tombstoned_at timestamp_ntz, reason string, audit_event_id long"), spark.createDataFrame(scans, "id long, valid_start timestamp_ntz, tombstoned boolean"),
    )


@pytest.mark.parametrize("heavy", [10**6, 20, 3])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed, heavy):
    data = tables(seed)
    e, t, s, c = frames(spark, *data)
    found = orphans.orphans(orphans.references(t, s, c), *orphans.targets(e, s), heavy_refs=heavy)
    got = [tuple(r) for r in found.select("source_table", "ym", "source_key", "reason").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(*data)
    counts = {(r.source_table, r.ym, r.reason): r.orphans for r in orphans.orphan_counts(found).collect()}
    assert sum(counts.values()) == len(got)


def test_empty(spark):
    e, t, s, c = frames(spark, *tables(1))
    none = lambda x: x.filter("false")
    assert orphans.orphans(orphans.references(none(t), none(s), none(c)), *orphans.targets(e, s)).count() == 0
    missing = orphans.orphans(orphans.references(t, none(s), none(c)), *orphans.targets(none(e), none(s)))
    assert {r.reason for r in missing.collect()} == {"missing"}

"""Ranking of cues over postings against brute force, and what it keeps away from shuffles."""

import datetime as dt
import math
import random
import re
from collections import Counter

import numpy as np

from palimpsest.functions.postings import Postings
from palimpsest.operators import evaluate
from palimpsest.plans import memory_queries

DAY = dt.datetime(2024, 1, 1)


def test_best_rows_against_brute_force():
    rng = np.random.default_rng(3)
    for round_ in range(60):
        n, known = int(rng.integers(1, 400)), 40
        share = rng.random(known) ** 4  # from rare to common
        held = rng.random((known, n)) < share[:, None]
        impact = rng.integers(1, 4, (known, n)) / 2.0 if round_ % 2 else np.ones((known, n))
        place, row = np.nonzero(held)
        mixed = np.argsort(row, kind="stable")
        own = Postings(n, place[mixed], row[mixed], impact[place, row][mixed] if round_ % 2 else None, known)
        ids = rng.permutation(n) * 3
        for _ in range(20):
            terms = rng.choice(known, int(rng.integers(0, 9)), replace=False)
            weights = rng.choice([0.5, 1.0, 2.25, 7.0], len(terms))
            fits = rng.random(n) < 0.7 if rng.random() < 0.5 else None
            k = int(rng.integers(1, 30))
            scores = np.round((weights[:, None] * impact[terms] * held[terms]).sum(axis=0), 9) if len(terms) else np.zeros(n)
            allowed = [r for r in range(n) if scores[r] > 0 and (fits is None or fits[r])]
            expected = sorted(((-scores[r], ids[r]) for r in allowed))[:k]
            best, got = own.best(terms, weights, k, ids, fits)
            assert list(zip(-got, ids[best])) == expected
            assert not own._scores.any()


def pairs_moved(query):
    """Whether a plan sends rows of cue and text through a shuffle to add them up."""
    return bool(re.search(r"hashpartitioning\(query_id#\d+L, id#\d+L", query._jdf.queryExecution().executedPlan().toString()))


def made(spark, n, m):
    rng = random.Random(5)
    common, rare = [f"c{i}" for i in range(8)], [f"rare{i}" for i in range(60)]
    text = lambda: " ".join(rng.choices(common, k=6) + rng.choices(rare, k=2))
    eps = spark.createDataFrame([(i, text(), DAY) for i in range(n)], "id long, text string, t_tx_start timestamp_ntz")
    cues = spark.createDataFrame([(i, text()) for i in range(m)] + [(m, None), (None, "c1")], "query_id long, cue string")
    return cues, eps


def test_bm25_ranks_inside_the_tasks(spark):
    cues, eps = made(spark, 300, 40)
    got = evaluate.bm25(cues, eps, 5)
    assert not pairs_moved(got)
    docs = {r.id: Counter(r.text.split()) for r in eps.collect()}
    df = Counter(t for d in docs.values() for t in d)
    mean = sum(sum(d.values()) for d in docs.values()) / len(docs)
    expected = {}
    for r in cues.filter("query_id is not null and cue is not null").collect():
        scores = Counter()
        for t in set(r.cue.split()):
            for i, d in docs.items():
                if d[t]:
                    part = d[t] * 2.2 / (d[t] + 1.2 * (0.25 + 0.75 * sum(d.values()) / mean))
                    scores[i] += math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * part
        expected |= {(r.query_id, i): s for i, s in sorted(((i, round(s, 9)) for i, s in scores.items()), key=lambda x: (-x[1], x[0]))[:5]}
    rows = {(r.query_id, r.id): r.score for r in got.collect()}
    assert rows.keys() == expected.keys() and all(abs(rows[x] - expected[x]) < 1e-8 for x in rows)
    assert evaluate.bm25(cues, eps.filter("id < 0")).count() == 0


def test_naive_scan_ranks_inside_the_tasks(spark):
    cues, eps = made(spark, 300, 40)
    got = evaluate.naive_scan(cues, eps, 5)
    assert not pairs_moved(got)
    texts, expected = {r.id: r.text for r in eps.collect()}, set()
    for r in cues.filter("query_id is not null and cue is not null").collect():
        scores = {i: float(sum(t in x for t in set(r.cue.split()))) for i, x in texts.items()}
        expected |= {(r.query_id, i, s) for i, s in sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:5] if s}
    assert {tuple(r) for r in got.collect()} == expected


def test_subject_recall_reads_tables_made_once(spark):
    got = memory_queries.subject_recall(spark, "/root/testdata/sf0.001")
    assert got.count() and not any("episodes.parquet" in f or "cues.parquet" in f for f in got.inputFiles())

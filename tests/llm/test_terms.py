import math
import random
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from palimpsest.llm import distinct, neardup, termfreq

EPISODES = "id long, text string, extra string"


def words(t):
    return regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["Éa", "日本", "x1"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 30))), "e") for i in range(120)]
    rows += [(200, None, None), (201, "", None), (202, " ... !", None), (3, rows[3][1], "again"), (None, "lost words", None)]
    rows += [(300 + i, rows[i][1] + " new", "e") for i in range(20)] + [(330, "long " + "w1 w2 " * 20_000, None)]
    return rows


def collection(rows):
    return {i: t for i, t, _ in rows if i is not None}


def test_counts_and_bands(spark, texts):
    recs = termfreq.records(spark.createDataFrame(texts, EPISODES))
    own = {i: Counter(words(t)) for i, t in collection(texts).items()}
    occurrences, records = Counter(), Counter()
    for c in own.values():
        occurrences.update(c)
        records.update(c.keys())
    n = sum(1 for c in own.values() if c)
    got = {r.term: r for r in termfreq.with_bands(termfreq.term_counts(recs), termfreq.record_count(recs)).collect()}
    assert {t: (r.occurrences, r.records) for t, r in got.items()} == {t: (occurrences[t], records[t]) for t in records}
    for t, r in got.items():
        assert r.band == ("rare" if records[t] <= 2 else "common" if records[t] > 0.2 * n else None)


def test_empty_collection(spark):
    empty = spark.createDataFrame([], EPISODES)
    recs = termfreq.records(empty)
    assert termfreq.with_bands(termfreq.term_counts(recs), termfreq.record_count(recs)).count() == 0
    assert distinct.term_scores(recs).count() == 0
    cues = spark.createDataFrame([(1, "word")], "query_id long, cue string")
    assert distinct.match_cues(cues, empty).count() == 0
    pairs, members = neardup.near_duplicates(empty)
    assert pairs.count() == 0 and members.count() == 0


def g2(a, b, c, d):
    n, total = a + b + c + d, 0.0
    for o, r, k in ((a, a + b, a + c), (b, a + b, b + d), (c, c + d, a + c), (d, c + d, b + d)):
        if o:
            total += 2 * o * math.log(o * n / (r * k))
    total = max(total, 0.0)
    return total if a * (b + d) >= b * (a + c) else -total


def test_llr_against_brute_force(spark, texts):
    own = {i: Counter(words(t)) for i, t in collection(texts).items()}
    cf, total = Counter(), 0
    for c in own.values():
        cf.update(c)
        total += sum(c.values())
    got = {(r.id, r.term): r.llr for r in distinct.term_scores(termfreq.records(spark.createDataFrame(texts, EPISODES))).collect()}
    assert len(got) == sum(len(c) for c in own.values())
    for i, c in own.items():
        size = sum(c.values())
        for t, a in c.items():
            want = g2(a, cf[t] - a, size - a, total - size - cf[t] + a)
            assert got[i, t] == pytest.approx(want, abs=1e-6)


def test_llr_array_is_the_column():
    import numpy as np

    rng = np.random.default_rng(2)
    a, b, c, d = (rng.integers(0, 50, 200) for _ in range(4))
    want = [g2(*x) for x in zip(a.tolist(), b.tolist(), c.tolist(), d.tolist()) if sum(x)]
    got = [x for x, n in zip(distinct.llr_array(a, b, c, d), a + b + c + d) if n]
    assert got == pytest.approx(want, abs=1e-9)


def test_characteristic_terms(spark):
    """What a record may leave out are its common terms in order of their ratio, with their weights summed up."""
    recs = spark.createDataFrame([(i, "the end of w%d " % i + "the " * (i % 3)) for i in range(50)], "id long, text string")
    h = {t: spark.range(1).select(F.xxhash64(F.lit(t)).alias("h")).collect()[0].h for t in ("the", "of", "end")}
    cf, total = 50 + sum(i % 3 for i in range(50)), 200 + sum(i % 3 for i in range(50))
    got = distinct.characteristic(distinct.hashed_terms(recs), [(h["the"], 50, cf), (h["of"], 40, 50)], 50, total).collect()
    assert len(got) == 50
    for r in got:
        spent = dict(zip(r.hs, r.spent))
        assert len(spent) == 4 and spent[h["end"]] == math.inf
        size = 4 + r.id % 3
        order = sorted([(g2(1 + r.id % 3, cf - 1 - r.id % 3, size - 1 - r.id % 3, total - size - cf + 1 + r.id % 3), "the", 0.5), (g2(1, 49, size - 1, total - size - 49), "of", math.log(50 / 40) + 0.5)])
        assert spent[h[order[0][1]]] == pytest.approx(order[0][2]) and spent[h[order[1][1]]] == pytest.approx(order[0][2] + order[1][2])


@pytest.mark.parametrize("slack", [0.0, 0.1, 0.6])
def test_cues_against_brute_force(spark, texts, slack):
    rng = random.Random(9)
    cues = [(k, " ".join(rng.choice([f"W{i}" for i in range(60)] + ["unknown", "日本"]) for _ in range(rng.randint(1, 5)))) for k in range(60)]
    cues += [(100, None), (101, "?!"), (102, ""), (3, cues[3][1]), (None, "w1"), (103, "w1 w1 w2")]
    own = {i: set(words(t)) for i, t in collection(texts).items()}
    n = sum(1 for s in own.values() if s)
    df = Counter(t for s in own.values() for t in s)
    weight = lambda t: math.log(n / df[t] if df[t] else n) + 0.5
    want = set()
    for q, cue in cues:
        terms = set(words(cue))
        if q is None or not terms:
            continue
        need = 0.7 * sum(map(weight, terms)) - 1e-9
        want |= {(q, i) for i, s in own.items() if sum(weight(t) for t in terms & s) >= need and terms & s}
    found = distinct.match_cues(spark.createDataFrame(cues, "query_id long, cue string"), spark.createDataFrame(texts, EPISODES), slack=slack).collect()
    assert len(found) == len(want) and {(r.query_id, r.id) for r in found} == want


def near_pairs(rows, percent, least):
    sets = {i: frozenset(words(t)) for i, t in collection(rows).items()}
    sets = {i: s for i, s in sets.items() if len(s) >= least}
    ids = sorted(sets)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) * 100 >= len(sets[a] | sets[b]) * percent}


def edited(rng, base, edits, pool):
    out = list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = rng.choice(pool)
    return out


@pytest.mark.parametrize(("common", "long_set", "hot", "group"), [(512, 384, 2_000, 16), (3, 384, 2_000, 16), (3, 40, 16, 2), (3, 14, 16, 4)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, common, long_set, hot, group):
    for name, value in (("COMMON", common), ("LONG_SET", long_set), ("HOT_KEY", hot)):
        monkeypatch.setattr(neardup, name, value)
    rng = random.Random(common + group)
    pool = [f"t{i}" for i in range(300)]
    rows = []
    for b in range(12):
        base = rng.sample(pool[: 40 + 20 * b], rng.randint(12, 30 + 2 * b))
        for _ in range(rng.randint(1, 9)):
            rows.append((len(rows) * 2, " ".join(edited(rng, base, rng.randint(0, 6), pool)), "x"))
    rows += [(1001, rows[0][1].upper(), None), (1003, " ".join(reversed(rows[0][1].split())), None), (rows[1][0], rows[1][1], "twice")]
    rows += [(2001, None, None), (2003, "", None), (2005, "too few terms here", None), (None, rows[0][1], None)]
    # shingle-sized worst case of common words only
    rows += [(3001 + i, " ".join(edited(rng, pool[:14], 1, pool[:18])), None) for i in range(10)]
    df = spark.createDataFrame(rows, EPISODES)
    pairs, members = neardup.near_duplicates(df, 75, 12, group)
    found = [tuple(r) for r in neardup.record_pairs(pairs, members).collect()]
    want = near_pairs(rows, 75, 12)
    assert len(found) == len(set(found)) and set(found) == want
    links = Counter(x for p in want for x in p)
    counts = {r.id: r for r in neardup.duplicate_counts(pairs, members).collect()}
    assert all(counts[i].links >= (1 if links[i] else 0) for i in counts)


def on_disk(spark):
    """Bytes of the local files of shuffles and kept blocks."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size()))


def test_near_duplicates_leave_no_files(spark):
    """Every step's shuffle files and kept tables are gone when the pairs are found, without waiting for a collection of garbage."""
    rng = random.Random(4)
    pool = [f"t{i}" for i in range(5_000)]
    rows = []
    for _ in range(400):
        base = rng.sample(pool, 40)
        rows += [(len(rows) + k, " ".join(edited(rng, base, k, pool)), None) for k in range(3)]
    before, kept = on_disk(spark), spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    pairs, members = neardup.near_duplicates(spark.createDataFrame(rows, EPISODES))
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() <= kept
    assert pairs.count() == 1_200 and members.count() == 1_200
    assert on_disk(spark) - before < 8 * 40 * len(rows) // 4  # a quarter of one copy of the hashed terms


def test_lookup_keys_meet(spark):
    """Any two sets similar enough share a key, whatever the split into rare and common terms."""
    import numpy as np

    rng = random.Random(1)
    for _ in range(400):
        n = rng.randint(12, 60)
        universe = sorted(rng.sample(range(10**6), n + 20))
        a = set(rng.sample(universe, n))
        b = set(a)
        for x in rng.sample(sorted(a), rng.randint(0, n // 5)):
            b.discard(x)
            if rng.random() < 0.7:
                b.add(rng.choice(universe))
        if len(a & b) * 100 < len(a | b) * 75 or len(b) < 12:
            continue
        count = {x: rng.choice([1, 400, 600, 5000]) for x in universe}
        keys = []
        for t in (a, b):
            o = sorted(t, key=lambda x: (count[x], x))
            keys.append([set(k.tolist()) for k in neardup.lookup_keys(np.array(o), np.array([count[x] > 512 for x in o]), 75)])
        (asked_a, listed_a), (asked_b, listed_b) = keys
        assert (len(a) < len(b) or asked_a & listed_b) and (len(b) < len(a) or asked_b & listed_a)


def test_cues_in_blocks_leave_no_files(spark, monkeypatch):
    """Many blocks of cues give what one gives, and neither postings nor kept blocks stay on disk."""
    rng = random.Random(8)
    pool = [f"t{i}" for i in range(2_000)]
    rows = [(i, " ".join(rng.sample(pool, 40)), None) for i in range(1_200)]
    cues = [(i, " ".join(rng.sample(rows[i][1].split(), 5))) for i in range(100)] + [(500, pool[0]), (501, "unknown")]
    episodes, asked = spark.createDataFrame(rows, EPISODES), spark.createDataFrame(cues, "query_id long, cue string")
    before, kept = on_disk(spark), spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    one = sorted(map(tuple, distinct.match_cues(asked, episodes).collect()))
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() <= kept
    assert on_disk(spark) - before < 8 * 40 * len(rows) // 4  # a quarter of one copy of the hashed terms
    assert {(i, i) for i in range(100)} <= set(one)
    monkeypatch.setattr(distinct, "BLOCK_TERMS", 100)
    assert sorted(map(tuple, distinct.match_cues(asked, episodes).collect())) == one


@pytest.mark.parametrize("at_once", [1, 7, 1 << 21])
def test_matches_in_runs(monkeypatch, at_once):
    """A task's candidates are checked in runs of any size; what a record leaves out below the slack is not opened."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(distinct, "AT_ONCE", at_once)
    rng = random.Random(6)
    weight = {t: rng.uniform(0.5, 3) for t in range(-15, 15)}
    cues = []
    for q in range(12):
        own = rng.sample(sorted(weight), rng.randint(1, 6))
        asks = rng.sample(own, rng.randint(1, len(own)))
        cues.append({"query_id": 70 + q, "need": 0.6 * sum(weight[t] for t in own), "slack": rng.choice([0.0, 0.5, 2.0]), "weights": [{"h": t, "w": weight[t]} for t in own], "signature": asks})
    schema = pa.schema({"query_id": pa.int64(), "need": pa.float64(), "slack": pa.float64(), "weights": pa.list_(pa.struct({"h": pa.int64(), "w": pa.float64()})), "signature": pa.list_(pa.int64())})
    recs = [sorted(rng.sample(range(-20, 20), rng.randint(0, 20))) for _ in range(30)]
    spent = [[rng.choice([4, 16, 40, distinct.UNBOUNDED]) for _ in r] for r in recs]
    want = set()
    for i, r in enumerate(recs):
        cost = dict(zip(r, spent[i]))
        for k, c in enumerate(cues):
            opened = any(t in cost and (cost[t] == distinct.UNBOUNDED or cost[t] >= c["slack"] * distinct.STEPS) for t in c["signature"])
            if opened and sum(x["w"] for x in c["weights"] if x["h"] in cost) >= c["need"]:
                want.add((i, k))
    flat = lambda x, kind: np.array([t for r in x for t in r], dtype=kind)
    found = distinct._matches(np.array([len(r) for r in recs]), flat(recs, np.int64), flat(spent, np.int16), distinct._block(pa.Table.from_pylist(cues, schema)))
    got = [p for rows, ks in found for p in zip(rows.tolist(), ks.tolist())]
    assert want and len(got) == len(set(got)) and set(got) == want

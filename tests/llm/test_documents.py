import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import mixing, packing, splitting


def least_bins(sizes, capacity):
    """Fewest containers by trying all fillings of the container of the largest item."""
    items = sorted(sizes, reverse=True)
    if not items:
        return 0
    best = len(items)
    rest = items[1:]
    for n in range(len(rest) + 1):
        for chosen in combinations(range(len(rest)), n):
            if items[0] + sum(rest[i] for i in chosen) <= capacity:
                best = min(best, 1 + least_bins([x for i, x in enumerate(rest) if i not in chosen], capacity))
    return best


@pytest.mark.parametrize("seed", range(12))
def test_bin_completion_is_best_on_small_sets(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 60) for _ in range(8)]
    best = least_bins(sizes, 100)
    exact, proven = packing.complete(sizes, 100, packing.EXACT)
    assert proven and len(exact) == best and packing.least_containers(sizes, 100) <= best
    got, proven = packing.complete(sizes, 100)
    assert sorted(i for b in got for i in b) == list(range(8))
    assert all(sum(sizes[i] for i in b) <= 100 for b in got)
    assert len(got) <= len(packing.best_fit(sizes, 100)) and (len(got) == best or not proven)


def test_bin_completion_beats_best_fit():
    """Sets cut from full containers, where decreasing order often needs one more."""
    greedy = best = 0
    for seed in range(40):
        rng = random.Random(seed)
        sizes = []
        for _ in range(12):
            a, b = sorted(rng.sample(range(15, 85), 2))
            sizes += [a, b - a, 100 - b]
        greedy += len(packing.best_fit(sizes, 100)) - 12
        best += len(packing.complete(sizes, 100)[0]) - 12
    assert greedy > 10 and best < greedy / 10


def test_dominance():
    assert packing.dominates((50, 20), (40, 10, 20)) and packing.dominates((9,), (5, 4)) and packing.dominates((5, 5), (5, 5))
    assert not packing.dominates((5, 4), (9,)) and not packing.dominates((30, 30), (29, 29, 2)) and packing.dominates((3,), ())


def test_search_without_bounds_keeps_every_branch():
    """A tight effort may stop short and then proves nothing; without bounds the best is found."""
    rng = random.Random(11)
    stopped = 0
    for _ in range(30):
        sizes = [rng.randint(20, 55) for _ in range(9)]
        tight, proven = packing.complete(sizes, 100, packing.Effort(3, 1, 1))
        exact, sure = packing.complete(sizes, 100, packing.EXACT)
        assert sure and len(exact) == least_bins(sizes, 100) and (len(tight) == len(exact) or not proven)
        stopped += not proven
    assert stopped


def test_pack(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([0, None, 100, 101, 250, 1000, rng.randint(1, 99)]), "x") for i in range(900)] + [(None, 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, tokens long, capacity string")
    got = packing.pack(docs, [("a", 100), ("b", 400), ("none", None), ("zero", 0)], block_items=64).collect()
    for profile, capacity in (("a", 100), ("b", 400)):
        own = [r for r in got if r.profile == profile]
        room, total, parts = {}, {}, {}
        for r in own:
            room[r.container] = room.get(r.container, 0) + r.tokens
            total[r.doc_id] = total.get(r.doc_id, 0) + r.tokens
            parts.setdefault(r.doc_id, []).append(r.piece)
        assert max(room.values()) <= capacity and all(r.capacity == capacity for r in own)
        assert total == {i: t or 0 for i, t, _ in rows if i is not None}
        for i, t, _ in rows:
            if i is not None:
                assert sorted(parts[i]) == ([0] if (t or 0) <= capacity else list(range(1, -(-t // capacity) + 1)))
        assert sum(room.values()) / (len(room) * capacity) > 0.95
    assert {(r.profile, r.doc_id) for r in got if r.piece and r.solved} == {(p, i) for p, c in (("a", 100), ("b", 400)) for i, t, _ in rows if i is not None and (t or 0) > c}
    packed = packing.pack(docs, [("a", 100), ("b", 400)], block_items=64)
    good = packing.audit(packed, docs).collect()
    assert len(good) == 2 and all((r.overfull, r.scattered, r.unsolved) == (0, 0, 0) and r.items == 900 for r in good)
    broken = packing.audit(packed.withColumn("container", F.lit("all")).withColumn("solved", F.lit(False)), docs).collect()
    assert all(r.overfull == 1 and r.unsolved > 0 for r in broken)
    assert all(r.scattered > 0 for r in packing.audit(packed.unionByName(packed.limit(5)), docs).collect() if r.scattered) and packing.containers(packed).count() == 2
    assert packing.pack(docs.filter("false"), [("a", 10)]).count() == 0
    assert packing.pack(docs, []).count() == 0


def test_rake_meets_margins_and_caps():
    rng = np.random.default_rng(1)
    cells = np.array([(a, b) for a in range(3) for b in range(4)])
    tokens = rng.integers(50, 500, 12).astype(float)
    margins = [np.bincount(cells[:, 0], tokens, 3), tokens.sum() * np.array([0.1, 0.2, 0.3, 0.4])]
    w = mixing.rake(tokens, cells, margins, np.full(12, 10.0))
    for d in range(2):
        assert np.bincount(cells[:, d], w * tokens, len(margins[d])) == pytest.approx(margins[d], rel=1e-3)
    capped = mixing.rake(tokens, cells, margins, np.full(12, 1.0))
    assert capped.max() <= 1 + 1e-9
    own = np.bincount(cells[:, 1], tokens, 4)
    short = own < margins[1]
    assert np.bincount(cells[:, 1], capped * tokens, 4)[short] == pytest.approx(own[short])


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, "x" * rng.randint(0, 400), rng.choice([" Big", "BIG ", "big"]) if i % 10 < 7 else "mid", rng.choice(["en", "EN", "de-DE", None, "?"]), "q") for i in range(4000)]
    rows += [(5000 + i, "y" * 300, "tiny", "en", "q") for i in range(10)] + [(6000, None, "mid", "en", "q"), (6001, "z", None, None, "q"), (None, "zz", "big", "en", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, weight string")
    targets = spark.createDataFrame([("Big", 0.5, 1), ("mid", 0.4, 3), ("tiny", 0.05, 4), ("absent", 0.05, 2), (None, 0.1, 1), ("nothing", None, 1)], "source string, target_share double, max_repeats int")
    taken, report = mixing.mix(docs, targets)
    used = taken.collect()
    assert len({r.doc_id for r in used}) == len(used) == 4011
    caps = {"big": 1, "mid": 3, "tiny": 4}
    assert all(0 <= r.repeats <= caps[r.source] for r in used)
    by = {r.source: r for r in report.collect()}
    assert set(by) == {"big", "mid", "tiny", "absent"}
    assert {s for s, r in by.items() if r.short} == {"tiny", "absent"}
    assert all(r.repeats == 4 for r in used if r.source == "tiny")
    assert by["big"].share_of_all == pytest.approx(0.5, abs=0.01) and by["mid"].share_of_all == pytest.approx(0.4, abs=0.01)
    assert sum(r.share_of_mix for r in by.values()) == pytest.approx(1)
    assert all(not r.over_repeats and r.on_target for r in mixing.audit(report, 0.01).collect())
    assert any(not r.on_target for r in mixing.audit(report.withColumn("share_of_all", F.lit(0.9)), 0.01).collect())
    none, empty = mixing.mix(docs.filter("false"), targets)
    assert none.count() == 0 and empty.filter("short").count() == 0 and empty.count() == 4
    # target shares of a language
    more, _ = mixing.mix(docs, targets.filter("source = 'Big' or source = 'mid'"), lang_shares={"en": 0.6})
    text = more.join(docs.select("doc_id", F.lower("lang").alias("l")), "doc_id")
    en = text.agg((F.sum(F.when(F.col("l") == "en", F.col("tokens") * F.col("repeats"))) / F.sum(F.col("tokens") * F.col("repeats"))).alias("s")).collect()[0].s
    assert en > 0.5
    assert mixing.mix(docs, targets.filter("false"))[1].count() == 0


MAIL = "From: a@b.example\r\nSubject: plan\r\n\r\n# One\n\n" + "First point is made here. Second follows it! " * 30 + "\n\n- item one\n- item two\n\n## Two\n" + "日本語の文章です。" * 90 + "\n--=_part\n<p>" + "x" * 700 + "</p>\n"


@pytest.mark.parametrize(("limit", "overlap"), [(200, 0), (200, 40), (512, 128), (64, 16), (4000, 300)])
@pytest.mark.parametrize("text", [MAIL, "a" * 3000, "é" * 2000, "😀" * 700, "word " * 900, "\n" * 2500, "tiny\n" + "b" * 1000])
def test_pieces(text, limit, overlap):
    data = text.encode()
    got = splitting.pieces(data, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(data)
    assert all(0 < b - a <= limit for a, b in got) or len(got) == 1
    for (a0, b0), (a1, b1) in zip(got, got[1:]):
        assert a0 < a1 and b0 < b1
        assert overlap <= b0 - a1 <= overlap + splitting.TAIL if overlap else b0 == a1
    for a, b in got:
        data[a:b].decode()  # no character is cut
    if len(data) <= limit:
        assert got == [(0, len(data))]


def test_cuts_lie_at_natural_boundaries():
    text = "".join(f"# Part {i}\n\nSome words of part {i}.\n\n" for i in range(40)).encode()
    for a, b in splitting.pieces(text, 120, 0)[1:]:
        assert text[a : a + 2] == b"# "
    prose = b" ".join(b"This is sentence number %d." % i for i in range(60))
    assert all(prose[b - 2 : b] == b". " for _, b in splitting.pieces(prose, 100, 0)[:-1])


def test_leftovers_join_their_siblings():
    text = b"A sentence of it here. " * 12 + b"\n\n" + b"\n\n".join(b"short one %d" % i for i in range(6))
    assert len(splitting.pieces(text, 220, 0)) == 2
    tiny = b"# T\n\n" + b"words and more words " * 40 + b"\n\n# U\n\n" + b"more of these words " * 40
    assert all(b - a >= 30 for a, b in splitting.pieces(tiny, 300, 0)[:-1])


def test_nested_sections_and_lists():
    section = lambda a: "# A%d\n\n" % a + "".join("## B%d\n\nwords of it %d\n\n" % (b, b) for b in range(4))
    text = "".join(section(a) for a in range(6)).encode()
    assert all(text[a : a + 3] == b"# A" for a, _ in splitting.pieces(text, 130, 0))
    items = "".join(f"- item {i}\n" + "".join(f"    - part {j} of it\n" for j in range(5)) for i in range(8)).encode()
    assert all(items[a : a + 6] == b"- item" for a, _ in splitting.pieces(items, 260, 0))
    long_heading = (b"x" * 200 + b"\n====\n" + b"word " * 30 + b"\n\n") * 4
    assert all(long_heading[a : a + 200] == b"x" * 200 for a, _ in splitting.pieces(long_heading, 400, 0))


def test_split_table(spark):
    rows = [(1, MAIL, "a"), (2, "short", "b"), (3, None, None), (4, "", None), (None, MAIL, None), (5, "n" * 300_000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    limits = [("s", 500, 50), ("l", 4096, 100), ("none", None, 1)]
    cut = splitting.split(docs, limits)
    got = cut.collect()
    assert {(r.profile, r.doc_id) for r in got} == {("s", 1), ("s", 5), ("l", 5)} | ({("l", 1)} if len(MAIL.encode()) > 4096 else set())
    whole = {}
    for r in sorted(splitting.with_text(cut, docs).filter("profile = 's'").collect(), key=lambda r: r.piece):
        data = whole.setdefault(r.doc_id, b"")
        assert len(r.text.encode()) == r.end - r.start <= 500
        whole[r.doc_id] = data[: r.start] + r.text.encode()
    assert whole == {1: MAIL.encode(), 5: b"n" * 300_000}
    # a limit with no room beyond the overlap gets the overlap that fits
    assert all(0 < b - a <= 20 for a, b in splitting.pieces(b"x" * 100, 20, 19)) and splitting.pieces("é".encode() * 3, 1, 1)[-1][1] == 6
    limit_table = spark.createDataFrame([("s", 500, 50), ("l", 4096, 100)], "profile string, piece_limit long, overlap_size long")
    for r in splitting.audit(cut, docs, limit_table).collect():
        assert (r.over_limit, r.gaps, r.wrong_overlap, r.small) == (0, 0, 0, 0)
    assert splitting.audit(cut.withColumn("end", F.col("end") - 60), docs, limit_table).agg(F.sum("wrong_overlap")).collect()[0][0] > 0
    assert splitting.audit(cut.filter("piece <> 1"), docs, limit_table).agg(F.sum("gaps")).collect()[0][0] > 0
    assert splitting.split(docs, []).count() == 0 and splitting.split(docs.filter(F.lit(False)), limits).count() == 0

import json
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import hv
from palimpsest.functions import scoring as S
from palimpsest.operators import beliefs, consolidate, embedding, episodes, evaluate, extract, goals, search, selfmodel, temporal
from palimpsest.sources import artefacts, jsonl
from palimpsest.streaming import sensory

DAY = datetime(2024, 1, 1)


def test_belief_log_stops_at_withdrawal(spark):
    rng = random.Random(1)
    rows = [(b, DAY + timedelta(hours=rng.randint(0, 90)), i, rng.random() < 0.55 if i % 17 else None, 0.6) for i, b in enumerate(rng.choices([1, 1, 1, 2, 3, None], k=300))]
    df = spark.createDataFrame(rows, "belief_id long, at timestamp_ntz, episode_id long, supports boolean, confidence0 double")
    got = beliefs.revise(df).orderBy("belief_id", "seq").collect()
    want = []
    for b in (1, 2, 3):
        c, seq = 0.6, 0
        for r in sorted((r for r in rows if r[0] == b), key=lambda r: (r[1], r[2])):
            if c < 0.5:
                break
            c = beliefs.step(c, bool(r[3]))
            want.append((b, seq, r[2], pytest.approx(c), c < 0.5))
            seq += 1
    assert [(r.belief_id, r.seq, r.episode_id, r.confidence, r.withdrawn) for r in got] == want
    assert beliefs.revise(df.filter("false")).count() == 0


def test_evidence_correction(spark):
    rows = [(1, 0.8, [1, 2, 3, 4], [9], None), (2, 0.8, [1, 2], [], None), (3, 0.8, [1], [], DAY), (4, 0.6, [7], [1], None), (5, 0.5, [], None, None)]
    df = spark.createDataFrame(rows, "id long, confidence double, evidence array<long>, contradictions array<long>, t_valid_end timestamp_ntz")
    got = {r.id: (round(r.confidence, 6), r.evidence, r.corrected, r.withdrawn) for r in beliefs.correct_evidence(df, spark.createDataFrame([(1,), (2,), (1,)], "id long")).collect()}
    assert got == {1: (0.4, [3, 4], True, True), 2: (0.0, [], True, True), 3: (0.8, [1], False, False), 4: (0.6, [7], True, False), 5: (0.5, [], False, False)}


def test_goal_walk(spark):
    rng = random.Random(3)
    rows = [(rng.randint(1, 4), DAY + timedelta(seconds=i), i, rng.choice([*goals.MOVES, "unknown", None])) for i in range(200)]
    got = goals.transitions(spark.createDataFrame(rows, "goal_id long, at timestamp_ntz, seq long, request string")).collect()
    state = {}
    for r in sorted(got, key=lambda r: r.seq):
        assert r.from_state == state.get(r.goal_id, goals.ACTIVE)
        assert r.to_state == (goals.move(r.from_state, r.request) or r.from_state)
        assert not (r.from_state in (goals.COMPLETED, goals.ABANDONED) and r.accepted)
        state[r.goal_id] = r.to_state
    assert len(got) == 200


def test_contradictions_and_supersede(spark):
    fact = lambda s, p, o: {"subject": s, "predicate": p, "object": o, "confidence": 1.0}
    rows = [
        (1, DAY, None, [fact("a", "p", "x")], None), (2, DAY + timedelta(days=1), None, [fact("a", "p", "x")], None), (3, DAY + timedelta(days=2), None, [fact("a", "p", "y")], None),
        (4, DAY + timedelta(days=3), None, [fact("b", "p", "x"), fact("b", "p", "y")], None), (5, DAY, None, [fact("a", None, "q")], None), (6, DAY, None, None, None), (7, DAY + timedelta(days=4), None, [fact("a", "p", None)], None),
    ]
    df = spark.createDataFrame(rows, "id long, valid_start timestamp_ntz, valid_end timestamp_ntz, triples array<struct<subject:string,predicate:string,object:string,confidence:double>>, superseded_by long")
    links = temporal.contradictions(temporal.facts_of(df))
    assert {tuple(r) for r in links.select("older", "newer").collect()} == {(2, 3), (3, 7)}  # equal neighbours and an episode itself are none
    after = {r.id: r for r in temporal.supersede(df, links).collect()}
    assert after[2].superseded_by == 3 and after[2].valid_end == DAY + timedelta(days=2) - timedelta(milliseconds=1) and after[1].superseded_by is None


def test_leader_clusters(spark):
    rng = random.Random(7)
    w = 4
    rows = []
    for _ in range(8):
        base = [rng.getrandbits(60) for _ in range(w)]
        for _ in range(rng.randint(1, 6)):
            v = list(base)
            for _ in range(rng.choice([0, 0, 3, 7, 12, 20])):
                v[rng.randrange(w)] ^= 1 << rng.randrange(60)
            rows.append((len(rows), v))
    rng.shuffle(rows)
    leaders, want = [], {}
    for i, v in sorted(rows):
        near = [j for j, u in leaders if 1 - sum((a ^ b).bit_count() for a, b in zip(u, v)) / 240 >= 0.95]
        if not near:
            leaders.append((i, v))
        want[i] = near[0] if near else i
    got = {r.id: r.leader for r in consolidate.clusters(spark.createDataFrame(rows, "id long, hv array<bigint>"), w).collect()}
    assert got == want


def test_fuzzy_lookup_against_brute_force(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abC") for _ in range(rng.randint(1, 7)))
    names, concepts = sorted({word() for _ in range(60)}), sorted({word() for _ in range(60)})
    df, c = spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(i, n) for i, n in enumerate(concepts)] + [(99, None)], "id long, canonical_name string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
        return out

    for k in (1, 2, 3):
        want = {(n, i, d) for n in names for i, m in enumerate(concepts) if 0 < (d := distance(n.lower(), m.lower())) <= k}
        assert {tuple(r) for r in episodes.fuzzy_candidates(df, c, k).collect()} == want


def test_extraction(spark):
    config = extract.ExtractorConfig(synonyms={"Reports To": "reports_to"})
    texts = [
        (1, "Nadja told me about Lindenhof. Bob lives in Rome! Then Dan met Eve? Ann said a lot of things about very many other people than Joe."),
        (2, "Al reports to Bo"), (3, None), (4, ""), (5, "no names here"), (6, "Zoë quickly, visited! Åre"), (7, "Zoë quickly (visited) Åre"),
    ]
    df = spark.createDataFrame(texts, "id long, text string")
    got = {r.id: [tuple(t) for t in r.facts] for r in df.select("id", extract.extractor(config)("text").alias("facts")).collect()}
    assert ("Nadja", "recommends", "Lindenhof", 0.5) in got[1] and ("Bob", "located_in", "Rome", 0.5) in got[1] and not any(f[0] == "Ann" or f[2] == "Bob" for f in got[1])
    assert got[2] == [("Al", "reports_to", "Bo", 0.5)] and got[3] == got[4] == got[5] == got[6] == [] and got[7] == [("Zoë", "visited", "Åre", 0.5)]
    split = spark.createDataFrame([("no end",), ("",), ("a. b! c?",), (None,)], "t string").select(extract.sentences("t").alias("s")).collect()
    assert [r.s for r in split] == [["no end"], [], ["a.", "b!", "c?"], None]

    def scored(text):
        return [(0, 2, "Al", "person", 0.9), (14, 16, "Bo", "animal", 0.9)] if text else []

    assert df.filter("id = 2").select(extract.extractor(config, scored)("text").alias("f")).collect()[0].f == []
    wide = extract.ExtractorConfig(["person", "animal"], 0.5, config.synonyms)
    assert len(df.filter("id = 2").select(extract.extractor(wide, scored)("text").alias("f")).collect()[0].f) == 1
    names = spark.createDataFrame([("ANN",), ("Anne",), ("zed",), ("Zed",), (None,)], "name string")
    concepts = spark.createDataFrame([(5, "Ann")], "id long, canonical_name string")
    got = {r.name: (r.concept_id, r.how) for r in extract.resolve_aliases(names, concepts, 1).collect()}
    assert got == {"ANN": (5, "lower"), "Anne": (5, "fuzzy"), "zed": (6, "new"), "Zed": (6, "new")}


def test_time_anchors(spark):
    said = ["yesterday", "last weekend", "This Weekend", "two months ago", "in 3 days", "2 hours from now", "2024-02-30", "2024-02-29", "3/5/2024", "nonsense", "", None, "5 days"]
    df = spark.createDataFrame([(s, datetime(2024, 5, 15, 10, 30)) for s in said], "t string, now timestamp").select("t", S.time_anchor(F.col("t"), F.col("now")).alias("a"))
    got = {r.t: r.a and (r.a.start, r.a.end) for r in df.collect()}
    assert got["yesterday"] == (datetime(2024, 5, 14), datetime(2024, 5, 14, 23, 59, 59)) and got["last weekend"] == (datetime(2024, 5, 11), datetime(2024, 5, 12, 23, 59, 59))
    assert got["This Weekend"] == (datetime(2024, 5, 18), datetime(2024, 5, 19, 23, 59, 59)) and got["two months ago"] == (datetime(2024, 3, 15, 10, 30), None)
    assert got["in 3 days"][0] == datetime(2024, 5, 18, 10, 30) and got["2 hours from now"][0] == datetime(2024, 5, 15, 12, 30) and got["2024-02-29"][0] == datetime(2024, 2, 29) and got["3/5/2024"][0] == datetime(2024, 3, 5)
    assert all(got[x] is None for x in ("2024-02-30", "nonsense", "", None, "5 days"))


def test_embeddings_and_search(spark):
    docs = spark.createDataFrame([(1, "alpha beta alpha"), (2, None), (3, "?!"), (4, "be")], "id long, text string")
    dense = {r.id: np.array(r.embedding) for r in embedding.dense(embedding.hashed(docs, 16), 16).collect()}
    assert set(dense) == {1, 4} and all(abs(np.linalg.norm(v) - 1) < 1e-6 for v in dense.values())
    rng = np.random.default_rng(1)
    v = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(60)] + [(60, [0.0] * 8), (61, None)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>")
    got = {}
    for r in search.blocked_top_k(df.filter("vec_id % 20 = 0"), df, 5, block=2).collect():
        got.setdefault(r.query_id, []).append((-round(r.score, 5), r.vec_id))
    m = np.array([x[1] for x in v[:61]], dtype=np.float32).astype(float)
    n = np.linalg.norm(m, axis=1)
    for q in (0, 20, 40, 60):
        s = np.divide(m @ m[q], n * n[q], out=np.zeros(61), where=n * n[q] > 0)
        assert sorted(got[q]) == sorted((-round(s[i], 5) + 0.0, i) for i in sorted((i for i in range(61) if i != q), key=lambda i: (-round(s[i], 9), i))[:5])
    x = embedding.projected(df, 1, 8, "vec_id")
    signs = embedding.signs(60, 8)
    for r in x.collect():
        e = np.trunc(1024 * np.array(v[r.vec_id][1], dtype=np.float32).astype(float)).astype(int)
        assert r.hv == [sum(1 << b for b in range(60) if signs[b] @ e > 0)]
    words = spark.createDataFrame([("Café-bar déjà!",)], "t string").select(embedding.basic_tokens(F.col("t")).alias("w"))
    assert words.collect()[0].w == ["cafe", "bar", "deja"]
    vocabulary = {"[UNK]": 0, "ca": 1, "##fe": 2, "bar": 3}
    assert words.select(embedding.word_pieces(vocabulary)("w").alias("p")).collect()[0].p == [1, 2, 3, 0]


def test_folds_and_events(spark):
    df = spark.createDataFrame([(1, [1, 4]), (1, [3, 4]), (2, [7, 0])], "k int, hv array<bigint>")
    assert {r.k: r.hv for r in selfmodel.or_fold(df, "hv", 2, ["k"]).collect()} == {1: [3, 4], 2: [7, 0]}
    assert {r.k: r.hv for r in selfmodel.xor_fold(df, "hv", 2, ["k"]).collect()} == {1: [2, 0], 2: [7, 0]}
    assert selfmodel.current(spark.createDataFrame([], "seq long, hv array<bigint>"), 2).collect()[0].hv == [0, 0]
    with pytest.raises(ValueError):
        selfmodel.events({"nothing": df})


def test_baselines_and_measures(spark):
    eps = spark.createDataFrame([(1, "red fox runs", DAY), (2, "blue fox", DAY), (3, None, DAY), (2, "blue fox", DAY)], "id long, text string, t_tx_start timestamp_ntz")
    cues = spark.createDataFrame([(1, "fox red"), (2, None), (3, "ru zzz")], "query_id long, cue string")
    assert [(r.query_id, r.id) for r in evaluate.bm25(cues, eps).orderBy("query_id", F.desc("score")).collect()] == [(1, 1), (1, 2)]
    assert {tuple(r) for r in evaluate.naive_scan(cues, eps).collect()} == {(1, 1, 2.0), (1, 2, 1.0), (3, 1, 1.0)}
    gold = spark.createDataFrame([(1, "a", "p", "x"), (1, "a", "p", None), (2, "b", "p", "y")], "id long, subject string, predicate string, object string")
    r = evaluate.extraction_scores(gold, gold.filter("id = 1").unionByName(gold.filter("id = 2").withColumn("object", F.lit("z")))).collect()[0]
    assert (r.tp, r.fp, r.fn, round(r.f1, 6)) == (2, 1, 1, 0.666667)
    ranked = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 1, True), (3, 1, False), (4, None, False)], "query_id long, rank int, relevant boolean")
    m = evaluate.ranking_scores(ranked).collect()[0]
    assert (m.queries, m.hit_1, m.hit_5, m.mrr, m.p50_rank, m.p95_rank) == (4, 0.25, 0.5, 0.375, 2, 2)
    docs = evaluate.corpus(spark, 300)
    rows = {r.id: r for r in docs.collect()}
    assert len(rows) == 303 and rows[50].superseded_by == 301 and rows[301].person == rows[50].person and rows[301].valid_start > rows[50].valid_start
    assert rows == {r.id: r for r in evaluate.corpus(spark, 300).repartition(3).collect()} and len({r.person for r in rows.values()}) > 20
    asked, truth = evaluate.bench_queries(docs, 4)
    kinds = {r.query_id: r.cue_class for r in asked.collect()}
    assert len(kinds) == 20 and set(kinds.values()) == {"exact", "single-entity", "noisy", "temporal", "paraphrase"}
    assert {r.query_id for r in truth.collect()} == set(kinds)
    assert all(r.as_of is not None and r.cue for r in asked.filter("cue_class = 'temporal'").collect())
    assert spark.range(1).select(evaluate.slipped(F.lit("Oltov"), F.lit(0))).collect()[0][0] == "Otlov"


def test_surprise_blocks_agree_with_one_pass(spark):
    rng = random.Random(4)
    rows = [(i * 3, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4))) if i % 9 else "?!") for i in range(150)]
    df = spark.createDataFrame(rows, "id long, text string")
    small = {r.id: r.surprise for r in sensory.surprise(df, 1, look_back=5, block=16).collect()}
    v = [np.zeros(60, int) if t == "?!" else (2 * sum(hv.name_bits(w, 1).astype(int) for w in t.split()) > len(t.split())).astype(int) for _, t in rows]
    for i, (id_, t) in enumerate(rows):
        near = v[max(0, i - 5) : i]
        assert small[id_] == pytest.approx(0.0 if t == "?!" else min((np.abs(x - v[i]).sum() / 60 for x in near), default=1.0))
    assert len(small) == 150


def test_stream_promotes_new_frames(spark, tmp_path):
    schema = "stream string, text string, at timestamp"
    rows = [("s", "one new scene", DAY), ("s", "one new scene", DAY + timedelta(seconds=1)), ("s", None, DAY + timedelta(seconds=2)), ("t", "one new scene", DAY)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    frames = sensory.stateful(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 20)
    q = frames.writeStream.format("memory").queryName("frames").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.stream, r.id): (r.surprise, r.promoted) for r in spark.table("frames").collect()}
    assert got == {("s", 1): (1.0, True), ("s", 2): (0.0, False), ("s", 3): (0.0, False), ("t", 1): (1.0, True)}


def test_sources(spark, tmp_path):
    row = (1, "text", [], DAY, None, DAY, ("cli", None, None, {"a": "b"}), 0.5, None)
    from palimpsest.schemas import EPISODES

    df = spark.createDataFrame([row], EPISODES)
    jsonl.export(df, str(tmp_path / "out"))
    back = jsonl.read(spark, str(tmp_path / "out")).collect()[0]
    assert back.id == 1 and back.provenance.metadata == {"a": "b"} and back.valid_start == DAY and back.hv is None
    lines = spark.createDataFrame([("",), ("  ",)], "value string")
    assert jsonl.parse(lines).count() == 0
    with pytest.raises(Exception):
        jsonl.parse(spark.createDataFrame([("{no",)], "value string")).collect()
    m = np.arange(6, dtype="<f4").reshape(3, 2)
    header = json.dumps({"embeddings": {"dtype": "F32", "shape": [3, 2], "data_offsets": [0, 24]}}).encode()
    data = len(header).to_bytes(8, "little") + header + m.tobytes()
    (tmp_path / "m.safetensors").write_bytes(data)
    assert (artefacts.parse_safetensors(data) == m).all()
    table = artefacts.read_embedding_table(spark, str(tmp_path / "m.safetensors"))
    assert [r.vector for r in table.orderBy("piece").collect()] == m.tolist()
    for bad in (b"", data[:-1], (2).to_bytes(8, "little") + b"{}"):
        with pytest.raises(artefacts.ArtefactError):
            artefacts.parse_safetensors(bad)
    import hashlib

    artefacts.verify_sha256(spark, str(tmp_path / "m.safetensors"), hashlib.sha256(data).hexdigest())
    with pytest.raises(artefacts.ArtefactError):
        artefacts.verify_sha256(spark, str(tmp_path / "m.safetensors"), "00")
    (tmp_path / "vocab.txt").write_text("[PAD]\ncat\n##s\n")
    assert artefacts.read_vocabulary(spark, str(tmp_path / "vocab.txt")) == {"[PAD]": 0, "cat": 1, "##s": 2}
    e = embedding.static_embedding(spark.createDataFrame([(1, [1, 2, 9])], "id long, pieces array<int>"), table, 2, [0]).collect()[0].embedding
    assert np.linalg.norm(e) == pytest.approx(1.0)


def test_entry_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p1_found", "p3_found"} <= set(entry.queries())


def test_lexical_ranking_in_tasks_agrees_with_the_join(spark):
    """Cue blocks and row chunks of any size, validity and windows, k above 512: the same rows as summing up a join."""
    from palimpsest.operators import recall

    rng = random.Random(12)
    words = [f"w{i}" for i in range(30)]
    eps = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) or None, DAY + timedelta(days=rng.randint(0, 50)) if i % 11 else None, DAY + timedelta(days=60) if i % 3 else None, DAY) for i in range(700)]
    episodes_ = spark.createDataFrame(eps, "id long, text string, valid_start timestamp_ntz, valid_end timestamp_ntz, t_tx_start timestamp_ntz")
    stones = spark.createDataFrame([(0, i) for i in range(0, 700, 13)], "kind int, id long")
    asked = [(q, " ".join(rng.choice([*words, "zz"]) for _ in range(rng.randint(0, 5))), rng.choice([None, DAY + timedelta(days=30)]), rng.choice([None, 3, 600])) for q in range(25)] + [(90, None, None, 2), (91, " ".join(words), None, 600)]
    cues = recall.with_defaults(spark.createDataFrame(asked, "query_id long, cue string, as_of timestamp_ntz, k int"))
    cues = cues.withColumn("window_from", F.when(F.col("query_id") % 4 == 0, F.lit(DAY).cast("timestamp_ntz"))).withColumn("window_to", F.when(F.col("query_id") % 4 == 0, F.lit(DAY + timedelta(days=20)).cast("timestamp_ntz")))
    posts, directory = episodes.postings(episodes_).persist(), episodes.scan_directory(episodes_, stones).persist()
    weights = recall.cue_weights(cues, posts, directory).persist()
    want = recall.top_k(recall.allowed(recall.lexical_scores(weights, posts), cues, directory), cues)
    key = lambda df: {(r.query_id, r.id, round(r.score, 6)) for r in df.select("query_id", "id", "score").collect()}
    expected = key(want)
    assert sum(1 for x in expected if x[0] == 91) > 512
    assert key(recall.lexical_best(cues, weights, posts, directory, 7, 50)) == expected == key(recall.lexical_best(cues, weights, posts, directory))
    none = recall.with_defaults(spark.createDataFrame([], "query_id long, cue string"))
    assert recall.lexical_best(none, recall.cue_weights(none, posts, directory), posts, directory).count() == 0

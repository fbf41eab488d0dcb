import io
import json
import shutil
from datetime import datetime, timedelta

import pytest

from palimpsest.api import InvalidTransition, MemoryEngine, Query, RestoreExpired, UnknownId
from palimpsest.operators import embedding as V
from palimpsest.operators import extract as X
from palimpsest.sources.store import StoreError
from palimpsest.tools import Tools

MON = datetime(2026, 5, 11)
NOTES = [
    (0, "Petra watered the seedlings at dawn"), (1, "Petra repotted the seedlings indoors"), (2, "Goran ordered the greenhouse glass today"),
    (3, "Petra answered with measurements nearby"), (4, "Goran installed the vents outside"),
]
WORDS = 40


def finder():
    """An entity finder for tests: the first word and the last one. Nested, so that workers get it by value."""

    def ends(text):
        w = text.split()
        return [(0, len(w[0]), w[0]), (len(text) - len(w[-1]), len(text), w[-1])]

    return ends


def observed(spark, e, notes, **options):
    rows = [(i, text, MON + timedelta(days=d)) for i, (d, text) in enumerate(notes)]
    return e.observe_table(spark.createDataFrame(rows, "pos long, text string, observed_at timestamp"), now=MON, **options)


@pytest.fixture(scope="module")
def template(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("template") / "memory"
    observed(spark, MemoryEngine(spark, str(root), X.extractor(finder=finder()), WORDS), NOTES, source="test", session="s1")
    return root


@pytest.fixture
def engine(spark, template, tmp_path):
    shutil.copytree(template, tmp_path / "memory")
    return MemoryEngine(spark, str(tmp_path / "memory"), X.extractor(finder=finder()), WORDS)


def test_recall_and_windows(engine):
    assert [r.id for r in engine.list_episodes()] == [1, 2, 3, 4, 5]
    cue = "petra goran seedlings glass measurements vents"
    r = engine.recall(Query(cue))
    assert r.tier_used == "Lexical" and {m.id for m in r.matches} == {1, 2, 3, 4, 5} and all(0.55 <= m.confidence <= 0.95 for m in r.matches)
    window = engine.recall(Query(cue, time_window=(MON + timedelta(days=3), MON + timedelta(days=5))))
    assert {m.id for m in window.matches} == {4, 5}
    past = engine.recall(Query("greenhouse glass", as_of=MON + timedelta(days=2), tier_floor="Lexical"))
    assert [m.id for m in past.matches] == [3]
    assert engine.recall(Query("greenhouse", time_window=(datetime(2027, 1, 1), datetime(2027, 2, 1)), tier_floor="Lexical")).matches == []
    far = engine.recall(Query("brumelostic tavverin"))
    assert far.matches and far.tier_used in ("Gist", "NearestNeighbor", "Semantic")
    assert engine.recall(Query("brumelostic", tier_floor="Exact")).matches == []
    assert engine.recall(Query("?!", tier_floor="Lexical")).matches == []
    assert [m.rank for m in engine.recall(Query(cue, k=2, tier_floor="Lexical")).matches] == [1, 2]
    assert engine.recall(Query("seedlings", min_confidence=0.99, tier_floor="Lexical")).matches == []


def test_supersede_stats_export(engine, spark, tmp_path):
    engine.supersede(1, 2)
    old = engine.get_episode(1)
    assert old.superseded_by == 2 and old.valid_end == MON + timedelta(days=1) - timedelta(milliseconds=1)
    with pytest.raises(UnknownId):
        engine.supersede(1, 99)
    assert engine.stats()["episodes"] == 5 and engine.learning_event_count() == 5
    engine.export_jsonl(str(tmp_path / "out"))
    other = MemoryEngine(spark, str(tmp_path / "other"), words=WORDS)
    assert other.import_jsonl(str(tmp_path / "out")) == 5
    assert other.get_episode(3).text == NOTES[2][1] and other.observe("one more") == 6
    timeline = engine.timeline(MON, MON + timedelta(days=9))
    assert [r.id for r in timeline] == [1, 2, 3, 4, 5]


def test_facts_concepts_and_subjects(spark, tmp_path):
    e = MemoryEngine(spark, str(tmp_path / "m"), X.extractor(finder=finder()), WORDS)
    observed(spark, e, list(enumerate(["Nadja recommended Lindenhof", "Nadja likes Marlow", "nadja visited Kestrel", "Tibor met Marlow"])))
    assert {r.canonical_name for r in e.table("concepts").collect()} == {"Nadja", "Lindenhof", "Marlow", "Kestrel", "Tibor"}
    facts = [t for r in e.list_episodes() for t in r.triples]
    assert [(t.subject, t.predicate, t.object) for t in facts][2] == ("Nadja", "visited", "Kestrel")
    r = e.recall(Query("what did Nadja say?"))
    assert r.tier_used == "Lexical" and {m.id for m in r.matches} == {1, 2, 3}
    by = e.recall(Query("Marlow", subject="NADJA"))
    assert [m.id for m in by.matches][0] == 2 and {m.id for m in by.matches} == {1, 2, 3}
    assert e.recall(Query("Marlow", subject="Nobody")).matches == []
    assert [r.id for r in e.timeline(MON, MON + timedelta(days=9), "nadja", 2)] == [1, 2]
    assert e.timeline(MON, MON + timedelta(days=9), "nobody") == []


def test_consolidation_and_contradictions(spark, tmp_path):
    e = MemoryEngine(spark, str(tmp_path / "m"), X.extractor(finder=finder()), WORDS)
    observed(spark, e, [(0, "Nadja likes Marlow")] * 3 + [(4, "Nadja likes Lindenhof")])
    assert e.consolidate(MON) == {"scanned": 4, "atoms_created": 1, "contradictions": 1}
    assert e.consolidate(MON)["atoms_created"] == 0
    atom = e.recall(Query("Nadja")).semantic_atoms[0]
    assert atom.claim == "Nadja likes Marlow" and atom.evidence_count == 3
    assert sum(x.bit_count() for x in e.self_vector()) > 0 and len(e.self_vector_history()) == 1
    kinds = [r.kind for r in e.all_learning_events()]
    assert kinds.count("consolidation_run") == 2 and kinds.count("self_vector_updated") == 1


def test_vectors_are_stored_and_embedders_plug_in(engine, spark, tmp_path):
    stored = {r.id: r for r in engine.table("vectors").collect()}
    assert set(stored) == {1, 2, 3, 4, 5} and all(len(r.sig) == len(r.gist) == len(r.emb) == WORDS for r in stored.values())
    vocabulary = {"[UNK]": 0, "petra": 1, "goran": 2, "seedlings": 3, "glass": 4}
    table = spark.createDataFrame([(i, [float(i == j) for j in range(5)]) for i in range(5)], "piece int, vector array<double>")
    engine.install_embedder(V.static_embedder(vocabulary, table, 5, [0], WORDS))
    changed = {r.id: r for r in engine.table("vectors").collect()}
    assert all(changed[i].gist == stored[i].gist and changed[i].emb != stored[i].emb for i in stored)
    assert engine.observe("Petra rested", now=MON) == 6 and engine.signatures().count() == 6


def test_versions_and_compaction(engine):
    g = engine.set_goal("tidy the shed", source="chat", session="s9", now=MON)
    for _ in range(5):
        engine.pause_goal(g)
        engine.resume_goal(g)
    assert engine.get_goal(g).rev == 10 and engine.get_goal(g).provenance.session_id == "s9" and len(engine.all_goals()) == 1
    b = engine.assert_belief("goran is thorough", 0.7, source="chat", now=MON)
    assert engine.get_belief(b).provenance.source == "chat"
    assert "goals" in engine.flush() and len(engine.store.parts("goals")) == 1 and engine.get_goal(g).rev == 10
    rows, versions = engine.store.read("goals"), engine.store._versions
    with pytest.raises(StoreError):  # two writers at once: the pointer of the second is there already
        engine.store._versions = lambda name: versions(name)[:-1]
        engine.store.append("goals", rows)


def test_concepts_by_name(engine):
    a = engine.create_concept("New Place", "place")
    assert engine.create_concept("New Place") == a and engine.concept_name(a) == "New Place"
    with pytest.raises(UnknownId):
        engine.concept_name(999)


def test_goals(engine):
    g = engine.set_goal("ship the seedlings", now=MON)
    child = engine.set_goal("review the seedlings", parent_id=g)
    assert [x.id for x in engine.active_goals()] == [g, child]
    engine.pause_goal(g, "later")
    with pytest.raises(InvalidTransition):
        engine.pause_goal(g)
    engine.resume_goal(g)
    before = engine.get_goal(g).hv
    engine.revise_goal(g, description="ship the prototype")
    assert engine.goal_signature(g) != before and len(engine.goal_signature(child)) == WORDS
    engine.complete_goal(g, [1, 2])
    assert engine.get_goal(g).completed_evidence == [1, 2]
    for call in (engine.resume_goal, engine.abandon_goal, engine.complete_goal):
        with pytest.raises(InvalidTransition):
            call(g)
    with pytest.raises(UnknownId):
        engine.pause_goal(77)
    plain = engine.recall(Query("seedlings", tier_floor="Lexical"))
    biased = engine.recall(Query("seedlings", goal_bias_weight=0.5, tier_floor="Lexical"))
    assert biased.matches[0].confidence > plain.matches[0].confidence


def test_beliefs(engine):
    b = engine.assert_belief("goran builds", 0.5, "goran", "builds", "vents", [5])
    for _ in range(3):
        old, new, gone = engine.revise_belief(b, 3, True)
    assert new == pytest.approx(0.7336, abs=1e-4) and not gone
    assert engine.assert_belief("other claim", 0.1, "goran", "builds", "x", [4]) == b
    assert engine.get_belief(b).claim == "goran builds" and 4 in engine.get_belief(b).evidence
    assert [r.seq for r in engine.belief_history(b)] == [0, 1, 2, 3]
    assert [r.id for r in engine.what_do_i_believe("goran")] == [b]
    weak = engine.assert_belief("weak", 0.5)
    assert engine.revise_belief(weak, 1, False)[2]
    with pytest.raises(InvalidTransition):
        engine.revise_belief(weak, 1, True)
    engine.withdraw_belief(b)
    engine.withdraw_belief(b)
    assert engine.what_do_i_believe("goran") == [] and len(engine.all_beliefs()) == 2


def test_unlearn_and_restore(engine):
    b = engine.assert_belief("petra works", 0.6, "petra", "works", "hard", [1, 2, 3])
    report = engine.unlearn("episode", 1, "asked", MON)
    assert (report["episodes"], report["beliefs_revised"]) == (1, 1)
    with pytest.raises(UnknownId):
        engine.get_episode(1)
    kept = engine.get_belief(b)
    assert kept.evidence == [2, 3] and kept.confidence == pytest.approx(0.4) and kept.t_valid_end is not None
    assert 1 not in {m.id for m in engine.recall(Query("seedlings")).matches}
    with pytest.raises(RestoreExpired):
        engine.restore_within_window(report["audit_event_id"], MON + timedelta(days=31))
    assert engine.restore_within_window(report["audit_event_id"], MON + timedelta(days=30)) == 1
    assert engine.get_episode(1).id == 1 and engine.restore_within_window(12345) == 0
    session = engine.unlearn("session", "s1", now=MON)
    assert session["episodes"] == 5 and engine.list_episodes() == [] and len(engine.unlearn_history()) == 5
    assert engine.recall(Query("petra")).matches == []


def test_sensory(spark, tmp_path):
    e = MemoryEngine(spark, str(tmp_path / "m"), words=WORDS)
    assert e.observe_sensory("a completely new scene", MON) == (1, 1.0, True)
    assert e.observe_sensory("a completely new scene", MON)[1:] == (0.0, False)
    assert e.observe_sensory("", MON)[1:] == (0.0, False)
    _, s, promoted = e.observe_sensory("quarterly numbers rose again", MON)
    assert promoted and s >= 0.4
    assert [f.id for f in e.sensory_frames(2)] == [4, 3] and len(e.list_episodes()) == 2


def test_tools(engine):
    tools = Tools(engine)
    assert len(tools.list()) == 13
    requests = [
        {"jsonrpc": "2.0", "id": 1, "method": "initialize"}, {"jsonrpc": "2.0", "method": "note"}, {"jsonrpc": "2.0", "id": 2, "method": "nope"},
        {"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "memory_recall", "arguments": {"cue": "seedlings"}}},
        {"jsonrpc": "2.0", "id": 4, "method": "tools/call", "params": {"name": "memory_get_episode", "arguments": {"id": "77"}}},
        {"jsonrpc": "2.0", "id": 5, "method": "tools/call", "params": {"name": "memory_assert_belief", "arguments": {"claim": "c", "subject": "s"}}},
        {"jsonrpc": "2.0", "id": 6, "method": "tools/call", "params": {"name": "none"}},
    ]
    out = io.StringIO()
    tools.serve(io.StringIO("\n".join([*map(json.dumps, requests), "", "{"])), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [r.get("id") for r in got] == [1, 2, 3, 4, 5, 6, None]
    assert got[1]["error"]["code"] == -32601 and got[-1]["error"]["code"] == -32700 and got[4]["error"]["code"] == -32602 and got[5]["error"]["code"] == -32602
    matches = json.loads(got[2]["result"]["content"][0]["text"])["matches"]
    assert {m["id"] for m in matches} == {1, 2} and got[3]["result"]["isError"]

"""The engine as an object: a folder of versioned tables and the operations on them.

Every operation takes the time as an argument, so results can be reproduced; without one
the clock is read once. Single calls are one-row cases of the batch operators.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from palimpsest import schemas as T
from palimpsest.functions import hv
from palimpsest.functions import scoring as S
from palimpsest.functions.text import terms, tokens
from palimpsest.operators import beliefs as B
from palimpsest.operators import consolidate as C
from palimpsest.operators import embedding as V
from palimpsest.operators import episodes as E
from palimpsest.operators import extract as X
from palimpsest.operators import goals as G
from palimpsest.operators import recall as R
from palimpsest.operators import order, selfmodel, temporal
from palimpsest.operators import unlearn as U
from palimpsest.sources import jsonl
from palimpsest.sources.store import TableStore
from palimpsest.sources.tables import guard
from palimpsest.streaming import sensory

TABLES = {
    "episodes": T.EPISODES, "concepts": T.CONCEPTS, "semantic_atoms": T.ATOMS, "consolidation_log": T.CONSOLIDATION_LOG, "goals": T.GOALS,
    "beliefs": T.BELIEFS, "belief_revisions": T.REVISIONS, "learning_events": T.EVENTS, "self_vectors": T.SELF_VECTORS,
    "tombstones": T.TOMBSTONES, "sensory_frames": T.FRAMES, "vectors": T.VECTORS,
}


#: Tables that get a new row per change, with `rev`; the newest row of an id holds.
VERSIONED = ("goals", "beliefs")


#: A list of rows that a call returns has no more than this; whole tables are read with `table`.
MOST_ROWS = 10_000


class MemoryError_(RuntimeError):
    """Base of the engine's errors."""


class UnknownId(MemoryError_):
    """No row has this id."""


class InvalidTransition(MemoryError_):
    """The state does not allow the request."""


class RestoreExpired(MemoryError_):
    """The deletion is too old to be restored."""


@dataclass
class Query:
    """One cue with its filters. Weights are clamped to [0, 1], a half life below a second counts as one."""

    cue: str
    k: int = 10
    min_confidence: float = 0.0
    as_of: datetime | None = None
    time_window: tuple[datetime, datetime] | None = None
    subject: str | None = None
    tier_floor: str = "NearestNeighbor"
    goal_bias_weight: float = 0.0
    recency_weight: float = 0.0
    recency_anchor: datetime | None = None
    half_life_s: float = S.HALF_LIFE_S

    def __post_init__(self):
        self.goal_bias_weight = min(1.0, max(0.0, self.goal_bias_weight))
        self.recency_weight = min(1.0, max(0.0, self.recency_weight))
        self.half_life_s = max(1.0, self.half_life_s)


@dataclass
class Recall:
    """Ranked matches, the parallel lane of atoms and the shallowest tier used."""

    matches: list[Row] = field(default_factory=list)
    semantic_atoms: list[Row] = field(default_factory=list)
    tier_used: str | None = None


class MemoryEngine:
    """Operations on the tables of one folder. `words` is the width of its vectors, the same for the folder's life."""

    def __init__(self, spark: SparkSession, root: str, extractor=None, words: int = hv.FULL_WORDS, embedder=None):
        """`extractor` makes facts of texts, `embedder` vectors: a function of (df with key and text, key) giving (key, hv)."""
        guard(spark)
        self.spark, self.root, self.words = spark, root, words
        self.embed = embedder or V.hashed_embedder(words)
        self.extractor_loaded = extractor is not None
        self.extract = extractor or X.null_extractor()
        self.store = TableStore(spark, root, TABLES)

    # -- helpers

    def table(self, name: str) -> DataFrame:
        """Current rows; where a table keeps versions of a row, the newest."""
        rows = self.store.read(name)
        return E.latest(rows, ["id"], ["rev"]) if name in VERSIONED else rows

    @staticmethod
    def _now(now: datetime | None) -> datetime:
        return now or datetime.now(timezone.utc).replace(tzinfo=None)

    def _next(self, name: str, column: str = "id") -> int:
        return (self.table(name).agg(F.max(column)).collect()[0][0] or 0) + 1

    def _rows(self, name: str, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, TABLES[name])

    def _event(self, kind: str, at: datetime, **values) -> int:
        fields = ["ref_id", "text", "from_state", "to_state", "previous", "confidence", "reason", "size", "drift"]
        id_ = self._next("learning_events")
        self.store.append("learning_events", self._rows("learning_events", [(id_, kind, at, *(values.get(f) for f in fields))]))
        return id_

    def _one(self, name: str, id_: int) -> Row:
        rows = self.table(name).filter(F.col("id") == id_).limit(1).collect()
        if not rows:
            raise UnknownId(f"{name} {id_}")
        return rows[0]

    def _update(self, name: str, id_: int, **values) -> None:
        """Appends the changed row as its newest version."""
        old = self._one(name, id_).asDict()
        fields = [f.name for f in self.store.schemas[name].fields]
        changed = old | values | {"rev": (old["rev"] or 0) + 1}
        self.store.append(name, self._rows(name, [tuple(changed[f] for f in fields)]))

    @staticmethod
    def _provenance(source: str, session: str | None) -> Row:
        return Row(source=source, session_id=session, trace_id=None, metadata={})

    def _stored(self, new: DataFrame, at: datetime) -> None:
        """Vectors and learning events of new episodes, one append each."""
        self.store.append("vectors", self._vectors(new))
        events = order.numbered(new.select(F.col("id").alias("ref_id")), ["ref_id"], "id", self._next("learning_events"))
        fields = [f for f in self.store.schemas["learning_events"].fields if f.name not in ("id", "kind", "at", "ref_id")]
        self.store.append("learning_events", events.select("id", F.lit("episode_stored").alias("kind"), F.lit(at).cast("timestamp").alias("at"), "ref_id", *(F.lit(None).cast(f.dataType).alias(f.name) for f in fields)))

    def flush(self) -> list[str]:
        """Writes tables of many parts as one part each; their names."""
        return [t for t in TABLES if self.store.compact(t)]

    def install_embedder(self, embedder) -> None:
        """Another embedder: the stored embeddings are made anew with it, signatures and gists stay."""
        self.embed = embedder
        old = self.signatures().drop("emb")
        emb = self.embed(self.episodes().select("id", "text"), "id").withColumnRenamed("hv", "emb")
        self.store.replace("vectors", old.join(emb, "id", "left"))

    # -- observing and reading

    def observe(self, text: str, source: str = "unknown", session: str | None = None, now: datetime | None = None) -> int:
        """Stores one text and returns its id."""
        return self.observe_batch([text], source, session, now)[0]

    def observe_batch(self, texts: list[str], source: str = "unknown", session: str | None = None, now: datetime | None = None) -> list[int]:
        df = self.spark.createDataFrame(list(enumerate(texts)), "pos long, text string")
        return list(self.observe_table(df, source, session, now))

    def observe_table(self, texts: DataFrame, source: str = "unknown", session: str | None = None, now: datetime | None = None) -> range:
        """Stores a table (pos, text, [observed_at]) and returns the ids given: facts, aliases, concepts, episodes and events in one append each."""
        at = self._now(now)
        first = self._next("episodes")
        new = X.observe(texts, F.lit(at).cast("timestamp"), first, self.extract, source, session).persist()
        if self.extractor_loaded:
            said = new.select(F.explode("triples").alias("t"))
            names = said.select(F.col("t.subject").alias("name")).unionByName(said.select(F.col("t.object").alias("name")))
            linked = X.resolve_aliases(names, self.table("concepts"), X.ALIAS_DISTANCE).persist()
            fresh = linked.filter("how = 'new'").groupBy(F.col("concept_id").alias("id")).agg(F.min("name").alias("canonical_name"))
            self.store.append("concepts", fresh.withColumn("aliases", F.array().cast("array<string>")).withColumn("entity_type", F.lit(None).cast("string")))
            canonical = linked.join(self.table("concepts").select(F.col("id").alias("concept_id"), "canonical_name"), "concept_id").select("name", "canonical_name")
            each = new.select("id", F.posexplode("triples").alias("pos", "t"))
            sub, obj = canonical.toDF("s", "sc"), canonical.toDF("o", "oc")
            mapped = each.join(sub, F.col("t.subject") == F.col("s"), "left").join(obj, F.col("t.object") == F.col("o"), "left")
            fact = F.struct(F.coalesce("sc", "t.subject").alias("subject"), F.col("t.predicate").alias("predicate"), F.coalesce("oc", "t.object").alias("object"), F.col("t.confidence").alias("confidence"))
            facts = mapped.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", fact.alias("f")))).alias("fs")).select("id", F.transform("fs", lambda x: x["f"]).alias("triples"))
            new = new.drop("triples").join(facts, "id", "left").withColumn("triples", F.coalesce("triples", F.array().cast(X.TRIPLES)))
        new = new.persist()
        self.store.append("episodes", new)
        self._stored(new, at)
        return range(first, first + new.count())

    def episodes(self) -> DataFrame:
        return E.unique_episodes(self.table("episodes"))

    def get_episode(self, id_: int) -> Row:
        rows = E.get_episode(self.episodes(), self.table("tombstones"), id_).collect()
        if not rows:
            raise UnknownId(f"episode {id_}")
        return rows[0]

    def list_episodes(self, limit: int = 100) -> list[Row]:
        return E.list_episodes(self.episodes(), self.table("tombstones"), limit).collect()

    def links(self) -> DataFrame:
        return E.bridge(self.episodes(), self.table("concepts"))

    def _concepts_named(self, name: str) -> list[int]:
        asked = self.spark.createDataFrame([(name,)], "name string")
        return [r.concept_id for r in E.concept_lookup(asked, self.table("concepts")).collect()]

    def create_concept(self, name: str, entity_type: str | None = None) -> int:
        """The id of the concept of exactly this name, made if there is none."""
        have = self.table("concepts").filter(F.col("canonical_name") == name).agg(F.min("id")).collect()[0][0]
        if have is not None:
            return have
        id_ = self._next("concepts")
        self.store.append("concepts", self._rows("concepts", [(id_, name, [], entity_type)]))
        return id_

    def concept_name(self, id_: int) -> str:
        return self._one("concepts", id_).canonical_name

    def timeline(self, low: datetime, high: datetime, subject: str | None = None, limit: int | None = None) -> list[Row]:
        """Episodes of a window, of a subject if given; an unknown subject has none."""
        ids = None if subject is None else self._concepts_named(subject)
        at = lambda t: F.lit(t).cast("timestamp")
        return E.timeline(self.episodes(), self.table("tombstones"), self.links(), ids, at(low), at(high), MOST_ROWS if limit is None else limit).collect()

    def _vectors(self, eps: DataFrame) -> DataFrame:
        """(id, sig, gist, emb) of episodes; an episode without facts has its gist as signature."""
        made = eps.select("id", hv.token_bundle(self.words)(terms("text")).alias("gist"), hv.signature(self.words)(F.col("triples"), F.col("valid_start")).alias("sig"))
        emb = self.embed(eps.select("id", "text"), "id").withColumnRenamed("hv", "emb")
        return made.join(emb, "id", "left").select("id", F.coalesce("sig", "gist").alias("sig"), "gist", "emb")

    def signatures(self) -> DataFrame:
        """(id, sig, gist, emb) of all episodes as stored with them; those of rows stored without are made now."""
        have = self.table("vectors").dropDuplicates(["id"])
        missing = self.episodes().join(have.select("id"), "id", "left_anti")
        return have if missing.isEmpty() else have.unionByName(self._vectors(missing))

    def recall(self, query: Query) -> Recall:
        """Ranked matches of one cue."""
        window = query.time_window or (None, None)
        row = (1, query.cue, query.k, query.min_confidence, query.as_of, *window, query.subject)
        cues = self.spark.createDataFrame([row], "query_id long, cue string, k int, min_confidence double, as_of timestamp, window_from timestamp, window_to timestamp, subject string")
        matches, atoms = self.recall_table(cues, query)
        rows = matches.orderBy("rank").collect()
        depth = min((S.TIERS.index(r.tier) for r in rows), default=None)
        return Recall(rows, atoms.orderBy("atom_id").collect(), None if depth is None else S.TIERS[depth])

    def recall_cue(self, cue: str, k: int = 10) -> Recall:
        return self.recall(Query(cue, k))

    def recall_table(self, cues: DataFrame, query: Query | None = None) -> tuple[DataFrame, DataFrame]:
        """Matches and atoms for a table of cues; `query` gives the floor, goal bias and recency of all of them."""
        query = query or Query("")
        eps, stones, concepts = self.episodes(), self.table("tombstones"), self.table("concepts")
        deep = S.TIERS.index(query.tier_floor) >= 2
        vectors = self.signatures() if deep else None
        embedded = self.embed(cues.select("query_id", F.col("cue").alias("text")), "query_id") if deep else None
        found = R.cascade(cues, eps, stones, concepts, vectors, embedded, query.tier_floor, self.words)
        if query.goal_bias_weight > 0:
            sig = (vectors if vectors is not None else self.signatures()).select("id", F.col("sig").alias("hv"))
            found = R.goal_bias(found, G.active(self.table("goals")), sig, query.goal_bias_weight, self.words)
        if query.recency_weight > 0 and query.recency_anchor is not None:
            found = R.recency_rerank(found, E.scan_directory(eps, stones), F.lit(query.recency_anchor).cast("timestamp"), query.recency_weight, query.half_life_s)
        return R.finish(found, cues, eps), R.atoms_lane(cues, concepts, self.table("semantic_atoms"), stones)

    def supersede(self, older: int, newer: int) -> None:
        for i in (older, newer):
            self._one("episodes", i)
        links = self.spark.createDataFrame([(older, newer)], "older long, newer long")
        self.store.replace("episodes", temporal.supersede(self.episodes(), links))

    # -- maintenance

    def consolidate(self, now: datetime | None = None) -> dict:
        """Makes atoms of repeated facts and supersedes contradicted ones; returns what it did."""
        at = self._now(now)
        eps, stones, concepts, atoms = self.episodes(), self.table("tombstones"), self.table("concepts"), self.table("semantic_atoms")
        live = E.live(eps, stones)
        open_ = C.pending(eps, stones, atoms)
        facts = hv.bundle_groups(hv.episode_members(open_, self.words), "id", "hv", self.words).select("id", "hv").persist()
        new = C.atoms_of(C.clusters(facts, self.words), open_, concepts, F.lit(at).cast("timestamp"), self.words, self._next("semantic_atoms"), facts).persist()
        made, scanned = new.count(), live.count()
        links = temporal.contradictions(temporal.facts_of(live)).persist()
        against = links.count()
        if made:
            self.store.append("semantic_atoms", new)
        if against:
            self.store.replace("episodes", temporal.supersede(eps, links))
        self.store.append("consolidation_log", self._rows("consolidation_log", [(at, scanned, made, against)]))
        if made:
            self._move_self(at, None)
        self._event("consolidation_run", at, size=made, text=str(against))
        return {"scanned": scanned, "atoms_created": made, "contradictions": against}

    def _bundle(self, vectors: DataFrame) -> list[int] | None:
        rows = hv.bundle_groups(vectors.select(F.lit(1).alias("k"), "hv"), "k", "hv", self.words).collect()
        return rows[0].hv if rows else None

    def _move_self(self, at: datetime, removed: list[int] | None) -> int:
        """A new snapshot: towards all atoms, or without the removed vectors. Returns the drift in bits."""
        other = removed if removed is not None else self._bundle(self.table("semantic_atoms").filter("hv is not null"))
        if other is None:
            return 0
        old = self.self_vector()
        new = [a ^ b for a, b in zip(old, other)] if removed is not None else [a | b for a, b in zip(old, other)]
        drift = sum((a ^ b).bit_count() for a, b in zip(old, new))
        self.store.append("self_vectors", self._rows("self_vectors", [(self._next("self_vectors", "seq"), at, new)]))
        if removed is None:
            self._event("self_vector_updated", at, drift=drift)
        return drift

    def self_vector(self) -> list[int]:
        return selfmodel.current(self.table("self_vectors"), self.words).collect()[0].hv

    def self_vector_history(self) -> list[Row]:
        return selfmodel.snapshots(self.table("self_vectors")).collect()

    def stats(self) -> dict[str, int]:
        names = ("episodes", "concepts", "semantic_atoms", "goals", "beliefs", "learning_events", "consolidation_log")
        return {r.name: r.n for r in E.stats({n: self.table(n) for n in names}).collect()}

    def export_jsonl(self, path: str) -> None:
        """Writes all live episodes with their signatures."""
        sig = self.signatures().select("id", F.col("sig").alias("hv"))
        jsonl.export(E.live(self.episodes(), self.table("tombstones")), path, sig)

    def import_jsonl(self, path: str, now: datetime | None = None) -> int:
        """Adds the episodes of a file with concepts for the names in their facts, vectors and events; later ids are minted after the largest."""
        rows = jsonl.read(self.spark, path).drop("hv").persist()
        said = rows.select(F.explode("triples").alias("t"))
        names = said.select(F.col("t.subject").alias("name")).unionByName(said.select(F.col("t.object").alias("name"))).distinct()
        known = self.table("concepts").select(F.col("canonical_name").alias("name"))
        fresh = order.numbered(names.filter("name is not null").join(known, "name", "left_anti"), ["name"], "id", self._next("concepts"))
        none = F.lit(None).cast("string")
        self.store.append("concepts", fresh.select("id", F.col("name").alias("canonical_name"), F.array().cast("array<string>").alias("aliases"), none.alias("entity_type")))
        self.store.append("episodes", rows)
        self._stored(rows, self._now(now))
        return rows.count()

    # -- goals

    def set_goal(self, description: str, parent_id: int | None = None, deadline: datetime | None = None, criteria: list[str] | None = None, now: datetime | None = None,
                 source: str = "unknown", session: str | None = None) -> int:
        at, id_ = self._now(now), self._next("goals")
        vector = self._text_vector(description)
        if parent_id is not None:
            parent = self.table("goals").filter(F.col("id") == parent_id).select("hv").collect()
            vector = [a ^ b for a, b in zip(vector, parent[0].hv)] if parent else vector
        self.store.append("goals", self._rows("goals", [(id_, parent_id, description, G.ACTIVE, None, [], None, deadline, criteria or [], at, at, self._provenance(source, session), vector, 0)]))
        self._event("goal_set", at, ref_id=id_, text=description)
        return id_

    def _text_vector(self, text: str) -> list[int]:
        df = self.spark.createDataFrame([(text,)], "t string")
        row = df.select(F.size(tokens("t")).alias("n"), hv.token_bundle(self.words)(tokens("t")).alias("v"), hv.from_name("t", self.words).alias("whole")).collect()[0]
        return list(row.v if row.n else row.whole)

    def _move_goal(self, id_: int, request: str, now: datetime | None, **values) -> None:
        at, goal = self._now(now), self._one("goals", id_)
        to = G.move(goal.state, request)
        if to is None:
            raise InvalidTransition(f"goal {id_} is {goal.state}: {request}")
        self._update("goals", id_, state=to, updated_at=at, **values)
        if to != goal.state:
            self._event("goal_state_changed", at, ref_id=id_, from_state=goal.state, to_state=to)

    def pause_goal(self, id_: int, reason: str = "", now: datetime | None = None) -> None:
        self._move_goal(id_, "pause", now, paused_reason=reason)

    def resume_goal(self, id_: int, now: datetime | None = None) -> None:
        self._move_goal(id_, "resume", now, paused_reason=None)

    def complete_goal(self, id_: int, evidence: list[int] | None = None, now: datetime | None = None) -> None:
        self._move_goal(id_, "complete", now, completed_evidence=evidence or [])

    def abandon_goal(self, id_: int, reason: str = "", now: datetime | None = None) -> None:
        self._move_goal(id_, "abandon", now, abandoned_reason=reason)

    def revise_goal(self, id_: int, now: datetime | None = None, **patch) -> None:
        """Changes description, deadline or success_criteria; a new description has a new vector."""
        if "description" in patch:
            vector, goal = self._text_vector(patch["description"]), self._one("goals", id_)
            if goal.parent_id is not None:
                parent = self.table("goals").filter(F.col("id") == goal.parent_id).select("hv").collect()
                vector = [a ^ b for a, b in zip(vector, parent[0].hv)] if parent else vector
            patch["hv"] = vector
        self._move_goal(id_, "revise", now, **patch)

    def get_goal(self, id_: int) -> Row:
        return self._one("goals", id_)

    def goal_signature(self, id_: int) -> list[int]:
        return list(self._one("goals", id_).hv)

    def active_goals(self) -> list[Row]:
        return G.active(self.table("goals")).collect()

    def all_goals(self, limit: int = MOST_ROWS) -> list[Row]:
        return self.table("goals").orderBy("id").limit(limit).collect()

    # -- beliefs

    def assert_belief(self, claim: str, confidence: float = 0.5, subject: str = "", predicate: str = "", object: str = "", evidence: list[int] | None = None, now: datetime | None = None,
                      source: str = "unknown", session: str | None = None) -> int:
        """A new belief, or the evidence added to the active one on the same subject and predicate."""
        at, confidence = self._now(now), min(1.0, max(0.0, confidence))
        if subject and predicate:
            same = B.active_by_key(self.table("beliefs")).filter((F.col("subject") == subject) & (F.col("predicate") == predicate)).collect()
            if same:
                old = self._one("beliefs", same[0].id)
                fresh = [e for e in dict.fromkeys(evidence or []) if e not in old.evidence]
                value = old.confidence
                for _ in fresh:
                    value = B.step(value, True)
                self._update("beliefs", old.id, confidence=value, evidence=[*old.evidence, *fresh])
                self._revision(old.id, old.confidence, value, fresh[-1] if fresh else None, True, "asserted again", at)
                return old.id
        id_ = self._next("beliefs")
        self.store.append("beliefs", self._rows("beliefs", [(id_, claim, subject, predicate, object, confidence, evidence or [], [], at, None, self._provenance(source, session), self._text_vector(claim), 0)]))
        self._event("belief_asserted", at, ref_id=id_, text=claim, confidence=confidence)
        return id_

    def _revision(self, id_: int, old: float, new: float, episode: int | None, supports: bool, reason: str, at: datetime) -> None:
        seq = self.table("belief_revisions").filter(F.col("belief_id") == id_).count()
        self.store.append("belief_revisions", self._rows("belief_revisions", [(id_, seq, old, new, episode, supports, reason, at)]))

    def revise_belief(self, id_: int, episode_id: int, supports: bool, reason: str = "", now: datetime | None = None) -> tuple[float, float, bool]:
        """One step for or against; returns old and new confidence and whether the belief is withdrawn by it."""
        at, b = self._now(now), self._one("beliefs", id_)
        if b.t_valid_end is not None:
            raise InvalidTransition(f"belief {id_} is withdrawn")
        new = B.step(b.confidence, supports)
        gone = new < S.WITHDRAW_BELOW
        column = "evidence" if supports else "contradictions"
        cited = list(dict.fromkeys([*b[column], episode_id]))
        self._update("beliefs", id_, confidence=new, **{column: cited}, **({"t_valid_end": at} if gone else {}))
        self._revision(id_, b.confidence, new, episode_id, supports, reason, at)
        self._event("belief_revised", at, ref_id=id_, previous=b.confidence, confidence=new, reason=reason)
        return b.confidence, new, gone

    def withdraw_belief(self, id_: int, reason: str = "", now: datetime | None = None) -> None:
        """Confidence 0 and an end; a second withdrawal changes nothing."""
        at, b = self._now(now), self._one("beliefs", id_)
        if b.t_valid_end is None:
            self._update("beliefs", id_, confidence=0.0, t_valid_end=at)
            self._event("belief_withdrawn", at, ref_id=id_, reason=reason)

    def what_do_i_believe(self, subject: str) -> list[Row]:
        return B.about(self.table("beliefs"), self.table("tombstones"), subject).orderBy("id").collect()

    def belief_history(self, id_: int) -> list[Row]:
        return B.history(self.table("belief_revisions"), id_).collect()

    def get_belief(self, id_: int) -> Row:
        return self._one("beliefs", id_)

    def belief_signature(self, id_: int) -> list[int]:
        return list(self._one("beliefs", id_).hv)

    def all_beliefs(self, limit: int = MOST_ROWS) -> list[Row]:
        return self.table("beliefs").orderBy("id").limit(limit).collect()

    # -- unlearning

    def unlearn(self, kind: str, value, reason: str = "", now: datetime | None = None, atoms_of_provenance: bool = False) -> dict:
        """Deletes a target with all that hangs on it; returns sizes, drift and the audit id for a restore."""
        at = self._now(now)
        eps, beliefs, atoms = self.episodes(), self.table("beliefs"), self.table("semantic_atoms")
        if kind == "concept" and isinstance(value, str):
            ids = self._concepts_named(value)
            if not ids:
                raise UnknownId(f"concept {value}")
            value = ids[0]
        gone = U.cascade(kind, value, eps, beliefs, atoms, self.links(), self.table("concepts"), atoms_of_provenance).persist()
        sizes = U.report(gone, beliefs).collect()[0].asDict()
        vectors = self.signatures().select("id", F.col("sig").alias("hv")).join(gone.filter("kind = 0").select("id"), "id", "left_semi").select("hv")
        vectors = vectors.unionByName(beliefs.join(gone.filter("kind = 1").select("id"), "id", "left_semi").select("hv"))
        vectors = vectors.unionByName(atoms.join(gone.filter("kind = 2").select("id"), "id", "left_semi").filter("hv is not null").select("hv"))
        removed = self._bundle(vectors)
        drift = self._move_self(at, removed) if removed is not None else 0
        total = sizes["episodes"] + sizes["beliefs"] + sizes["atoms"]
        audit = self._event("unlearned", at, text=U.label(kind, value), size=total, drift=drift, reason=reason)
        self.store.append("tombstones", U.new_tombstones(gone, F.lit(at).cast("timestamp"), reason, audit))
        own = gone.filter("kind = 1").select("id", F.lit(True).alias("own"))
        fixed = B.correct_evidence(beliefs, gone.filter("kind = 0").select("id")).toDF("id", "c2", "e2", "x2", "corrected", "withdrawn")
        x = beliefs.join(fixed, "id", "left").join(own, "id", "left").withColumn("own", F.coalesce("own", F.lit(False)))
        ends = (F.col("own") | F.col("withdrawn")) & F.col("t_valid_end").isNull()
        x = x.withColumns({"confidence": F.when(F.col("own"), 0.0).otherwise(F.col("c2")), "evidence": F.col("e2"), "contradictions": F.col("x2"), "t_valid_end": F.when(ends, F.lit(at).cast("timestamp")).otherwise(F.col("t_valid_end"))})
        touched = x.filter("own or corrected").withColumn("rev", F.coalesce("rev", F.lit(0)) + 1)
        self.store.append("beliefs", touched.drop("c2", "e2", "x2", "corrected", "withdrawn", "own"))
        return {**sizes, "self_vector_drift": drift, "audit_event_id": audit}

    def restore_within_window(self, audit_event_id: int, now: datetime | None = None) -> int:
        """Takes back the tombstones of an audit event; an event older than the window raises RestoreExpired."""
        at = F.lit(self._now(now)).cast("timestamp")
        stones = self.table("tombstones")
        n = U.restorable(stones, audit_event_id, at).count()
        if not n and stones.filter(F.col("audit_event_id") == audit_event_id).count():
            raise RestoreExpired(f"audit event {audit_event_id}")
        if n:
            self.store.replace("tombstones", U.restore(stones, audit_event_id, at))
        return n

    def unlearn_history(self, limit: int = MOST_ROWS) -> list[Row]:
        return E.latest(self.table("tombstones"), ["kind", "id"], ["tombstoned_at"]).orderBy("kind", "id").limit(limit).collect()

    # -- learning log and sensory ring

    def what_did_i_learn(self, since: datetime, limit: int | None = None) -> list[Row]:
        x = self.table("learning_events").filter(F.col("at") >= F.lit(since).cast("timestamp")).orderBy("at", "id")
        return x.limit(MOST_ROWS if limit is None else limit).collect()

    def all_learning_events(self, limit: int = MOST_ROWS) -> list[Row]:
        return self.table("learning_events").orderBy("at", "id").limit(limit).collect()

    def learning_event_count(self) -> int:
        return self.table("learning_events").count()

    def observe_sensory(self, text: str, now: datetime | None = None) -> tuple[int, float, bool]:
        """Frame id, surprise against the latest live episodes, and whether the frame became an episode."""
        at = self._now(now)
        recent = E.live(self.episodes(), self.table("tombstones")).orderBy(F.desc("id")).limit(sensory.LOOK_BACK)
        rows = [list(r.g) for r in recent.select(hv.token_bundle(self.words)(terms("text")).alias("g")).collect()]
        _, surprise, promoted = sensory.Ring(self.words, rows).see(text)
        id_ = self._next("sensory_frames")
        self.store.append("sensory_frames", self._rows("sensory_frames", [(id_, text, at, surprise, promoted)]))
        if promoted:
            frame = self.table("sensory_frames").filter(F.col("id") == id_)
            new = sensory.promoted_episodes(frame, self._next("episodes"), F.lit(at).cast("timestamp")).persist()
            self.store.append("episodes", new)
            self._stored(new, at)
        if id_ % sensory.CAPACITY == 0:  # the oldest frames leave the ring
            self.store.replace("sensory_frames", sensory.kept(self.table("sensory_frames")))
        return id_, surprise, promoted

    def sensory_frames(self, limit: int = 100) -> list[Row]:
        """The newest frames; the ring keeps a fixed number."""
        return sensory.kept(self.table("sensory_frames"), min(limit, sensory.CAPACITY)).collect()

"""Schemas of the engine's tables."""

from __future__ import annotations

TRIPLE = "struct<subject:string,predicate:string,object:string,confidence:double>"
PROVENANCE = "struct<source:string,session_id:string,trace_id:string,metadata:map<string,string>>"

EPISODES = (
    f"id long, text string, triples array<{TRIPLE}>, valid_start timestamp, valid_end timestamp, t_tx_start timestamp, "
    f"provenance {PROVENANCE}, confidence double, superseded_by long"
)
CONCEPTS = "id long, canonical_name string, aliases array<string>, entity_type string"
BRIDGE = "concept_id long, episode_id long"
ATOMS = "id long, concept_id long, claim string, evidence array<long>, evidence_count long, confidence double, created_at timestamp, hv array<bigint>"
CONSOLIDATION_LOG = "at timestamp, scanned long, atoms_created long, contradictions long"
GOALS = (
    "id long, parent_id long, description string, state string, paused_reason string, completed_evidence array<long>, abandoned_reason string, "
    f"deadline timestamp, success_criteria array<string>, created_at timestamp, updated_at timestamp, provenance {PROVENANCE}, hv array<bigint>, rev long"
)
BELIEFS = (
    "id long, claim string, subject string, predicate string, object string, confidence double, evidence array<long>, contradictions array<long>, "
    f"t_valid_start timestamp, t_valid_end timestamp, provenance {PROVENANCE}, hv array<bigint>, rev long"
)
REVISIONS = "belief_id long, seq long, previous double, confidence double, episode_id long, supports boolean, reason string, at timestamp"
EVENTS = (
    "id long, kind string, at timestamp, ref_id long, text string, from_state string, to_state string, previous double, confidence double, "
    "reason string, size long, drift long"
)
SELF_VECTORS = "seq long, at timestamp, hv array<bigint>"
TOMBSTONES = "kind int, id long, tombstoned_at timestamp, reason string, audit_event_id long"
VECTORS = "id long, sig array<bigint>, gist array<bigint>, emb array<bigint>"
FRAMES = "id long, text string, at timestamp, surprise double, promoted boolean"

# Kinds of learning events.
EVENT_KINDS = [
    "episode_stored", "goal_set", "goal_state_changed", "belief_asserted", "belief_revised", "belief_withdrawn", "semantic_atom_formed",
    "contradiction_detected", "consolidation_run", "unlearned", "self_vector_updated",
]
KIND_EPISODE, KIND_BELIEF, KIND_ATOM = 0, 1, 2
EPISODE_COLUMNS = ["id", "text", "triples", "valid_start", "valid_end", "t_tx_start", "provenance", "confidence", "superseded_by"]

"""Command line: python -m palimpsest ROOT COMMAND [arguments]; one operation per run, or `serve` for JSON-RPC on stdio."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime

from palimpsest.api import MemoryEngine, Query
from palimpsest.functions.scoring import TIERS
from palimpsest.operators.extract import extractor
from palimpsest.session import local_session
from palimpsest.tools import Tools, plain

# Names of tiers on the command line.
TIER_NAMES = {"exact": "Exact", "lexical": "Lexical", "similarity": "Similarity", "sim": "Similarity", "semantic": "Semantic", "gist": "Gist",
              "nearest": "NearestNeighbor", "nearestneighbor": "NearestNeighbor", "nn": "NearestNeighbor"}


def tier(name: str) -> str:
    """A tier by its name or short form, in any case."""
    if name.lower() not in TIER_NAMES:
        raise argparse.ArgumentTypeError(f"tiers are {TIERS}")
    return TIER_NAMES[name.lower()]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="palimpsest")
    p.add_argument("root")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *arguments: str, **options: dict) -> None:
        c = sub.add_parser(name)
        for a in arguments:
            c.add_argument(a)
        for k, v in options.items():
            c.add_argument(f"--{k.replace('_', '-')}", dest=k, **v)

    number, text, when = {"type": int, "default": None}, {"default": None}, {"type": datetime.fromisoformat, "default": None}
    add("observe", "text", source={"default": "cli"})
    add("recall", "cue", k={"type": int, "default": 10}, min_confidence={"type": float, "default": 0.0}, as_of=when, subject=text, floor={"type": tier, "default": "NearestNeighbor"})
    for name in ("consolidate", "stats", "active-goals", "goals", "beliefs", "unlearn-history", "self-vector", "self-vector-history", "event-count", "serve"):
        add(name)
    add("episode", "id")
    add("episodes", limit={"type": int, "default": 100})
    add("timeline", "low", "high", subject=text, limit=number)
    add("export", "path")
    add("import", "path")
    add("supersede", "older", "newer")
    add("set-goal", "description", parent=number, deadline=when)
    for name in ("pause-goal", "abandon-goal", "withdraw-belief"):
        add(name, "id", reason={"default": ""})
    for name in ("resume-goal", "complete-goal", "goal", "belief", "belief-history"):
        add(name, "id")
    add("assert", "claim", confidence={"type": float, "default": 0.5}, subject={"default": ""}, predicate={"default": ""}, object={"default": ""})
    add("revise", "id", "episode", against={"action": "store_true"}, reason={"default": ""})
    add("believe", "subject")
    add("unlearn", "kind", "target", reason={"default": ""})
    add("restore", "audit")
    add("learned", since={"type": datetime.fromisoformat, "required": True}, limit=number)
    add("sense", "text")
    add("frames", limit={"type": int, "default": 100})
    return p


def run(e: MemoryEngine, a: argparse.Namespace):
    """The result of one command."""
    i = int(a.id) if getattr(a, "id", None) is not None else 0
    at = datetime.fromisoformat
    return {
        "observe": lambda: e.observe(a.text, a.source), "recall": lambda: vars(e.recall(Query(a.cue, a.k, a.min_confidence, a.as_of, subject=a.subject, tier_floor=a.floor))),
        "consolidate": e.consolidate, "stats": e.stats, "active-goals": e.active_goals, "goals": e.all_goals, "beliefs": e.all_beliefs, "unlearn-history": e.unlearn_history,
        "self-vector": e.self_vector, "self-vector-history": e.self_vector_history, "event-count": e.learning_event_count, "episode": lambda: e.get_episode(i),
        "episodes": lambda: e.list_episodes(a.limit), "timeline": lambda: e.timeline(at(a.low), at(a.high), a.subject, a.limit), "export": lambda: e.export_jsonl(a.path),
        "import": lambda: e.import_jsonl(a.path), "supersede": lambda: e.supersede(int(a.older), int(a.newer)), "set-goal": lambda: e.set_goal(a.description, a.parent, a.deadline),
        "pause-goal": lambda: e.pause_goal(i, a.reason), "abandon-goal": lambda: e.abandon_goal(i, a.reason), "withdraw-belief": lambda: e.withdraw_belief(i, a.reason),
        "resume-goal": lambda: e.resume_goal(i), "complete-goal": lambda: e.complete_goal(i), "goal": lambda: e.get_goal(i), "belief": lambda: e.get_belief(i),
        "belief-history": lambda: e.belief_history(i), "assert": lambda: e.assert_belief(a.claim, a.confidence, a.subject, a.predicate, a.object),
        "revise": lambda: e.revise_belief(i, int(a.episode), not a.against, a.reason), "believe": lambda: e.what_do_i_believe(a.subject),
        "unlearn": lambda: e.unlearn(a.kind, int(a.target) if a.target.isdigit() else a.target, a.reason), "restore": lambda: e.restore_within_window(int(a.audit)),
        "learned": lambda: e.what_did_i_learn(a.since, a.limit), "sense": lambda: e.observe_sensory(a.text), "frames": lambda: e.sensory_frames(a.limit),
        "serve": lambda: Tools(e).serve(sys.stdin, sys.stdout),
    }[a.command]()


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    engine = MemoryEngine(local_session(), a.root, extractor() if a.command in ("observe", "serve") else None)
    result = run(engine, a)
    if a.command != "serve":
        print(json.dumps(plain(result)))


if __name__ == "__main__":
    main()

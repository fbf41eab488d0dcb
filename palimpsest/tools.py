"""The engine's operations as named tools with JSON arguments and results, and a line-based JSON-RPC loop."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import date, datetime, timedelta, timezone
from typing import IO, Any

from palimpsest.api import MemoryEngine, MemoryError_, Query

# Error codes of JSON-RPC and of tools that fail.
PARSE_ERROR, INVALID_REQUEST, METHOD_NOT_FOUND, INVALID_PARAMS, INTERNAL_ERROR, TOOL_ERROR = -32700, -32600, -32601, -32602, -32603, -32000
PROTOCOL = "2024-11-05"


def plain(x: Any) -> Any:
    """JSON-ready form of rows, times and nested values."""
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items() if k != "hv"}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return x.isoformat() if isinstance(x, (datetime, date)) else x


def _time(x: str | None) -> datetime | None:
    if x is None:
        return None
    t = datetime.fromisoformat(x.replace("Z", "+00:00"))
    return t.astimezone(timezone.utc).replace(tzinfo=None) if t.tzinfo else t


def _id(x: Any) -> int:
    return int(str(x).strip())


class Tools:
    """Registry of tools on one engine."""

    def __init__(self, engine: MemoryEngine):
        self.engine = engine
        e = engine
        text, number, flag = {"type": "string"}, {"type": "number"}, {"type": "boolean"}
        self.registry: dict[str, tuple[Callable[[dict], Any], dict, list[str]]] = {
            "memory_observe": (lambda a: {"episode_id": e.observe(a["text"], a.get("source", "tool"))}, {"text": text}, ["text"]),
            "memory_recall": (self._recall, {"cue": text, "k": number, "min_confidence": number}, ["cue"]),
            "memory_consolidate": (lambda a: e.consolidate(), {}, []),
            "memory_get_episode": (lambda a: e.get_episode(_id(a["id"])), {"id": text}, ["id"]),
            "memory_set_goal": (lambda a: {"goal_id": e.set_goal(a["description"], deadline=_time(a.get("deadline")))}, {"description": text, "deadline": text}, ["description"]),
            "memory_active_goals": (lambda a: e.active_goals(), {}, []),
            "memory_assert_belief": (self._assert, {"claim": text, "confidence": number, "subject": text, "predicate": text, "object": text}, ["claim"]),
            "memory_revise_belief": (self._revise, {"belief_id": text, "evidence": text, "supports": flag, "reason": text}, ["belief_id", "evidence", "supports"]),
            "memory_beliefs": (lambda a: e.what_do_i_believe(a["about"]) if a.get("about") else e.all_beliefs(), {"about": text}, []),
            "memory_unlearn": (self._unlearn, {"target_kind": text, "target": text, "reason": text}, ["target_kind", "target"]),
            "memory_what_did_i_learn": (self._learned, {"since": text, "limit": number}, []),
            "memory_stats": (lambda a: e.stats(), {}, []),
            "memory_sense": (self._sense, {"text": text}, ["text"]),
        }

    def _recall(self, a: dict) -> dict:
        began = datetime.now()
        r = self.engine.recall(Query(a["cue"], int(a.get("k", 10)), float(a.get("min_confidence", 0))))
        ms = (datetime.now() - began).total_seconds() * 1000
        return {"tier_used": r.tier_used, "elapsed_ms": ms, "matches": r.matches, "semantic_atoms": r.semantic_atoms}

    def _assert(self, a: dict) -> dict:
        fact = [a.get(k, "") for k in ("subject", "predicate", "object")]
        if any(fact) and not all(fact):
            raise ValueError("subject, predicate and object come together")
        return {"belief_id": self.engine.assert_belief(a["claim"], float(a.get("confidence", 0.5)), *fact)}

    def _revise(self, a: dict) -> dict:
        old, new, gone = self.engine.revise_belief(_id(a["belief_id"]), _id(a["evidence"]), bool(a["supports"]), a.get("reason", ""))
        return {"old_confidence": old, "new_confidence": new, "withdrawn": gone}

    def _unlearn(self, a: dict) -> dict:
        kind, target = a["target_kind"], a["target"]
        return self.engine.unlearn(kind, _id(target) if kind in ("episode", "belief") else target, a.get("reason", ""))

    def _learned(self, a: dict) -> list:
        since = _time(a.get("since")) or datetime.now(timezone.utc).replace(tzinfo=None) - timedelta(days=1)
        return self.engine.what_did_i_learn(since, int(a.get("limit", 100)))

    def _sense(self, a: dict) -> dict:
        return dict(zip(("frame_id", "surprise", "promoted"), self.engine.observe_sensory(a["text"])))

    def list(self) -> list[dict]:
        """Descriptors of all tools."""
        return [{"name": n, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (_, p, r) in self.registry.items()]

    def call(self, name: str, arguments: dict | None = None) -> dict:
        """The result of a tool as a text block; failures of the engine come back marked as errors."""
        if name not in self.registry:
            raise KeyError(name)
        run, _, required = self.registry[name]
        a = arguments or {}
        missing = [r for r in required if r not in a]
        if missing:
            raise ValueError(f"missing arguments: {missing}")
        try:
            return {"content": [{"type": "text", "text": json.dumps(plain(run(a)))}], "isError": False}
        except MemoryError_ as x:
            return {"content": [{"type": "text", "text": f"{type(x).__name__}: {x}"}], "isError": True}

    def handle(self, request: Any) -> dict | None:
        """The response to one JSON-RPC request; None for a notification."""
        if not isinstance(request, dict) or request.get("jsonrpc") != "2.0" or "method" not in request:
            return self._error(None, INVALID_REQUEST, "no JSON-RPC request")
        id_, method, params = request.get("id"), request["method"], request.get("params") or {}
        if "id" not in request:
            return None
        try:
            if method == "initialize":
                result: Any = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "palimpsest"}}
            elif method == "ping":
                result = {}
            elif method == "tools/list":
                result = {"tools": self.list()}
            elif method == "tools/call":
                if params.get("name") not in self.registry:
                    return self._error(id_, INVALID_PARAMS, f"unknown tool {params.get('name')}")
                result = self.call(params["name"], params.get("arguments"))
            else:
                return self._error(id_, METHOD_NOT_FOUND, method)
        except (ValueError, TypeError) as x:
            return self._error(id_, INVALID_PARAMS, str(x))
        except Exception as x:  # a failed request must not end the loop
            return self._error(id_, INTERNAL_ERROR, str(x)[:500])
        return {"jsonrpc": "2.0", "id": id_, "result": result}

    @staticmethod
    def _error(id_: Any, code: int, message: str) -> dict:
        return {"jsonrpc": "2.0", "id": id_, "error": {"code": code, "message": message}}

    def serve(self, source: IO[str], sink: IO[str]) -> None:
        """Answers one request per line until the source ends."""
        for line in source:
            if not line.strip():
                continue
            try:
                response = self.handle(json.loads(line))
            except ValueError as x:
                response = self._error(None, PARSE_ERROR, str(x))
            if response is not None:
                sink.write(json.dumps(response) + "\n")
                sink.flush()

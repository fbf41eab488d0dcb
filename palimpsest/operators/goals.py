"""Goals: a validated state machine over transition requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.folds import ordered_fold

# States, and the state each request leads to from the states that allow it.
ACTIVE, PAUSED, COMPLETED, ABANDONED = "Active", "Paused", "Completed", "Abandoned"
MOVES = {
    "pause": ({ACTIVE}, PAUSED), "resume": ({PAUSED}, ACTIVE), "complete": ({ACTIVE, PAUSED}, COMPLETED),
    "abandon": ({ACTIVE, PAUSED}, ABANDONED), "revise": ({ACTIVE, PAUSED}, None),
}
LOG = "goal_id long, seq long, request string, from_state string, to_state string, accepted boolean"


def move(state: str, request: str) -> str | None:
    """The state after a request, or None if the state does not allow it."""
    allowed, to = MOVES.get(request, (set(), None))
    return (to or state) if state in allowed else None


def transitions(requests: DataFrame) -> DataFrame:
    """Every request (goal_id, at, seq, request) with the states before and after it and whether it was accepted.

    Goals begin active; refused and unknown requests change nothing.
    """

    def go(state: str, row: dict) -> tuple[str, dict]:
        to = move(state, row["request"])
        return to or state, {"seq": row["seq"], "request": row["request"], "from_state": state, "to_state": to or state, "accepted": to is not None}

    return ordered_fold(requests.filter("goal_id is not null"), ["goal_id"], ["at", "seq"], lambda _: ACTIVE, go, LOG)


def is_terminal(state: str = "state"):
    """Column: completed or abandoned."""
    return F.col(state).isin(COMPLETED, ABANDONED)


def active(goals: DataFrame) -> DataFrame:
    """Goals that bias recall, in id order."""
    return goals.filter(F.col("state") == ACTIVE).orderBy("id")

"""Filling containers of fixed capacity with items: bin completion, block by block.

Items are dealt to blocks of bounded size by hash, and each block is solved in one task:
best-fit decreasing gives the incumbent, then branch and bound completes one container
after the other around the largest item left. It branches over the undominated fillings,
fullest first, and prunes a branch when the space it has wasted leaves no room for a
better result. No branch is thrown away; an `Effort` bounds the search, and `EXACT` has no
bounds. Containers that stay loosely filled are opened and their items packed once more
together with those of other blocks. Only keys and sizes are moved, never the items.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Effort:
    """Bounds of the search, none of them on items: partial fillings looked at per block and per container, fillings branched over."""

    steps: float = 40_000
    filling_steps: float = 60
    width: float = 4


EXACT = Effort(float("inf"), float("inf"), float("inf"))
PACKED = "profile string, doc_id long, piece int, tokens long, container string, capacity long, fill double, solved boolean, proven boolean"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: indices of the items of each container."""
    rooms: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect_left(rooms, (sizes[i], -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        insort(rooms, (room - sizes[i], b))
    return bins


def dominates(g: tuple[int, ...], f: tuple[int, ...]) -> bool:
    """Whether filling g is at least as good as f: the sizes of f fit into places of the size of those of g.

    Then the items of g can be exchanged for those of f wherever they lie, so some best packing has g here.
    """
    mine, theirs = list(g), []
    for x in f:  # what both have stays in its place
        mine.remove(x) if x in mine else theirs.append(x)
    theirs.sort(reverse=True)

    def fit(i: int) -> bool:
        if i == len(theirs):
            return True
        tried = set()
        for k, room in enumerate(mine):
            if room >= theirs[i] and room not in tried:
                tried.add(room)
                mine[k] -= theirs[i]
                if fit(i + 1):
                    return True
                mine[k] += theirs[i]
        return False

    return sum(mine) >= sum(theirs) and fit(0)


def fillings(free: list[int], room: int, effort: Effort) -> tuple[list[tuple[int, ...]], int, bool]:
    """Undominated ways to fill `room` with sizes out of the ascending list `free`, fullest first.

    The search is deterministic and looks at no more than `effort.filling_steps` partial fillings; their number is
    returned too, and whether all undominated fillings were found.
    """
    found: dict[tuple[int, ...], int] = {}
    seen, whole = 0, 0

    def grow(hi: int, room: int, chosen: tuple[int, ...]) -> bool:
        nonlocal seen, whole
        seen += 1
        top = bisect_right(free, room, 0, hi)
        if not top:
            whole += room == 0 and chosen not in found
            found[chosen] = room
            return whole >= effort.width or seen >= effort.filling_steps
        i = top
        while i:
            size = free[i - 1]
            if grow(i - 1, room - size, (*chosen, size)):
                return True
            i = bisect_left(free, size, 0, i)  # equal sizes once
        return False

    stopped = grow(len(free), room, ())
    best: list[tuple[int, ...]] = []
    for f in sorted(found, key=lambda f: (found[f], len(f))):
        if not any(dominates(g, f) for g in best):
            if len(best) >= effort.width:
                stopped = True
                break
            best.append(f)
    return best, seen, not stopped


def least_containers(sizes: list[int], capacity: int) -> int:
    """A lower bound: for each threshold, sizes above capacity less the threshold are alone, those above half never share."""
    ordered = sorted(sizes)
    upto = [0]
    for x in ordered:
        upto.append(upto[-1] + x)
    total, best = upto[-1], 0
    for small in {0, *(x for x in ordered if 2 * x <= capacity)}:
        lone = bisect_right(ordered, capacity - small)
        half = bisect_right(ordered, capacity // 2)
        low = bisect_left(ordered, small)
        alone, pairs = len(ordered) - lone, max(0, lone - max(half, 0))
        mid, rest = upto[lone] - upto[min(half, lone)], upto[min(half, lone)] - upto[low] if low < min(half, lone) else 0
        best = max(best, alone + pairs + max(0, -(-(rest - (pairs * capacity - mid)) // capacity)))
    return max(best, -(-total // capacity))


def complete(sizes: list[int], capacity: int, effort: Effort = Effort()) -> tuple[list[list[int]], bool]:
    """Bin completion: indices of the items of each container, never more containers than best-fit decreasing, and a proof.

    Proven best (True) when a lower bound is reached or the search came to its end with all undominated fillings
    looked at; otherwise the best found within the effort. Items must fit the capacity.
    """
    incumbent = best_fit(sizes, capacity)
    bound = least_containers(sizes, capacity)
    if len(incumbent) <= max(bound, 1):
        return incumbent, True
    budget, whole = effort.steps, True
    best: list[tuple[int, ...]] | None = None
    limit = len(incumbent)
    # depth first: the stack holds at most the other fillings of each container on the way
    stack: list[tuple[list[int], int, list[tuple[int, ...]]]] = [(sorted(s for s in sizes if s), 0, [])]
    total = sum(sizes)
    while stack and budget > 0 and limit > bound:
        free, wasted, done = stack.pop()
        while free and budget > 0:
            if wasted > (limit - 1) * capacity - total:  # no room for a better result
                break
            largest, rest = free[-1], free[:-1]
            ways, used, all_seen = fillings(rest, capacity - largest, effort)
            whole &= all_seen
            budget -= used + 1
            options = []
            for w in ways:
                after = list(rest)
                for s in w:
                    after.pop(bisect_left(after, s))
                options.append((after, wasted + capacity - largest - sum(w), [*done, (largest, *w)]))
            stack += reversed(options[1:])
            free, wasted, done = options[0]
        if not free and len(done) < limit:
            best, limit = done, len(done)
    proven = limit <= bound or (whole and budget > 0)
    if best is None:
        return incumbent, proven
    by_size: dict[int, list[int]] = {}
    for i, s in enumerate(sizes):
        by_size.setdefault(s, []).append(i)
    bins = [[by_size[s].pop() for s in b] for b in best]
    bins[0] += by_size.get(0, [])
    return bins, proven


def _solve(effort: Effort):
    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
        capacity = int(df["capacity"].iloc[0])
        sizes = df["tokens"].tolist()
        where, fill = [""] * len(sizes), [0.0] * len(sizes)
        bins, proven = complete(sizes, capacity, effort)
        for n, items in enumerate(bins):
            share = sum(sizes[i] for i in items) / capacity
            for i in items:
                where[i], fill[i] = f"{key[0]}/{key[2]}/{key[1]}/{n}", share
        return df.assign(container=where, fill=fill, solved=True, proven=proven)[["profile", "doc_id", "piece", "tokens", "container", "capacity", "fill", "solved", "proven"]]

    return run


def pack(items: DataFrame, limits: Iterable[tuple[str, int]], block_items: int = 512, effort: Effort = Effort(), loose: float = 0.97) -> DataFrame:
    """(profile, doc_id, piece, tokens, container, capacity, fill, solved, proven): every item in one container of each profile.

    items has doc_id and tokens. An item above the capacity is split into full containers
    and one remainder (pieces 1, 2, ..); all others stay whole as piece 0. Null tokens count
    as 0 and such items lie in some container too; rows without doc_id and limits without a
    positive capacity are left out. Empty input gives no rows. `solved` marks items that bin
    completion placed (all but the full containers), `proven` those of blocks with the fewest
    containers that their items allow.
    """
    limits = [(str(p), int(c)) for p, c in limits if p is not None and c is not None and c > 0]
    session = items.sparkSession
    if not limits:
        return session.createDataFrame([], PACKED)
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("profile"), F.lit(c).cast("long").alias("capacity")) for p, c in limits)))
    base = items.filter("doc_id is not null").select(F.col("doc_id").cast("long"), F.coalesce("tokens", F.lit(0)).cast("long").alias("size"))
    sized = base.select("doc_id", "size", each.alias("l")).select("doc_id", "size", "l.*").withColumn("full", F.floor((F.col("size") - 1) / F.col("capacity")).cast("int"))
    split = sized.filter("size > capacity")
    name = F.concat_ws("/", "profile", F.lit("full"), F.col("doc_id").cast("string"), F.col("piece").cast("string"))
    whole_bins = split.select("profile", "doc_id", "capacity", F.explode(F.sequence(F.lit(1), "full")).alias("piece")).select(
        "profile", "doc_id", "piece", F.col("capacity").alias("tokens"), name.alias("container"), "capacity", F.lit(1.0).alias("fill"),
        F.lit(False).alias("solved"), F.lit(True).alias("proven"),
    )
    piece = F.when(F.col("size") > F.col("capacity"), F.col("full") + 1).otherwise(0)
    left = F.when(F.col("size") > F.col("capacity"), F.col("size") - F.col("full") * F.col("capacity")).otherwise(F.col("size"))
    todo = sized.select("profile", "doc_id", piece.cast("int").alias("piece"), left.alias("tokens"), "capacity")
    blocks = max(1, -(-base.count() // block_items))

    def solved(x: DataFrame, n: int, round_: int) -> DataFrame:
        block = F.pmod(F.xxhash64("doc_id", "piece", F.lit(round_)), F.lit(n))
        keyed = x.select("profile", "doc_id", "piece", "tokens", "capacity", block.alias("block"), F.lit(round_).alias("round"))
        return keyed.groupBy("profile", "block", "round").applyInPandas(_solve(effort), PACKED)

    first = solved(todo, blocks, 1).persist(StorageLevel.DISK_ONLY)
    again = first.filter(F.col("fill") < loose).select("profile", "doc_id", "piece", "tokens", "capacity")
    # a block of the first round leaves few loose items; even if it left all, eight together stay bounded
    second = solved(again, max(1, blocks // 8), 2)
    return whole_bins.unionByName(first.filter(F.col("fill") >= loose)).unionByName(second)


def containers(packed: DataFrame) -> DataFrame:
    """(profile, containers, tokens, space_left, fill, blocks, blocks_proven): the outcome per profile; a block is one search."""
    per = packed.groupBy("profile", "capacity", "container", "solved", "proven").agg(F.sum("tokens").alias("t"))
    search = F.when(F.col("solved"), F.substring_index("container", "/", -3))
    block = F.concat_ws("/", F.element_at(F.split(search, "/"), 1), F.element_at(F.split(search, "/"), 2))
    return per.withColumn("block", F.when(F.col("solved"), block)).groupBy("profile").agg(
        F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.sum(F.col("capacity") - F.col("t")).alias("space_left"),
        (F.sum("t") / F.sum("capacity")).alias("fill"), F.count_distinct("block").alias("blocks"),
        F.count_distinct(F.when(F.col("proven"), F.col("block"))).alias("blocks_proven"),
    )


def audit(packed: DataFrame, items: DataFrame, least_fill: float = 0.97) -> DataFrame:
    """One row per profile that shows whether the packing keeps its promises.

    items, tokens: what lies in containers. overfull: containers above their capacity. scattered: items that fit one
    container but lie in several, or whose pieces do not add up to them. unsolved: oversized items whose remainder no
    search placed. well_filled: containers but one are filled to `least_fill` on average.
    """
    size = items.filter("doc_id is not null").select("doc_id", F.coalesce("tokens", F.lit(0)).cast("long").alias("size"))
    per_item = packed.groupBy("profile", "capacity", "doc_id").agg(
        F.sum("tokens").alias("t"), F.count("*").alias("n"), F.count(F.when(F.col("solved"), 1)).alias("s")
    ).join(size, "doc_id")
    fits = F.col("size") <= F.col("capacity")
    whole = F.when(fits, 1).otherwise(F.ceil(F.col("size") / F.col("capacity")))
    of_items = per_item.groupBy("profile").agg(
        F.count("*").alias("items"), F.sum("t").cast("long").alias("tokens"),
        F.count(F.when((F.col("n") != whole) | (F.col("t") != F.col("size")), 1)).alias("scattered"),
        F.count(F.when(~fits & (F.col("s") != 1), 1)).alias("unsolved"),
    )
    room = packed.groupBy("profile", "capacity", "container").agg(F.sum("tokens").alias("t"))
    of_room = room.groupBy("profile").agg(
        F.count(F.when(F.col("t") > F.col("capacity"), 1)).alias("overfull"),
        ((F.count("*") - 1) * F.max("capacity") * least_fill <= F.sum("t")).alias("well_filled"),
    )
    return of_items.join(of_room, "profile").select("profile", "items", "tokens", "overfull", "scattered", "unsolved", "well_filled")

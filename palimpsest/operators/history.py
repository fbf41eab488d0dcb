"""History of changing attributes: insert-only satellites with lead-based end dates.

Each (subject, single-valued predicate) is one attribute of a hub entity. Attributes
that change often go to the fast satellite, the others to the slow one. A satellite gets
a row only where the hash of the value changes (or a stated end leaves a gap); nothing
is ever updated. A late row can make that an earlier row opens a version after all, or
does so no longer: then a row with the new state is appended, and the view takes the
newest state of each start. The period of a version ends where the next version of the
group begins, which the view finds with lead. Rows that change nothing stay in the
staging area, the observations loaded so far, against which later batches are ordered;
so any division of the observations into batches gives the same history.

Skew: a group (one subject and predicate) may hold any share of the rows. Groups
above `hot_rows` are cut into consecutive time blocks at approximate quantiles
of their own start times, each block is ordered in a task of its own, and only
the last and first rows of the blocks are carried from one block to the next.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import norm
from palimpsest.session import stored

#: At most so many groups are cut into blocks, the largest first; any other group
#: then has less than that part of all rows.
MAX_HOT_GROUPS = 4096
GROUP = ["hub", "attribute"]


def observations(triples: DataFrame, predicates: DataFrame) -> DataFrame:
    """Usable facts with a single-valued predicate: hub, attribute, value, hash_diff and times.

    Rows whose subject, object, valid_start or predicate is null are left out. Names
    spelled differently are different hubs; case and runs of spaces do not count.
    """
    single = predicates.filter("single_valued").select(norm("predicate").alias("attribute")).distinct()
    facts = triples.select(
        "triple_id", norm("subject").alias("hub"), norm("predicate").alias("attribute"), norm("object").alias("value"),
        "object", "valid_start", "valid_end", "t_tx_start",
    ).filter("hub is not null and value is not null and valid_start is not null and triple_id is not null")
    return facts.join(single, "attribute", "left_semi")


def current_rows(obs: DataFrame) -> DataFrame:
    """One row per group and valid_start: the latest recorded, then the largest triple_id.

    Repeated deliveries of one row fall together here; the maximum combines before the shuffle.
    """
    best = F.max(F.struct("t_tx_start", "triple_id", "value", "object", "valid_end")).alias("r")
    return obs.groupBy(*GROUP, "valid_start").agg(best).select(*GROUP, "valid_start", "r.*", F.md5("r.value").alias("hash_diff"))


def hot_blocks(obs: DataFrame, hot_rows: int, blocks: int) -> DataFrame | None:
    """Start times at which the groups of more than `hot_rows` rows are cut; None without such groups.

    At most MAX_HOT_GROUPS rows of at most `blocks` times each, whatever the input.
    """
    hot = (
        obs.groupBy(*GROUP).count().filter(F.col("count") > hot_rows).orderBy(F.desc("count"), *GROUP).limit(MAX_HOT_GROUPS)
        .select(*GROUP).collect()
    )
    if not hot:
        return None
    hot_df = obs.sparkSession.createDataFrame(hot, "hub string, attribute string")
    cuts = [i / blocks for i in range(1, blocks)]
    return (
        obs.select(*GROUP, F.unix_micros(F.col("valid_start").cast("timestamp")).alias("at"))
        .join(F.broadcast(hot_df), GROUP)
        .groupBy(*GROUP)
        .agg(F.array_distinct(F.percentile_approx("at", cuts, 2000)).alias("cuts"))
    )


def _opens(before: Column) -> Column:
    """Whether a row opens a version, given the row before it."""
    ended = (
        before["valid_end"].isNotNull()
        & (before["valid_end"] > before["valid_start"])
        & (F.col("valid_start") - F.expr("interval 1 millisecond") > before["valid_end"])
    )
    return before.isNull() | (before["hash_diff"] != F.col("hash_diff")) | F.coalesce(ended, F.lit(False))


def _in_blocks(rows: DataFrame, cut: DataFrame | None) -> DataFrame:
    """Adds `block`: the time block of a row in a hot group, -1 in others. The cut points are few and of bounded size."""
    if cut is None:
        return rows.withColumn("block", F.lit(-1))
    at = F.unix_micros(F.col("valid_start").cast("timestamp"))
    block = F.when(F.col("cuts").isNull(), -1).otherwise(F.size(F.filter("cuts", lambda x: x <= at)))
    return rows.join(F.broadcast(cut), GROUP, "left").withColumn("block", block).drop("cuts")


def _neighbour(rows: DataFrame, cut: DataFrame | None, value: Column, name: str, ahead: bool) -> DataFrame:
    """Adds the value of the row before (or ahead) in order of valid_start; hot groups go block by block, only their edges are carried over."""
    step = F.lead if ahead else F.lag
    w = Window.partitionBy(*GROUP, "block").orderBy("valid_start")
    out = rows.withColumn(name, step(value).over(w))
    if cut is None:
        return out
    edge = F.min_by if ahead else F.max_by
    over_blocks = Window.partitionBy(*GROUP).orderBy("block")
    edges = rows.filter("block >= 0").groupBy(*GROUP, "block").agg(edge(value, "valid_start").alias("edge"))
    carried = edges.select(*GROUP, "block", step("edge").over(over_blocks).alias("_carried"))
    return out.join(carried, [*GROUP, "block"], "left").withColumn(name, F.coalesce(name, "_carried")).drop("_carried")


OBSERVED = [*GROUP, "triple_id", "value", "object", "valid_start", "valid_end", "t_tx_start"]
OPENING = ("hash_diff", "valid_start", "valid_end")
VERSION = [*GROUP, "triple_id", "object", "hash_diff", "valid_start", "valid_end", "t_tx_start"]


def marked(rows: DataFrame, cut: DataFrame | None = None) -> DataFrame:
    """Adds `opens`: whether a row opens a version of its group. rows has one row per group and valid_start."""
    x = _neighbour(_in_blocks(rows, cut), cut, F.struct(*OPENING), "before", False)
    return x.withColumn("opens", _opens(F.col("before"))).drop("before", "block")


def closed(versions: DataFrame, cut: DataFrame | None = None) -> DataFrame:
    """Adds closed_by and closed_at, the row that opens the next version of the group and its start; null for the open version."""
    x = _neighbour(_in_blocks(versions.select(*VERSION), cut), cut, F.struct("triple_id", "valid_start"), "next", True)
    return x.select(*VERSION, F.col("next.triple_id").alias("closed_by"), F.col("next.valid_start").alias("closed_at"))


def satellites(obs: DataFrame, hot_rows: int = 20_000, blocks: int = 128) -> DataFrame:
    """The versions of every attribute in one go: one row for each change, with the row that closes it.

    Columns: hub, attribute, triple_id, object, hash_diff, valid_start, valid_end (as
    stated), t_tx_start, closed_by (null for the open version), closed_at.

    Empty input gives an empty result; groups of one row have one open version.
    """
    cut = hot_blocks(obs, hot_rows, blocks)
    return closed(marked(current_rows(obs), cut).filter("opens"), cut)


def append(satellite: DataFrame | None, staged: DataFrame, batch: DataFrame | None, load: int, cut: DataFrame | None = None) -> DataFrame:
    """Rows to append to a satellite for one load: VERSION, opens and load.

    staged holds all observations up to and with this load, batch those of the load (None: all are new). Only groups
    that the batch touches are ordered. A row is appended where it begins to open a version, where the opening row of
    its start is another one now, and (with opens false) where a stored row no longer opens one. Without a
    satellite nothing is stored yet. `cut` are time blocks of hot groups (see hot_blocks), which do not change the result.
    """
    if batch is not None:
        staged = staged.join(batch.select(*GROUP).distinct(), GROUP, "left_semi")
    now = marked(current_rows(staged), cut).select(*VERSION, "opens")
    if satellite is None:
        return now.filter("opens").withColumn("load", F.lit(load))
    known = newest(satellite).select(*GROUP, "valid_start", F.col("triple_id").alias("_id"), F.col("hash_diff").alias("_hash"), F.col("opens").alias("_opens"))
    x = now.join(known, [*GROUP, "valid_start"], "left")
    changed = F.when(F.col("opens"), ~F.coalesce("_opens", F.lit(False)) | (F.col("_id") != F.col("triple_id")) | (F.col("_hash") != F.col("hash_diff"))).otherwise(F.coalesce("_opens", F.lit(False)))
    return x.filter(changed).select(*VERSION, "opens", F.lit(load).alias("load"))


def newest(satellite: DataFrame) -> DataFrame:
    """The state of each group and start after the last load that touched it."""
    state = F.max_by(F.struct("triple_id", "object", "hash_diff", "valid_end", "t_tx_start", "opens"), "load").alias("s")
    return satellite.groupBy(*GROUP, "valid_start").agg(state).select(*GROUP, "valid_start", "s.*")


def view(parts: list[DataFrame], cut: DataFrame | None = None) -> DataFrame:
    """The history over stored satellites: newest states that open a version, each ended by the next one. Columns as in `satellites`."""
    return closed(reduce(DataFrame.unionByName, [newest(p).filter("opens") for p in parts]), cut)


def assign(obs: DataFrame, fast_share: float = 0.5) -> list[str]:
    """Attributes of the fast satellite: those with more than `fast_share` distinct values beyond the first per hub.

    Attributes are predicates, few names whatever the data. What is left is slow.
    """
    values = obs.select(F.xxhash64("hub").alias("hub"), "attribute", F.xxhash64("value").alias("v")).distinct().groupBy("attribute", "hub").agg(F.count("*").alias("n"))
    rate = values.groupBy("attribute").agg(((F.sum("n") - F.count("*")) / F.count("*")).alias("rate"))
    return sorted(r.attribute for r in rate.filter(F.col("rate") > fast_share).select("attribute").limit(100_000).collect())


def load(observed: DataFrame, loads: int, hot_rows: int = 20_000, blocks: int = 128, fast: list[str] | None = None) -> tuple[list[DataFrame], DataFrame | None]:
    """The stored satellites [fast, slow] after loads 0 .. loads - 1, and the time blocks of hot groups.

    observed has the observations with their `load`; they are written to the staging area once. Each load appends to
    both satellites, which are parts of one table. The division of attributes is made by the first load and kept, as
    rows are never moved; what it is does not change the history.
    """
    area = stored(observed.select(*OBSERVED, "load"))
    cut = hot_blocks(area, hot_rows, blocks)
    cut = cut if cut is None else stored(cut)
    fast = assign(area.filter("load = 0")) if fast is None else fast
    part = F.when(F.col("attribute").isin(fast), "fast").otherwise("slow") if fast else F.lit("slow")
    satellite: DataFrame | None = None
    for i in range(loads):
        batch = area.filter(F.col("load") == i) if i else None
        added = stored(append(satellite, area.filter(F.col("load") <= i), batch, i, cut).withColumn("satellite", part), "satellite")
        satellite = added if satellite is None else satellite.unionByName(added)
    return [satellite.filter(F.col("satellite") == p).drop("satellite") for p in ("fast", "slow")], cut


def periods(versions: DataFrame) -> DataFrame:
    """The period in which each version held: until its stated end or the next version, whichever is first.

    A stated end that is not after the start is ignored. valid_to is exclusive, null while open.
    """
    stated = F.when(F.col("valid_end") > F.col("valid_start"), F.col("valid_end"))
    return versions.withColumn("valid_from", F.col("valid_start")).withColumn("valid_to", F.least(stated, "closed_at"))


def change_rates(versions: DataFrame, fast_share: float = 0.5) -> DataFrame:
    """How often each attribute changes, and the satellite it belongs to.

    rate is changes (versions beyond the first) per hub; attributes whose rate is above
    `fast_share` go to the `fast` satellite, the others to `slow`.
    """
    return (
        versions.groupBy("attribute", "hub").agg(F.count("*").alias("n"))
        .groupBy("attribute").agg(F.count("*").alias("hubs"), F.sum("n").alias("versions"))
        .withColumn("rate", F.round((F.col("versions") - F.col("hubs")) / F.col("hubs"), 6))
        .withColumn("satellite", F.when(F.col("rate") > fast_share, "fast").otherwise("slow"))
    )

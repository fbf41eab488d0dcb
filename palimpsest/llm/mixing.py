"""Mixing sources to target weights by iterative proportional fitting.

The records are counted in cells of source, language and topic, a table of bounded size.
Raking scales the weights of the cells in turn to the marginals of topic, language and
source until they agree, with no weight above the repeats a source allows; the source
comes last, so its shares hold exactly unless its records run out. Each record is then
taken as often as its calibrated weight says, the fraction by systematic sampling within
its cell, and the shares reached are reported.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Topics and languages beyond so many, the largest first, are one cell `other` per source; none of their records is left out.
MAX_TOPICS, MAX_LANGUAGES = 1_024, 676
CELL = ["source", "lang", "topic"]


def sized(docs: DataFrame, topic: Column) -> DataFrame:
    """(doc_id, source, lang, topic, tokens): source in lower case and trimmed, lang its first two letters."""
    lang = F.regexp_extract(F.lower(F.trim("lang")), "^([a-z]{2})", 1)
    return docs.filter("doc_id is not null").select(
        "doc_id", F.lower(F.trim("source")).alias("source"), F.when(F.length(lang) == 2, lang).otherwise("none").alias("lang"),
        F.coalesce(topic, F.lit("none")).alias("topic"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("tokens"),
    )


def rake(tokens: np.ndarray, cells: np.ndarray, margins: list[np.ndarray], caps: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Weights of the cells. tokens: size of each; cells: its index in each dimension, source last; margins: sizes to reach.

    caps bounds each cell's weight. Converges when all margins can be met; otherwise the last
    dimension is met as far as the caps allow and the others as well as that leaves room for.
    """
    w = np.minimum(np.ones(len(tokens)), caps)
    for _ in range(rounds):
        before = w.copy()
        for d, target in enumerate(margins):
            w = _scaled(w, tokens, cells[:, d], target, caps)
        if np.max(np.abs(w - before), initial=0.0) < 1e-10:
            break
    return w


def _scaled(w: np.ndarray, tokens: np.ndarray, group: np.ndarray, target: np.ndarray, caps: np.ndarray) -> np.ndarray:
    """One step: scale each group to its target; what a cap cuts off is given to the others of the group."""
    w = np.where((w <= 0) & (tokens > 0), 1e-9, w)
    for _ in range(50):
        full = w >= caps
        held = np.bincount(group, np.where(full, w * tokens, 0), len(target))
        free = np.bincount(group, np.where(full, 0, w * tokens), len(target))
        with np.errstate(divide="ignore", invalid="ignore"):
            f = np.where(free > 0, np.maximum(target - held, 0) / free, 1.0)
        over = (held > target) & (held > 0)
        scaled = np.where(over[group], w * np.where(held > 0, target / np.maximum(held, 1e-300), 1)[group], np.where(full, w, w * f[group]))
        new = np.minimum(scaled, caps)
        if np.allclose(new, w, rtol=1e-12, atol=0):
            return new
        w = new
    return w


def _wanted(targets: DataFrame) -> dict[str, list[float]]:
    """Share and repeats per source in lower case; a table of bounded size."""
    want: dict[str, list[float]] = {}
    for r in targets.select(F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats").collect():
        if r.source is not None and r.target_share is not None and r.max_repeats is not None:
            have = want.setdefault(r.source, [0.0, 0])
            have[0] += float(r.target_share)
            have[1] = max(have[1], int(r.max_repeats))
    return want


def _margin(names: list[str], index: np.ndarray, tokens: np.ndarray, shares: dict[str, float] | None) -> np.ndarray:
    """Sizes to reach in one dimension: the shares asked for, what is not named sharing the rest as at hand; else those at hand."""
    own = np.bincount(index, tokens, len(names)) if names else np.zeros(0)
    if not shares:
        return own
    named = np.array([x in shares for x in names])
    rest = max(0.0, 1.0 - sum(shares.get(x, 0.0) for x in names)) * tokens.sum()
    left = own[~named].sum()
    return np.where(named, [shares.get(x, 0.0) * tokens.sum() for x in names], own * (rest / left if left else 0.0))


def cells_of(docs: DataFrame, sources: list[str]) -> DataFrame:
    """(source, lang, topic, tokens, records): one scan; topics and languages beyond the largest are pooled afterwards."""
    return docs.filter(F.col("source").isin(sources)).groupBy(*CELL).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("records"))


def calibrate(docs: DataFrame, targets: DataFrame, rounds: int = 200, lang_shares: dict[str, float] | None = None, topic_shares: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """Weights per cell (source, lang, topic, weight, cap, records) and the plan per source.

    The plan has source, target_share, max_repeats, tokens, target_tokens and planned_tokens. The margins of language
    and topic are the shares asked for, or those of the records at hand. Targets without a source, share or repeats
    are left out; sources written twice are summed up with the larger repeats.
    """
    session = docs.sparkSession
    want = _wanted(targets)
    sources = sorted(want)
    cells = cells_of(docs, sources).persist()
    for c, n in (("topic", MAX_TOPICS), ("lang", MAX_LANGUAGES)):
        kept = [r[0] for r in cells.groupBy(c).agg(F.sum("tokens").alias("t")).orderBy(F.desc("t"), c).limit(n + 1).collect()]
        if len(kept) > n:
            cells = cells.withColumn(c, F.when(F.col(c).isin(kept[:n]), F.col(c)).otherwise("other"))
    table = cells.groupBy(*CELL).agg(F.sum("tokens").alias("tokens"), F.sum("records").alias("records")).orderBy(*CELL).toPandas()
    tokens = table["tokens"].to_numpy(dtype=float)
    total = float(tokens.sum())
    index, margins = [], []
    for c, shares in (("topic", topic_shares), ("lang", lang_shares)):
        names = sorted(set(table[c]))
        index.append(table[c].map({x: i for i, x in enumerate(names)}).to_numpy(dtype=int))
        margins.append(_margin(names, index[-1], tokens, shares))
    index.append(table["source"].map({x: i for i, x in enumerate(sources)}).to_numpy(dtype=int))
    margins.append(np.array([want[s][0] * total for s in sources]))
    caps = np.array([want[s][1] for s in table["source"]], dtype=float)
    weights = rake(tokens, np.column_stack(index), margins, caps, rounds) if len(table) else np.zeros(0)
    schema = "source string, lang string, topic string, weight double, cap int, records long"
    rows = [(*k, float(x), int(m), int(n)) for *k, x, m, n in zip(table["source"], table["lang"], table["topic"], weights, caps, table["records"])]
    own = np.bincount(index[-1], tokens, len(sources)) if len(table) else np.zeros(len(sources))
    planned = np.bincount(index[-1], tokens * weights, len(sources)) if len(table) else np.zeros(len(sources))
    plan = [(s, want[s][0], want[s][1], int(own[i]), want[s][0] * total, float(planned[i])) for i, s in enumerate(sources)]
    plan_schema = "source string, target_share double, max_repeats int, tokens long, target_tokens double, planned_tokens double"
    cells.unpersist()
    return session.createDataFrame(rows, schema), session.createDataFrame(plan, plan_schema)


def sample(docs: DataFrame, weights: DataFrame, block_records: int = 20_000) -> DataFrame:
    """(doc_id, source, tokens, repeats): how often each record is used, repeats 0 included.

    weights is a table of cells of bounded size. A source's records are dealt to blocks by
    hash, so a source that holds most records is no single task; within a block they are
    ordered by size and every place where the sum of fractions passes a whole number takes
    one, so each part of the range of sizes is met and the tokens come close to the plan.
    """
    topics, langs = [r[0] for r in weights.select("topic").distinct().collect()], [r[0] for r in weights.select("lang").distinct().collect()]
    in_source = F.sum("records").over(Window.partitionBy("source")).alias("in_source")
    keyed = docs.withColumns({
        "topic": F.when(F.col("topic").isin(topics), F.col("topic")).otherwise("other"),
        "lang": F.when(F.col("lang").isin(langs), F.col("lang")).otherwise("other"),
    }).join(F.broadcast(weights.select(*CELL, "weight", in_source)), CELL)
    block = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("in_source") / block_records))
    w = Window.partitionBy("source", "block").orderBy("tokens", "doc_id")
    start = F.pmod(F.xxhash64("source", "block"), F.lit(1_000_003)) / 1_000_003.0
    x = keyed.withColumn("block", block).withColumn("part", F.col("weight") - F.floor("weight"))
    x = x.withColumn("upto", F.sum("part").over(w) + start)
    taken = F.floor(F.col("weight")) + F.floor(F.col("upto")) - F.floor(F.col("upto") - F.col("part"))
    return x.select("doc_id", "source", "tokens", F.least(taken, F.ceil("weight")).cast("int").alias("repeats"))


def report(plan: DataFrame, taken: DataFrame) -> DataFrame:
    """The plan with used_tokens, used_records, least_repeats, most_repeats, short and the shares reached per source.

    A source is short if its calibrated weights stay below its target and the sample drawn by them uses each of its
    records with tokens as often as it may: it has run out. A source without records is short, too. share_of_all is
    measured against the tokens of all sources, which the targets are shares of; share_of_mix against the tokens used,
    which are fewer where sources run out.
    """
    used = taken.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("repeats")).alias("used_tokens"), F.count(F.when(F.col("repeats") > 0, 1)).alias("used_records"), F.max("repeats").alias("most_repeats"),
        F.min(F.when(F.col("tokens") > 0, F.col("repeats"))).alias("least_repeats"),
    )
    x = plan.join(used, "source", "left").fillna(0, ["used_tokens", "used_records", "most_repeats"])
    below = (F.col("target_share") > 0) & (F.col("planned_tokens") < F.col("target_tokens") - F.greatest(F.lit(1e-6), F.col("target_tokens") * 1e-12))
    x = x.withColumn("short", below & (F.coalesce("least_repeats", "max_repeats") >= F.col("max_repeats")))
    everything = F.sum("used_tokens").over(Window.partitionBy())
    available = F.sum("tokens").over(Window.partitionBy())
    share = lambda whole: F.when(whole > 0, F.col("used_tokens") / whole).otherwise(0.0)
    return x.withColumn("share_of_all", share(available)).withColumn("share_of_mix", share(everything))


def audit(report: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """One row per source that shows whether the mix keeps its promises.

    over_repeats: records used more often than allowed (as a yes or no). on_target: a source that did not run out
    reached its share of all tokens within `tolerance`, one that did gave all its tokens as often as allowed.
    """
    near = F.abs(F.col("share_of_all") - F.col("target_share")) <= tolerance
    spent = F.col("used_tokens") == F.col("tokens") * F.col("max_repeats")
    return report.select("source", "tokens", (F.col("most_repeats") > F.col("max_repeats")).alias("over_repeats"), F.when(F.col("short"), spent).otherwise(near).alias("on_target"), "short")


def mix(docs: DataFrame, targets: DataFrame, topic: Column | None = None, **shares: dict[str, float]) -> tuple[DataFrame, DataFrame]:
    """Records with their repeats, and the report per source of `targets`.

    docs has doc_id, text, source and lang; a token is one byte of UTF-8. Records of other or no
    source are not used. lang_shares and topic_shares set target shares of these dimensions. Empty tables give an
    empty mix in which no source is short, as there is nothing to share.
    """
    x = sized(docs, topic if topic is not None else F.lit(None).cast("string"))
    weights, plan = calibrate(x, targets, **shares)
    taken = sample(x, weights)
    return taken, report(plan, taken)

"""Near-duplicate records by a token-group matrix.

Records with the same set of terms are one class; classes that agree in several min-hashes
are put into groups of bounded size. The matrix has a row per group: the union of the terms
of its members, and the least and largest size of a member. What a query class has of the
union bounds what it can share with any member, so groups that hold too little of it are
never opened. The bound is taken in two steps: first on 256 bits, to which the columns of
the matrix are hashed, then on the union itself.

A pair is looked for from its larger side, among groups with members no larger. With a
shared order of terms from rare to common, the larger class and the union of the groups'
members then share two terms among the first few of each (see `lookup_keys`): the columns
of the matrix are read only there, a rare one alone, common ones in pairs. Opened groups
are compared by whole term sets in integers; no estimate decides, and no pair is lost.

Disk is bounded by doing one step at a time: each writes its rows densely and deletes its
shuffle files and the tables that no later step reads. The matrix is read in ROUNDS parts of
its columns. Whole term sets move only for groups with a member that passes on its bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import distinct_terms
from palimpsest.llm.termfreq import records
from palimpsest.session import dropped, staged

#: Buckets of the term-frequency sketch that fixes the order of terms; its size never grows with the data.
SKETCH_BUCKETS = 1 << 18
#: A term in more classes than this, or than CROWDED times the mean of all buckets, is common and looked up only together with a second one.
COMMON, CROWDED = 512, 4
#: Sets of more terms are looked up by single terms, as their pairs would be too many.
LONG_SET = 384
#: 64-bit words of a row of the matrix.
ROW_WORDS = 4
#: Odd factors of the min-hashes in which the classes of a group agree.
MIN_HASHES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)
BITS = [f"b{i}" for i in range(ROW_WORDS)]
#: Keys that more than this many classes share are spread over several tasks; at most so many such keys.
HOT_KEY, MAX_HOT_KEYS, SALTS = 2_000, 4_096, 16
#: Parts of the columns that are looked up one after the other.
ROUNDS = 8


def classes(recs: DataFrame, min_terms: int) -> tuple[DataFrame, DataFrame]:
    """(class_id, n, hs) per distinct term set of at least `min_terms`, and membership (class_id, id)."""
    hs = F.array_sort(F.transform(distinct_terms("text"), lambda t: F.xxhash64(t)))
    sets = recs.select("id", hs.alias("hs")).filter(F.size("hs") >= min_terms)
    keyed = staged(sets.withColumn("k1", F.xxhash64("hs")).withColumn("k2", F.hash("hs")))
    first = keyed.groupBy("k1", "k2").agg(F.min("id").alias("class_id"))
    members = staged(keyed.select("id", "k1", "k2").join(first, ["k1", "k2"]).select("class_id", "id"))
    own = members.filter("id = class_id").select("id")
    one = staged(keyed.join(own, "id", "left_semi").select(F.col("id").alias("class_id"), F.size("hs").alias("n"), "hs"))
    dropped(keyed)
    return one, members


def _sketch(sets: DataFrame) -> np.ndarray:
    """How many classes hold a term of each bucket: SKETCH_BUCKETS numbers, whatever the data."""
    bucket = F.pmod("h", F.lit(SKETCH_BUCKETS)).cast("int").alias("b")
    held = staged(sets.select(F.explode("hs").alias("h")).groupBy(bucket).agg(F.count("*").alias("c")))
    rows = held.toPandas()
    dropped(held)
    counts = np.zeros(SKETCH_BUCKETS, dtype=np.int64)
    counts[rows["b"].to_numpy()] = rows["c"].to_numpy()
    return counts


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing step for min-hashes."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _least_shared(n: int, percent: int) -> int:
    """Terms that a set of n terms shares at least with a similar set that is no smaller: half the least sum of both, by similarity."""
    return -(-2 * percent * n // (100 + percent))


@lru_cache(maxsize=4096)
def _pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def _keys(ordered: np.ndarray, common: np.ndarray, shared: int, single: bool, paired: bool) -> np.ndarray:
    n, keys = len(ordered), []
    if paired:
        head = ordered[: n - shared + 2]
        often = common[: len(head)]
        pairs = head[often].view(np.uint64)
        i, j = _pairs(len(pairs))
        keys += [head[~often], _mix(_mix(pairs[i]) + pairs[j]).view(np.int64)]
    if single:
        keys.append(ordered[: n - shared + 1])
    return np.concatenate(keys) if not (single and paired) else np.unique(np.concatenate(keys))


def lookup_keys(ordered: np.ndarray, common: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(asked, listed): keys of a set, whose terms come from rare to common, as the larger and as the smaller one of a pair.

    Two sets that share s terms have l of them among all but s - l of each in the common order. The larger set of a pair
    shares at least `percent` % of its own terms, the smaller one more of its own, so it lists few. With l = 2 both
    terms are in both heads: a rare one is a key by itself, two common ones are a key together. Pairs with a set of more
    than LONG_SET terms go by single terms, l = 1, as their pairs would be too many. Keys are cut to 32 bits: where two
    fall together, a group more is looked at.
    """
    n = len(ordered)
    asked = _keys(ordered, common, -(-n * percent // 100), n > LONG_SET, n <= LONG_SET)
    listed = _keys(ordered, common, _least_shared(n, percent), n * 100 // percent >= LONG_SET, n <= LONG_SET)
    return asked.astype(np.int32), listed.astype(np.int32)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(k) for k in parts])])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(parts), pa.int32()))


def shaped(sets: DataFrame, percent: int) -> DataFrame:
    """Adds `asked` and `listed` (see lookup_keys), the columns of the set in a row of bits, and `seed`, under which similar sets meet."""
    counts = _sketch(sets)
    sketch = sets.sparkSession.sparkContext.broadcast(counts)
    often = max(COMMON, CROWDED * int(counts.mean()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for b in batches:
            if not b.num_rows:
                continue
            hs = b.column("hs")
            terms = hs.flatten().to_numpy()
            lens = pc.list_value_length(hs).to_numpy().astype(np.int64)
            starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
            row = np.repeat(np.arange(len(lens)), lens)
            order = np.lexsort((terms, counts[terms % SKETCH_BUCKETS], row))
            ordered = terms[order]
            common = counts[ordered % SKETCH_BUCKETS] > often
            keys = [lookup_keys(ordered[s : s + n], common[s : s + n], percent) for s, n in zip(starts, lens)]
            mixed = _mix(terms.view(np.uint64))
            column = (mixed % np.uint64(64 * ROW_WORDS)).astype(np.int64)
            bits = np.zeros((len(lens), ROW_WORDS), dtype=np.uint64)
            np.bitwise_or.at(bits, (row, column // 64), np.uint64(1) << (column % 64).astype(np.uint64))
            # min-hashes of the rare terms alone: the common ones make strangers alike
            at = np.arange(len(terms)) - np.repeat(starts, lens)
            rare = lens - -(-lens * percent // 100) + 1
            head = ordered[at < np.repeat(rare, lens)].view(np.uint64)
            heads = np.concatenate([[0], np.cumsum(rare)[:-1]])
            seed = np.floor(2 * np.log2(lens)).astype(np.uint64)
            for factor in MIN_HASHES:
                seed = _mix(seed + np.minimum.reduceat(_mix(head * np.uint64(factor)), heads))
            yield pa.RecordBatch.from_arrays(
                [b.column("class_id"), b.column("n"), hs, _lists([k[0] for k in keys]), _lists([k[1] for k in keys]), pa.array(seed.view(np.int64)),
                 *(pa.array(bits[:, i].view(np.int64)) for i in range(ROW_WORDS))],
                ["class_id", "n", "hs", "asked", "listed", "seed", *BITS],
            )

    schema = "class_id long, n int, hs array<long>, asked array<int>, listed array<int>, seed long, " + ", ".join(f"{c} long" for c in BITS)
    return sets.select("class_id", "n", "hs").mapInArrow(run, schema)


def grouped(sets: DataFrame, group_size: int) -> DataFrame:
    """Adds `g`: classes of one seed share a group; a seed above `group_size` is split by hash."""
    sizes = sets.groupBy("seed").agg(F.count("*").alias("in_seed"))
    salted = sets.join(sizes.filter(F.col("in_seed") > group_size), "seed", "left")
    salt = F.pmod(F.xxhash64("class_id"), F.ceil(F.coalesce("in_seed", F.lit(1)) * 2 / group_size))
    return salted.withColumn("g", F.xxhash64("seed", salt)).drop("seed", "in_seed")


def similar_classes(shapes: DataFrame, percent: int = 75, group_size: int = 16) -> DataFrame:
    """(class_a, class_b, shared, united): pairs of classes, class_a < class_b, that share at least `percent` % of their terms.

    `shapes` is a `staged` table of what `shaped` gives; it is deleted when it has been read.
    """
    matrix = staged(grouped(shapes.select("class_id", "n", "listed", "seed", *BITS), group_size).groupBy("g").agg(
        F.array_distinct(F.flatten(F.collect_list("listed"))).alias("listed"), F.min("n").alias("n_min"), F.max("n").alias("n_max"),
        *(F.expr(f"bit_or({c})").alias(f"u{c}") for c in BITS),
    ))
    bits = staged(grouped(shapes.select("class_id", "n", "seed", *BITS), group_size).select("g", F.col("class_id").alias("member"), "n", *BITS))
    # keys of many classes, found in every sixteenth class, are dealt out; what is found does not depend on it
    seen = shapes.filter(F.pmod(F.xxhash64("class_id"), F.lit(16)) == 0).select(F.explode("asked").alias("h")).groupBy("h").count()
    hot = staged(seen.filter(F.col("count") > HOT_KEY // 16).orderBy(F.desc("count"), "h").limit(MAX_HOT_KEYS).select("h", F.lit(True).alias("hot")))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("class_id"), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    lone = lambda a, b: reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}{c}").bitwiseAND(F.bitwise_not(F.col(f"{b}{c}")))) for c in BITS])
    # of n terms and m or more on the other side, a similar pair shares percent / (100 + percent) of the sum
    enough = lambda have, n, m: have * (100 + percent) >= (n + m) * percent
    least = lambda n: F.greatest(F.col("n_min"), F.ceil(F.col(n) * percent / 100).cast("int"))
    sizes = (F.col("n_min") <= F.col("n")) & (F.col("n_max") * 100 >= F.col("n") * percent)
    near = []
    for part in range(ROUNDS):
        here = F.pmod("h", F.lit(ROUNDS)) == part
        asked = shapes.select("class_id", "n", *BITS, F.explode("asked").alias("h")).filter(here).join(F.broadcast(hot), "h", "left").withColumn("salt", salt).drop("hot")
        rows = matrix.select("g", "n_min", "n_max", *(f"u{c}" for c in BITS), F.explode("listed").alias("h")).filter(here)
        rows = rows.join(F.broadcast(hot), "h", "left").withColumn("salt", F.explode(salts)).drop("hot")
        met = asked.join(rows, ["h", "salt"]).filter(sizes & enough(F.col("n") - lone("", "u"), F.col("n"), least("n")))
        met = met.dropDuplicates(["class_id", "g"]).select("class_id", "g", F.col("n").alias("qn"), *(F.col(c).alias(f"q{c}") for c in BITS))
        # a group is opened only for members that pass on their own bits
        m = met.join(bits, "g").filter(
            ((F.col("n") < F.col("qn")) | ((F.col("n") == F.col("qn")) & (F.col("member") < F.col("class_id")))) & (F.col("n") * 100 >= F.col("qn") * percent)
            & enough(F.col("qn") - lone("q", ""), F.col("qn"), F.col("n")) & enough(F.col("n") - lone("", "q"), F.col("qn"), F.col("n"))
        )
        near.append(staged(m.select("class_id", "g", "member")))
    dropped(matrix, hot, bits)
    docs = staged(grouped(shapes.drop("asked", "listed"), group_size))
    dropped(shapes)
    wanted = staged(reduce(DataFrame.unionByName, near).groupBy("class_id", "g").agg(F.collect_set("member").alias("wanted")))
    dropped(*near)
    pairs = staged(wanted.join(docs.select("class_id", F.col("n").alias("qn"), F.col("hs").alias("qs")), "class_id"))
    # the bound on the token union of the group; that of a single member is the member, which is compared below
    groups = docs.join(wanted.select("g").distinct(), "g", "left_semi").groupBy("g").agg(
        F.min("n").alias("n_min"), F.collect_list(F.struct(F.col("class_id").alias("member"), "n", "hs")).alias("held")
    )
    union = F.array_distinct(F.flatten("held.hs"))
    opened = pairs.join(groups, "g").filter((F.size("held") == 1) | enough(F.size(F.array_intersect("qs", union)), F.col("qn"), least("qn")))
    m = opened.select("class_id", "qn", "qs", F.explode(F.filter("held", lambda x: F.array_contains("wanted", x["member"]))).alias("x"))
    m = m.select("class_id", "qn", "x.member", "x.n", F.size(F.array_intersect("qs", "x.hs")).alias("shared"))
    m = m.withColumn("united", F.col("qn") + F.col("n") - F.col("shared"))
    both = F.least("class_id", "member").alias("class_a"), F.greatest("class_id", "member").alias("class_b")
    found = staged(m.filter(F.col("shared") * 100 >= F.col("united") * percent).select(*both, "shared", "united"))
    dropped(docs, wanted, pairs)
    return found


def near_duplicates(episodes: DataFrame, percent: int = 75, min_terms: int = 12, group_size: int = 16) -> tuple[DataFrame, DataFrame]:
    """Pairs of class representatives and the membership of records in classes.

    Records with fewer than `min_terms` distinct terms belong to no class; so do null,
    empty and sign-only texts. An id that comes twice counts once.
    """
    sets, members = classes(records(episodes), min_terms)
    shapes = staged(shaped(sets, percent))
    dropped(sets)
    return similar_classes(shapes, percent, group_size), members


def record_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of classes written out for their members, with those inside a class."""
    a = members.select(F.col("class_id").alias("class_a"), F.col("id").alias("x"))
    b = members.select(F.col("class_id").alias("class_b"), F.col("id").alias("y"))
    across = pairs.join(a, "class_a").join(b, "class_b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    inside = a.join(b, F.col("class_a") == F.col("class_b")).filter("x < y").select(F.col("x").alias("id_a"), F.col("y").alias("id_b"))
    return across.unionByName(inside)


def duplicate_counts(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id, class_id, links): one row per record, with the number of other classes and copies it is linked to."""
    both = pairs.select(F.col("class_a").alias("class_id")).unionByName(pairs.select(F.col("class_b").alias("class_id")))
    links = both.groupBy("class_id").agg(F.count("*").alias("linked"))
    size = members.groupBy("class_id").agg(F.count("*").alias("copies"))
    x = members.join(size, "class_id").join(links, "class_id", "left")
    return x.select("id", "class_id", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("links"))

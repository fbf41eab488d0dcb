"""Binary hypervectors: columns of type array<bigint>, words of 60 bits.

Word i of a name is the first 60 bits of md5(name:i), so SQL engines and Python agree on
every bit. The algebra on columns stays in the JVM. What handles very many bits (majority
over the tokens of a text, brute scans) has an Arrow form that works on whole batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.postings import least as _least

#: Bits of a word, and words of a full-width vector (8,220 bits).
WORD_BITS, FULL_WORDS = 60, 137


def from_name(name: Column | str, words: int = FULL_WORDS) -> Column:
    """The vector of a name. A null name gives null."""
    name = F.col(name) if isinstance(name, str) else name
    word = lambda i: F.conv(F.substring(F.md5(F.concat(name, F.lit(":"), i.cast("string"))), 1, 15), 16, 10).cast("long")
    return F.when(name.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(words - 1)), word))


def zero(words: int = FULL_WORDS) -> Column:
    """The vector without any set bit."""
    return F.array_repeat(F.lit(0).cast("long"), words)


def from_words(values: list[int]) -> Column:
    """A literal vector from its words."""
    return F.array(*(F.lit(v).cast("long") for v in values))


def bind(a: Column, b: Column) -> Column:
    """Exclusive or, word by word: commutative and its own inverse."""
    return F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))


subtract = bind


def ema(old: Column, new: Column) -> Column:
    """Moving average at weight one half: with ties kept it sets every bit that either has."""
    return F.zip_with(old, new, lambda x, y: x.bitwiseOR(y))


def popcount(a: Column) -> Column:
    """Number of set bits."""
    return F.aggregate(F.transform(a, lambda x: F.bit_count(x).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def hamming(a: Column, b: Column) -> Column:
    """Number of differing bits."""
    return popcount(bind(a, b))


def similarity(a: Column, b: Column, words: int = FULL_WORDS) -> Column:
    """1 - hamming / width."""
    return 1.0 - hamming(a, b) / F.lit(float(words * WORD_BITS))


def phi(pop_a: Column, pop_b: Column, distance: Column, words: int = FULL_WORDS) -> Column:
    """Correlation of two vectors corrected for their densities; 0 if either is all zero or all one."""
    n = float(words * WORD_BITS)
    both = (pop_a + pop_b - distance) / 2.0
    spread = pop_a.cast("double") * (n - pop_a) * pop_b * (n - pop_b)
    return F.when(spread <= 0, F.lit(0.0)).otherwise((n * both - pop_a.cast("double") * pop_b) / F.sqrt(spread))


def bundle3(a: Column, b: Column, c: Column) -> Column:
    """Majority of three vectors."""
    ab = F.zip_with(a, b, lambda x, y: F.struct(x.bitwiseAND(y).alias("both"), x.bitwiseOR(y).alias("any")))
    return F.zip_with(ab, c, lambda p, z: p["both"].bitwiseOR(p["any"].bitwiseAND(z)))


def active_dims(a: Column, words: int = FULL_WORDS) -> Column:
    """Ascending indices of the set bits."""
    index = F.sequence(F.lit(0), F.lit(words * WORD_BITS - 1))
    word = lambda i: F.element_at(a, (F.floor(i / WORD_BITS) + 1).cast("int"))
    return F.filter(index, lambda i: F.getbit(word(i), F.pmod(i, F.lit(WORD_BITS))) == 1)


def majority(df: DataFrame, keys: list[str], vector: str, words: int) -> DataFrame:
    """Strict majority per bit over the vectors of each group, in plain aggregates: keys, n, vector.

    2 * tally > n sets a bit; one member is itself. Tallies are combined before the shuffle.
    Null vectors are left out. Meant for few words; see `bundle_groups` for full width.
    """
    width = words * WORD_BITS
    bits = df.filter(F.col(vector).isNotNull()).select(*keys, vector, F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("bit"))
    word = F.element_at(vector, (F.floor(F.col("bit") / WORD_BITS) + 1).cast("int"))
    at = F.pmod("bit", F.lit(WORD_BITS))
    tally = bits.groupBy(*keys, "bit").agg(F.sum(F.getbit(word, at).cast("long")).alias("t"), F.count("*").alias("n"))
    w, power = F.floor(F.col("bit") / WORD_BITS), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("bit", F.lit(WORD_BITS)).cast("int"))
    per_word = tally.groupBy(*keys, w.alias("w")).agg(
        F.sum(F.when(F.col("t") * 2 > F.col("n"), power).otherwise(0)).alias("v"), F.max("n").alias("n")
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("w", "v"))), lambda x: x["v"])
    return per_word.groupBy(*keys).agg(F.max("n").alias("n"), ordered.alias(vector))


@lru_cache(maxsize=8_192)  # 1 KB each at full width
def _name_packed(name: str, words: int) -> np.ndarray:
    values = [int(hashlib.md5(f"{name}:{i}".encode()).hexdigest()[:15], 16) for i in range(words)]
    return np.packbits(((np.array(values, dtype=np.int64)[:, None] >> np.arange(WORD_BITS)) & 1).astype(np.uint8).ravel())


def name_bits(name: str, words: int) -> np.ndarray:
    """The bits of a name's vector as 0 and 1, in Python."""
    return np.unpackbits(_name_packed(name, words), count=words * WORD_BITS)


def pack_bits(bits: np.ndarray) -> np.ndarray:
    """Words of a 0/1 array."""
    return (bits.reshape(-1, WORD_BITS).astype(np.int64) << np.arange(WORD_BITS)).sum(axis=1)


def token_bundle(words: int = FULL_WORDS):
    """Arrow UDF array<string> -> array<bigint>: majority over the tokens' vectors, repeats counting; zero without tokens."""

    @F.pandas_udf("array<bigint>")
    def bundle(tokens: pd.Series) -> pd.Series:
        def one(ts) -> np.ndarray:
            if ts is None or not len(ts):
                return np.zeros(words, dtype=np.int64)
            tally = np.zeros(words * WORD_BITS, dtype=np.uint16 if len(ts) < 1 << 16 else np.int64)
            for t in ts:
                tally += name_bits(t, words)
            return pack_bits(tally > len(ts) // 2)

        return tokens.map(one)

    return bundle


def bundle_groups(df: DataFrame, key: str, vector: str, words: int = FULL_WORDS) -> DataFrame:
    """Strict majority of full-width vectors per long key: (key, n, vector).

    Each task first adds up its own rows, so a key of any size sends one row of tallies per
    task; the few tallies of a key are then added in one place.
    """
    width = words * WORD_BITS

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                have = sums.setdefault(k, [0, np.zeros(width, dtype=np.int64)])
                have[0] += 1
                have[1] += ((np.array(v, dtype=np.int64)[:, None] >> np.arange(WORD_BITS)) & 1).ravel()
            if len(sums) > 256:
                yield flush(sums)
        if sums:
            yield flush(sums)

    def flush(sums: dict[int, list]) -> pa.RecordBatch:
        out = pa.RecordBatch.from_pydict({"k": pa.array(list(sums), pa.int64()), "n": [v[0] for v in sums.values()], "t": [v[1].tobytes() for v in sums.values()]})
        sums.clear()
        return out

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].sum())
        tally = sum(np.frombuffer(t, dtype=np.int64) for t in pdf["t"])
        return pd.DataFrame({"k": [int(pdf["k"].iloc[0])], "n": [n], "v": [pack_bits(2 * tally > n)]})

    rows = df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v"))
    part = rows.mapInArrow(partial, "k long, n long, t binary")
    return part.groupBy("k").applyInPandas(total, "k long, n long, v array<bigint>").select(F.col("k").alias(key), "n", F.col("v").alias(vector))


def nearest(queries: DataFrame, stored: DataFrame, k: int, words: int = FULL_WORDS, block: int = 1_024, rows_at_once: int = 4_096) -> DataFrame:
    """The k stored vectors of least distance to each query, ties to the smaller id: (query_id, id, distance).

    queries (query_id, hv) is walked in blocks, each broadcast by itself and so of bounded size; the stored side (id, hv) is
    read once per block and never moved. Each batch keeps its own k best of a query, so the pairs never leave the task
    that compares them.
    """
    session = stored.sparkSession
    schema = "query_id long, id long, distance long"
    out = session.createDataFrame([], schema)
    asked = queries.select("query_id", "hv").toLocalIterator()
    while taken := list(islice(asked, block)):
        sent = session.sparkContext.broadcast((np.array([r.query_id for r in taken], dtype=np.int64), np.array([r.hv for r in taken], dtype=np.int64)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            qid, q = sent.value
            to = _distances(q)
            for b in batches:
                own = b.column("id").to_numpy()
                s = b.column("hv").flatten().to_numpy().reshape(-1, words)
                for at in range(0, len(own), rows_at_once):
                    ids, d = own[at : at + rows_at_once], to(s[at : at + rows_at_once])
                    best = [_least(x, ids, min(k, len(x))) for x in d]
                    yield pa.RecordBatch.from_pydict({
                        "query_id": np.repeat(qid, [len(x) for x in best]), "id": ids[np.concatenate(best)],
                        "distance": np.concatenate([d[i, x] for i, x in enumerate(best)]).astype(np.int64),
                    })

        out = out.unionByName(stored.filter("id is not null and hv is not null").select("id", "hv").mapInArrow(run, schema))
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return out.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def _blocks(queries: DataFrame, columns: list[str], block: int) -> Iterator[dict[str, np.ndarray]]:
    """A stated query set in blocks of bounded size: its columns as arrays, missing numbers as NaN."""
    asked = queries.select(*columns).toLocalIterator()
    while taken := list(islice(asked, block)):
        out = {c: np.array([np.nan if r[c] is None else r[c] for r in taken], dtype=float) for c in columns if c not in ("query_id", "hv")}
        yield out | {"query_id": np.array([r.query_id for r in taken], dtype=np.int64), "hv": np.array([r.hv for r in taken], dtype=np.int64)}


def _distances(q: np.ndarray, rows_at_once: int = 512) -> Callable[[np.ndarray], np.ndarray]:
    """A function of stored vectors that gives their distances to all of q, by matrix products of bits.

    Two queries go through one product: as sums of at most 4,095 bits, one is told in units and the other in units of 4,096, and
    both together stay below 2^24, up to which single precision holds every whole number. The distances are exact in any order of the sum.
    """
    bits = lambda v: np.unpackbits(np.ascontiguousarray(v).view(np.uint8).reshape(len(v), 8 * v.shape[1]), axis=1, bitorder="little")
    width, half = q.shape[1] * 64, -(-len(q) // 2)
    edges = np.linspace(0, width, -(-width // 4_095) + 1).astype(int)
    pairs = np.zeros((half, width), dtype=np.float32)
    for at in range(0, half, 256):
        pairs[at : at + 256] = bits(q[:half][at : at + 256])
        pairs[at : at + 256][: max(0, len(q) - half - at)] += 4_096 * bits(q[half:][at : at + 256]).astype(np.float32)
    own = np.bitwise_count(q).sum(axis=1, dtype=np.int32)

    def to(s: np.ndarray) -> np.ndarray:
        d = np.empty((len(q), len(s)), dtype=np.int32)
        for at in range(0, len(s), rows_at_once):
            part = s[at : at + rows_at_once]
            theirs, low, high = bits(part), np.zeros((half, len(part)), dtype=np.int32), np.zeros((half, len(part)), dtype=np.int32)
            for a, b in zip(edges, edges[1:]):
                both = (pairs[:, a:b] @ theirs[:, a:b].astype(np.float32).T).astype(np.int32)
                high += both >> 12
                low += both & 4_095
            many = own[:, None] + np.bitwise_count(part).sum(axis=1, dtype=np.int32)[None, :]
            d[:half, at : at + rows_at_once] = many[:half] - 2 * low
            d[half:, at : at + rows_at_once] = many[half:] - 2 * high[: len(q) - half]
        return d

    return to


def ranked(queries: DataFrame, stored: DataFrame, k: int, words: int = FULL_WORDS, by_phi: bool = False, floor: float | None = None, block: int = 1_024) -> DataFrame:
    """The k best stored vectors of each query by similarity or `phi`, ties to the smaller id: (query_id, id, score).

    queries has query_id, hv and as_of, low, high; stored has id, hv, start and end: numbers or null. A row counts for a
    query if start <= as_of < end and it overlaps low .. high, where these are given; an open end reaches forever for
    as_of and is a point at its start for the window. Rows below `floor` are left out. Each task keeps the k best of its
    own rows, so the pairs never leave the task that compares them.
    """
    session, schema = stored.sparkSession, "query_id long, id long, score double"
    out = session.createDataFrame([], schema)
    known = stored.filter("id is not null and hv is not null").select("id", "hv", F.col("start").cast("double"), F.col("end").cast("double"))
    times = [F.col(c).cast("double").alias(c) for c in ("as_of", "low", "high")]
    for part in _blocks(queries.select("query_id", "hv", *times), ["query_id", "hv", "as_of", "low", "high"], block):
        sent = session.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            q = sent.value
            pop_q, to = np.bitwise_count(q["hv"]).sum(axis=1, dtype=np.int64).astype(float), _distances(q["hv"])
            for b in batches:
                if not b.num_rows:
                    continue
                ids, n = b.column("id").to_numpy(), float(words * WORD_BITS)
                s = b.column("hv").flatten().to_numpy().reshape(-1, words)
                start, end = (b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("start", "end"))
                pop_s = np.bitwise_count(s).sum(axis=1, dtype=np.int64).astype(float)
                rows: list[tuple[int, np.ndarray, np.ndarray]] = []
                for at in range(0, len(ids), 4_096):
                    cut = slice(at, at + 4_096)
                    d = to(s[cut])
                    ends = np.where(np.isnan(end[cut]), np.inf, end[cut])
                    point = np.where(np.isnan(end[cut]), start[cut], end[cut])
                    for i, (t, low, high) in enumerate(zip(q["as_of"], q["low"], q["high"])):
                        if by_phi:
                            both, spread = (pop_q[i] + pop_s[cut] - d[i]) / 2.0, pop_q[i] * (n - pop_q[i]) * pop_s[cut] * (n - pop_s[cut])
                            score = np.where(spread <= 0, 0.0, (n * both - pop_q[i] * pop_s[cut]) / np.sqrt(np.where(spread <= 0, 1.0, spread)))
                        else:
                            score = 1 - d[i] / n
                        fits = np.ones(len(score), dtype=bool) if floor is None else score >= floor
                        if not np.isnan(t):
                            fits &= (start[cut] <= t) & (t < ends)
                        if not (np.isnan(low) or np.isnan(high)):
                            fits &= (start[cut] <= high) & (point >= low)
                        may = np.flatnonzero(fits)
                        if len(may):
                            best = may[_least(-score[may], ids[cut][may], min(k, len(may)))]
                            rows.append((i, ids[cut][best], score[best]))
                if rows:
                    yield pa.RecordBatch.from_pydict({
                        "query_id": np.repeat(q["query_id"][[r[0] for r in rows]], [len(r[1]) for r in rows]),
                        "id": np.concatenate([r[1] for r in rows]), "score": np.concatenate([r[2] for r in rows]),
                    })

        out = out.unionByName(known.mapInArrow(run, schema))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def closest(queries: DataFrame, stored: DataFrame, words: int = FULL_WORDS, block: int = 1_024) -> DataFrame:
    """(id, score): the largest similarity of each stored vector to a stated set; one row per vector and block is moved."""
    session, schema = stored.sparkSession, "id long, score double"
    out = session.createDataFrame([], schema)
    for part in _blocks(queries, ["query_id", "hv"], block):
        sent = session.sparkContext.broadcast(part["hv"])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            to = _distances(sent.value)
            for b in batches:
                if b.num_rows:
                    s = b.column("hv").flatten().to_numpy().reshape(-1, words)
                    least = np.concatenate([to(s[at : at + 4_096]).min(axis=0) for at in range(0, len(s), 4_096)])
                    yield pa.RecordBatch.from_pydict({"id": b.column("id").to_numpy(), "score": 1 - least / float(words * WORD_BITS)})

        out = out.unionByName(stored.filter("id is not null and hv is not null").select("id", "hv").mapInArrow(run, schema))
    return out.groupBy("id").agg(F.max("score").alias("score"))


# Encodings of facts, episodes, goals and beliefs.

# Names of the role vectors.
ROLE_SUBJECT, ROLE_PREDICATE, ROLE_OBJECT, ROLE_TIME = "ROLE_SUBJ", "ROLE_PRED", "ROLE_OBJ", "ROLE_TIME"


def bind_triple(subject: Column, predicate: Column, obj: Column, words: int = FULL_WORDS) -> Column:
    """Majority of the three role-bound fillers."""
    role = lambda r, c: bind(from_name(F.lit(r), words), from_name(c, words))
    return bundle3(role(ROLE_SUBJECT, subject), role(ROLE_PREDICATE, predicate), role(ROLE_OBJECT, obj))


def day_vector(day: Column, words: int = FULL_WORDS) -> Column:
    """The time role bound to a day key yyyy-MM-dd."""
    return bind(from_name(F.lit(ROLE_TIME), words), from_name(F.date_format(day, "yyyy-MM-dd"), words))


def episode_members(episodes: DataFrame, words: int = FULL_WORDS) -> DataFrame:
    """(id, hv): one row per triple of an episode and one for its day; their majority is its signature."""
    facts = episodes.select("id", F.explode("triples").alias("t")).select(
        "id", bind_triple(F.col("t.subject"), F.col("t.predicate"), F.col("t.object"), words).alias("hv")
    )
    day = episodes.filter("size(triples) > 0").select("id", day_vector(F.col("valid_start"), words).alias("hv"))
    return facts.unionByName(day).filter("hv is not null")


def signature(words: int = FULL_WORDS):
    """Arrow UDF (triples, valid_start) -> array<bigint>: the majority of `episode_members` made in the row itself, null without members.

    The same as `bundle_groups` over `episode_members`, for stored episodes with one row each: no tallies are shuffled.
    """

    @F.pandas_udf("array<bigint>")
    def sign(facts: pd.Series, days: pd.Series) -> pd.Series:
        subject, predicate, obj, time = (name_bits(r, words) for r in (ROLE_SUBJECT, ROLE_PREDICATE, ROLE_OBJECT, ROLE_TIME))

        def one(triples, day):
            if triples is None or not len(triples):
                return None
            tally, n = np.zeros(words * WORD_BITS, dtype=np.int64), 0
            for s, p, o in triples:
                if s is not None and p is not None and o is not None:
                    tally += (subject ^ name_bits(s, words)) + (predicate ^ name_bits(p, words)) + (obj ^ name_bits(o, words)) >= 2
                    n += 1
            if day is not None:
                tally += time ^ name_bits(day, words)
                n += 1
            return pack_bits(2 * tally > n) if n else None

        return pd.Series([one(t, d) for t, d in zip(facts, days)], dtype=object)

    names = lambda t: F.array(t["subject"], t["predicate"], t["object"])
    return lambda triples, start: sign(F.transform(triples, names), F.date_format(start, "yyyy-MM-dd"))

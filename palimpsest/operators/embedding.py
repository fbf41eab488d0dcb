"""Text embeddings: feature hashing, random projection to bits, and static token tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import hv
from palimpsest.functions.text import terms

# Width of the hashed embedding and weights of its features.
DIM, UNIGRAM, BIGRAM, TRIGRAM = 256, 1.0, 0.7, 0.4
# Punctuation at which the basic tokenizer splits, and letters it writes without accents.
PUNCTUATION = ".,;:!?()[]{}\"'`/\\|@#$%^&*-_+="
ACCENTED = "áàâäãåéèêëíìîïóòôöõøúùûüñçýÿ"
UNACCENTED = "aaaaaaeeeeiiiioooooouuuuncyy"
WEIGHT_OFFSET = 2.7


def bucket(feature: Column, dim: int = DIM) -> Column:
    """Bucket of a feature: 60 bits of its md5, modulo the width."""
    return (F.conv(F.substring(F.md5(feature), 1, 15), 16, 10).cast("long") % dim).cast("int")


def features(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, feature, w): words, word pairs and letter triples of the words, each with its weight."""
    words = df.select(key, terms(text).alias("t"))
    one = words.select(key, F.explode("t").alias("x")).select(key, F.concat(F.lit("u:"), "x").alias("feature"), F.lit(UNIGRAM).alias("w"))
    pair = F.zip_with(F.slice("t", F.lit(1), F.greatest(F.size("t") - 1, F.lit(0))), F.slice("t", F.lit(2), F.size("t")), lambda a, b: F.concat_ws(" ", a, b))
    two = words.select(key, F.explode(pair).alias("x")).select(key, F.concat(F.lit("b:"), "x").alias("feature"), F.lit(BIGRAM).alias("w"))
    grams = lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - 2), lambda i: F.substring(x, i, F.lit(3)))
    long = words.select(key, F.explode("t").alias("x")).filter(F.length("x") >= 3)
    three = long.select(key, F.explode(grams(F.col("x"))).alias("g")).select(key, F.concat(F.lit("t:"), "g").alias("feature"), F.lit(TRIGRAM).alias("w"))
    return one.unionByName(two).unionByName(three)


def hashed(df: DataFrame, dim: int = DIM, key: str = "id", text: str = "text") -> DataFrame:
    """(key, bucket, value): non-zero entries of the L2-normalised hashed embedding. Texts without words give no rows."""
    sums = features(df, key, text).groupBy(key, bucket(F.col("feature"), dim).alias("bucket")).agg(F.sum("w").alias("v"))
    norm = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return sums.join(norm, key).select(key, "bucket", (F.col("v") / F.col("norm")).alias("value"))


def dense(entries: DataFrame, dim: int = DIM, key: str = "id") -> DataFrame:
    """(key, embedding) as arrays."""
    have = entries.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "value"))).alias("m"))
    return have.select(key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)).cast("float")).alias("embedding"))


def signs(bits: int, dim: int) -> np.ndarray:
    """The frozen +-1 matrix: bit k of the md5 words of row i, so any engine can make it again."""
    rows = [hv.name_bits(f"charikar:{i}", -(-dim // hv.WORD_BITS))[:dim] for i in range(bits)]
    return np.array(rows, dtype=np.int64) * 2 - 1


def projected(df: DataFrame, words: int = hv.FULL_WORDS, dim: int = DIM, key: str = "id", column: str = "embedding") -> DataFrame:
    """(key, hv): bit i is set if the signed sum of trunc(1024 * value) is positive. Null or short embeddings are left out."""
    matrix = df.sparkSession.sparkContext.broadcast(signs(words * hv.WORD_BITS, dim).T.astype(np.float64))  # of fixed size

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), 512):  # products of a whole batch would take 66 kB a row
                part = f.iloc[at : at + 512]
                x = np.trunc(1024 * np.stack([np.asarray(e, dtype=np.float64) for e in part["e"]]))
                set_ = (x @ matrix.value) > 0  # sums of whole numbers, exact in doubles
                yield pd.DataFrame({"k": part["k"], "hv": [hv.pack_bits(r) for r in set_]})

    rows = df.filter((F.size(column) == dim)).select(F.col(key).cast("long").alias("k"), F.col(column).alias("e"))
    return rows.mapInPandas(run, "k long, hv array<bigint>").select(F.col("k").alias(key), "hv")


def basic_tokens(text: Column) -> Column:
    """Lower-cased words split at white space and punctuation, without accents."""
    clean = F.translate(F.lower(text), ACCENTED + PUNCTUATION, UNACCENTED + " " * len(PUNCTUATION))
    return F.filter(F.split(clean, r"\s+"), lambda x: x != "")


def word_pieces(vocabulary: dict[str, int], unknown: str = "[UNK]"):
    """Arrow UDF array<string> -> array<int>: greedy longest pieces, ## inside a word; a part that is unknown ends its word."""
    unk = vocabulary.get(unknown)

    @F.pandas_udf("array<int>")
    def pieces(words: pd.Series) -> pd.Series:
        def one(word: str) -> list[int]:
            out, at = [], 0
            while at < len(word):
                for end in range(len(word), at, -1):
                    piece = vocabulary.get(("##" if at else "") + word[at:end])
                    if piece is not None:
                        out.append(piece)
                        at = end
                        break
                else:
                    return [*out, unk] if unk is not None else out
            return out

        return words.map(lambda ws: [p for w in (ws if ws is not None else []) for p in one(w)])

    return pieces


def static_embedding(pieces: DataFrame, table: DataFrame, dim: int, skip: list[int], key: str = "id") -> DataFrame:
    """(key, embedding): weighted mean 1/(piece + 2.7) of the table rows (piece, vector) of a text, normalised.

    pieces has the key and an array of piece ids; ids in `skip` (markers) and unknown ids do not count.
    """
    each = pieces.select(key, F.explode("pieces").alias("piece")).filter(~F.col("piece").isin(skip) if skip else F.lit(True))
    x = each.join(table, "piece").withColumn("w", 1 / (F.col("piece") + WEIGHT_OFFSET))
    parts = x.select(key, F.posexplode("vector").alias("i", "v"), "w").groupBy(key, "i").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v"))
    norm = parts.groupBy(key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return parts.join(norm, key).groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", (F.col("v") / F.greatest("norm", F.lit(1e-12))).alias("v")))), lambda s: s["v"]).alias("embedding")
    )


def hashed_embedder(words: int = hv.FULL_WORDS):
    """The default embedder: a function of (df, key) that gives (key, hv) for the texts of df."""
    return lambda df, key: projected(dense(hashed(df, key=key), key=key), words, key=key)


def static_embedder(vocabulary: dict[str, int], table: DataFrame, dim: int, skip: list[int], words: int = hv.FULL_WORDS):
    """An embedder over a table of word-piece vectors, as `hashed_embedder`."""

    def embed(df: DataFrame, key: str) -> DataFrame:
        pieces = df.select(key, word_pieces(vocabulary)(basic_tokens(F.col("text"))).alias("pieces"))
        return projected(static_embedding(pieces, table, dim, skip, key), words, dim, key)

    return embed

"""Surprise-gated ingestion: frames far from the latest episodes become episodes.

Batch form: the surprise of each row against the up to 64 live rows before it, with blocks
of rows that overlap by the window, so no task holds the whole order. Streaming form: a
stateful operator per stream key, whose state is the window of signatures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import hv
from palimpsest.functions.text import terms
from palimpsest.operators.order import numbered

# Frames kept, surprise from which a frame is promoted, episodes looked back at.
CAPACITY, PROMOTE_AT, LOOK_BACK = 1000, 0.4, 64


def surprise(df: DataFrame, words: int = hv.FULL_WORDS, look_back: int = LOOK_BACK, block: int = 4096) -> DataFrame:
    """(id, pos, surprise): 1 - the largest similarity to the `look_back` rows before, in id order.

    df has id and text, one row per id. The first row has surprise 1, a text without terms 0; texts without terms
    are still looked back at.
    """
    x = numbered(df.filter("id is not null").select("id", hv.token_bundle(words)(terms("text")).alias("hv"), (F.size(terms("text")) > 0).alias("spoken")), ["id"])
    home = F.floor(F.col("pos") / block)
    copies = F.when(F.col("pos") % block >= block - look_back, F.array(home, home + 1)).otherwise(F.array(home))
    dealt = x.withColumn("home", home).withColumn("block", F.explode(copies))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        v = np.array(pdf["hv"].tolist(), dtype=np.int64)
        least = np.full(len(pdf), words * hv.WORD_BITS, dtype=np.int64)
        for back in range(1, min(look_back, len(pdf) - 1) + 1):  # all rows against the one so many places before
            for at in range(back, len(pdf), 512):  # so few that they stay in the processor's cache
                to = min(at + 512, len(pdf))
                least[at:to] = np.minimum(least[at:to], np.bitwise_count(v[at:to] ^ v[at - back : to - back]).sum(axis=1, dtype=np.int64))
        out = least / (words * hv.WORD_BITS)
        out[~pdf["spoken"].to_numpy()] = 0.0
        own = (pdf["home"] == pdf["block"]).to_numpy()
        return pd.DataFrame({"id": pdf["id"][own], "pos": pdf["pos"][own], "surprise": out[own]})

    return dealt.groupBy("block").applyInPandas(run, "id long, pos long, surprise double")


class Ring:
    """The state of one stream: signatures of the latest promoted frames, and the next frame number."""

    def __init__(self, words: int, rows: list[list[int]] | None = None, frames: int = 0):
        self.words, self.rows, self.frames = words, [np.array(r, dtype=np.int64) for r in rows or []], frames

    def see(self, text: str | None) -> tuple[int, float, bool]:
        """Number, surprise and promotion of the next frame; a promoted one joins the window."""
        ts = _terms(text)
        self.frames += 1
        if not ts:
            return self.frames, 0.0, False
        tally = sum(hv.name_bits(t, self.words).astype(np.int64) for t in ts)
        v = hv.pack_bits(2 * tally > len(ts))
        if not self.rows:
            s = 1.0
        else:
            s = float(np.bitwise_count(np.stack(self.rows) ^ v).sum(axis=1).min()) / (self.words * hv.WORD_BITS)
        if s >= PROMOTE_AT:
            self.rows = [*self.rows, v][-LOOK_BACK:]
        return self.frames, s, s >= PROMOTE_AT


def _terms(text: str | None) -> list[str]:
    import regex

    return regex.findall(r"[\p{L}\p{N}]+", text.lower()) if text else []


FRAME = "stream string, id long, text string, at timestamp, surprise double, promoted boolean"
STATE = "rows array<array<bigint>>, frames long"


def stateful(stream: DataFrame, words: int = hv.FULL_WORDS) -> DataFrame:
    """Frames of a streaming table (stream, at, text): surprise against the promoted frames of the same stream key.

    Rows of a key are taken by time within each micro-batch. The state is at most LOOK_BACK signatures a key.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows, n = state.get if state.exists else ([], 0)
        ring = Ring(words, rows, n)
        for f in frames:
            f = f.sort_values(["at", "text"])
            made = [ring.see(t) for t in f["text"]]
            yield pd.DataFrame({"stream": key[0], "id": [m[0] for m in made], "text": f["text"].to_numpy(), "at": f["at"].to_numpy(), "surprise": [m[1] for m in made], "promoted": [m[2] for m in made]})
        state.update(([r.tolist() for r in ring.rows], ring.frames))

    return stream.groupBy("stream").applyInPandasWithState(run, FRAME, STATE, "append", "NoTimeout")


def kept(frames: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The newest `capacity` frames by id."""
    return frames.orderBy(F.desc("id")).limit(capacity)


def promoted_episodes(frames: DataFrame, first_id: int, now: Column) -> DataFrame:
    """Text-only episodes of the promoted frames, with source `sensory` and confidence 0.5."""
    none = F.lit(None).cast("string")
    provenance = F.struct(F.lit("sensory").alias("source"), none.alias("session_id"), none.alias("trace_id"), F.create_map().cast("map<string,string>").alias("metadata"))
    from palimpsest.operators.extract import TRIPLES

    return numbered(frames.filter("promoted"), ["at", "id"], "new", first_id).select(
        F.col("new").cast("long").alias("id"), "text", F.array().cast(TRIPLES).alias("triples"),
        F.col("at").alias("valid_start"), F.lit(None).cast("timestamp").alias("valid_end"), now.alias("t_tx_start"), provenance.alias("provenance"),
        F.lit(0.5).alias("confidence"), F.lit(None).cast("long").alias("superseded_by"),
    )

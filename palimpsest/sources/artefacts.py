"""Supplied model artefacts: checksums, token vocabularies and single-tensor safetensors files."""

from __future__ import annotations

import json
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ArtefactError(ValueError):
    """A file is not what it should be."""


def verify_sha256(spark: SparkSession, path: str, expected: str) -> None:
    """Raises ArtefactError if the file's SHA-256 differs from the expected hexadecimal digest."""
    found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h")).collect()
    if len(found) != 1 or found[0].h != expected.lower():
        raise ArtefactError(f"{path}: checksum {[r.h for r in found]} is not {expected}")


def read_vocabulary(spark: SparkSession, path: str, limit: int | None = None) -> dict[str, int]:
    """Token -> id from a text file with one token a line; the id is the line number from 0."""
    lines = [r.value for r in spark.read.text(path, wholetext=True).collect()]
    tokens = "".join(lines).splitlines()[:limit]
    return {t: i for i, t in enumerate(tokens)}


def parse_safetensors(data: bytes, name: str | None = None) -> np.ndarray:
    """The one two-dimensional float32 tensor of a safetensors file."""
    if len(data) < 8:
        raise ArtefactError("no header")
    (size,) = struct.unpack("<Q", data[:8])
    try:
        header = json.loads(data[8 : 8 + size])
    except ValueError as e:
        raise ArtefactError("the header is no JSON") from e
    tensors = {k: v for k, v in header.items() if k != "__metadata__"}
    key = name or next(iter(tensors), None)
    if key not in tensors or (name is None and len(tensors) != 1):
        raise ArtefactError(f"one tensor expected, found {sorted(tensors)}")
    t = tensors[key]
    if t["dtype"] != "F32" or len(t["shape"]) != 2:
        raise ArtefactError(f"{key}: {t['dtype']} {t['shape']} is no float32 matrix")
    a, b = t["data_offsets"]
    body = data[8 + size + a : 8 + size + b]
    if len(body) != 4 * t["shape"][0] * t["shape"][1]:
        raise ArtefactError(f"{key}: cut short")
    return np.frombuffer(body, dtype="<f4").reshape(t["shape"])


def read_embedding_table(spark: SparkSession, path: str) -> DataFrame:
    """(piece, vector) from a safetensors file. A model's table is of fixed size, so one file is one row first."""
    def rows(frames):
        import pandas as pd

        for f in frames:
            for content in f["content"]:
                m = parse_safetensors(bytes(content))
                for at in range(0, len(m), 4096):
                    yield pd.DataFrame({"piece": np.arange(at, min(at + 4096, len(m)), dtype=np.int32), "vector": list(m[at : at + 4096])})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "piece int, vector array<float>")

"""Exact nearest neighbours of a stated query set, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def blocked_top_k(queries: DataFrame, stored: DataFrame, k: int, block: int = 512) -> DataFrame:
    """(query_id, vec_id, score): the k rows of largest cosine to each query, the query itself left out.

    Each block of at most `block` queries is sent to all tasks; a task keeps the k best of its own rows per query,
    so at most k rows per query and task are moved. Zero vectors have cosine 0 to all. Null embeddings are left out.
    """
    session = stored.sparkSession
    schema = "query_id long, vec_id long, score double"
    out = session.createDataFrame([], schema)
    rows = queries.filter("embedding is not null").select("vec_id", "embedding").toLocalIterator()
    more = True
    while more:
        ids, vectors = [], []
        for r in rows:
            ids.append(r.vec_id)
            vectors.append(r.embedding)
            if len(ids) == block:
                break
        more = len(ids) == block
        if not ids:
            break
        q = np.array(vectors, dtype=np.float64)
        norms = np.linalg.norm(q, axis=1, keepdims=True)
        sent = session.sparkContext.broadcast((np.array(ids), np.divide(q, norms, out=np.zeros_like(q), where=norms > 0)))

        def run(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            qid, unit = sent.value
            for f in frames:
                if not len(f):
                    continue
                v = np.array(f["embedding"].tolist(), dtype=np.float64)
                n = np.linalg.norm(v, axis=1, keepdims=True)
                score = unit @ np.divide(v, n, out=np.zeros_like(v), where=n > 0).T
                own = f["vec_id"].to_numpy()
                score[qid[:, None] == own[None, :]] = -np.inf
                for i in range(len(qid)):
                    best = np.lexsort((own, -score[i]))[:k]
                    best = best[np.isfinite(score[i][best])]
                    yield pd.DataFrame({"query_id": qid[i], "vec_id": own[best], "score": score[i][best]})

        out = out.unionByName(stored.filter("embedding is not null").select("vec_id", "embedding").mapInPandas(run, schema))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")

"""Ordered folds: a state carried over the rows of each key in order.

Rows are partitioned by key and sorted within the partitions, then streamed; a key of any
size passes through one task, but only its state is held, never its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[dict], Any], step: Callable[[Any, dict], tuple[Any, dict | None]], schema: str) -> DataFrame:
    """Runs `step(state, row) -> (state, output row or None)` over each key's rows, from `start(first row)`.

    The output carries the keys and what step gives; `schema` describes it. Rows with equal
    order columns come in no defined order, so the order should end with a unique column.
    """
    names = [p.strip().split(" ")[0] for p in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for f in frames:
            out = []
            for row in f.to_dict("records"):
                k = tuple(row[c] for c in keys)
                if k != key:
                    key, state = k, start(row)
                state, made = step(state, row)
                if made is not None:
                    out.append({**{c: row[c] for c in keys}, **made})
            yield pd.DataFrame(out, columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)

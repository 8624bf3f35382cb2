"""Sums of numpy states over all rows: one state a task, merged as a tree."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def added(a, b):
    """Sum of two states: None, numbers, arrays, or tuples and dicts of states."""
    if a is None or b is None:
        return b if a is None else a
    if isinstance(a, dict):
        return {k: added(a.get(k), b.get(k)) for k in a.keys() | b.keys()}
    if isinstance(a, tuple):
        return tuple(added(x, y) for x, y in zip(a, b, strict=True))
    return a + b


def gathered(rows: DataFrame, fold: Callable, merge: Callable = added, large: bool = False):
    """``fold(state, batch)`` over the Arrow batches of each task (from None), merged; None without rows.

    A state must not grow with the rows. Nothing but merged states is sent; of
    ``large`` ones the driver gets a single one, merged by tasks in a further stage.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if len(batch):
                state = fold(state, batch)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], pa.binary())], names=["state"])

    partial = rows.mapInArrow(run, "state binary").rdd.map(lambda row: pickle.loads(row[0]))
    while large and (n := partial.getNumPartitions()) > 1:
        n = 1 if n <= 16 else math.isqrt(n)
        partial = partial.mapPartitionsWithIndex(lambda i, states, n=n: [(i % n, x) for x in states]).reduceByKey(merge, n).values()
    # few states are merged where they arrive; a tree of one level more takes another stage
    return partial.treeAggregate(None, merge, merge, 1 if partial.getNumPartitions() <= 16 else 2)

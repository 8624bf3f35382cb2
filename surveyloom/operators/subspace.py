"""Truncated singular vectors of sparse one-hot rows, without centring, by a randomised range finder.

A row is the list of its categories, so a product with a matrix of categories x
k gathers and scatters a few rows of that matrix. Each pass over the rows sums
A'(A Q), merged as a tree; Q is orthogonalised between passes. Nothing of the
rows' number leaves the executors; matrices have a row a category.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.operators.gather import gathered
from surveyloom.sources.scratch import drop, written

MISSING = "Missing"


@dataclass(frozen=True)
class SvdRule:
    k: int = 4
    passes: int = 7
    spare: int = 10
    seed: int = 1701
    most_categories: int = 1_000_000


@dataclass
class Svd:
    """Categories by column and value, singular values, vectors (categories x k), and the factors' training mean and deviation."""

    columns: list[str]
    categories: dict[tuple[str, str], int]
    values: np.ndarray
    vectors: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray
    explained: np.ndarray


def _category(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(MISSING))


def fit_categories(rows: DataFrame, columns: list[str], most: int) -> dict[tuple[str, str], int]:
    """Numbers of the values of each column; null is a value of its own."""
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), _category(c).alias("v")) for c in columns])).alias("x")).select("x.*").distinct()
    found = each.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} categories")
    order = {c: i for i, c in enumerate(columns)}
    return {k: i for i, k in enumerate(sorted(((r["c"], r["v"]) for r in found), key=lambda k: (order[k[0]], k[1])))}


def hot(rows: DataFrame, columns: list[str], categories: dict[tuple[str, str], int], name: str = "hot") -> DataFrame:
    """``rows`` with the numbers of their categories; values that were not fitted have none."""
    spark = rows.sparkSession
    for i, c in enumerate(columns):
        known = spark.createDataFrame([(v, n) for (k, v), n in categories.items() if k == c], f"_v{i} string, _n{i} int")
        rows = rows.withColumn(f"_v{i}", _category(c)).join(known, f"_v{i}", "left").drop(f"_v{i}")
    numbers = [f"_n{i}" for i in range(len(columns))]
    return rows.withColumn(name, F.filter(F.array(*numbers), lambda x: x.isNotNull())).drop(*numbers)


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, int]:
    lists = batch.column(batch.schema.get_field_index("hot"))
    return pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64), len(batch)


def _times(ids: np.ndarray, of: np.ndarray, n: int, q: np.ndarray) -> np.ndarray:
    out = np.zeros((n, q.shape[1]))
    np.add.at(out, of, q[ids])
    return out


def fit_svd(rows: DataFrame, columns: list[str], rule: SvdRule = SvdRule()) -> Svd | None:
    """The ``k`` largest singular values and vectors, each with its largest entry positive; None without rows."""
    categories = fit_categories(rows, columns, rule.most_categories)
    if not categories:
        return None
    held = written(hot(rows, columns, categories).select("hot"), "hot")
    n, k = len(categories), min(rule.k, len(categories))
    q = np.linalg.qr(np.random.default_rng(rule.seed).normal(size=(n, min(n, k + rule.spare))))[0]

    def image(q: np.ndarray):
        def fold(state, batch):
            ids, of, m = _rows(batch)
            out = np.zeros(q.shape) if state is None else state
            np.add.at(out, ids, _times(ids, of, m, q)[of])
            return out

        return gathered(held, fold)

    for _ in range(rule.passes):
        q = np.linalg.qr(image(q))[0]
    squares, turn = np.linalg.eigh(q.T @ image(q))
    vectors = (q @ turn[:, ::-1])[:, :k]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)])

    def moments(state, batch):
        ids, of, m = _rows(batch)
        z = _times(ids, of, m, vectors)
        mine = (m, z.sum(axis=0), (z**2).sum(axis=0), np.bincount(ids, minlength=n))
        return mine if state is None else tuple(a + b for a, b in zip(state, mine, strict=True))

    m, total, square, count = gathered(held, moments)
    drop(held.sparkSession, held.written_path)
    mean, share = total / m, count / m
    variance = np.maximum(square / m - mean**2, 0.0)
    whole = (share * (1 - share)).sum()
    return Svd(columns, categories, np.sqrt(np.maximum(squares[::-1][:k], 0.0)), vectors, mean, np.sqrt(variance), variance / whole if whole > 0 else np.zeros(k))


def svd_factors(model: Svd, rows: DataFrame, name: str = "factors", standard: bool = True) -> DataFrame:
    """``rows`` with their factors, by default less the training mean and over the training deviation (0 where that is 0)."""
    names = rows.columns
    scale = np.where(model.deviation > 1e-12, model.deviation, np.inf) if standard else 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                z = (_times(*_rows(batch), model.vectors) - (model.mean if standard else 0.0)) / scale
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(z.tolist(), pa.list_(pa.float64()))], names=[*names, name])

    schema = rows.select("*", F.lit(None).cast("array<double>").alias(name)).schema
    return hot(rows, model.columns, model.categories).mapInArrow(run, schema)

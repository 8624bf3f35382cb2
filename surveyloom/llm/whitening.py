"""Embedding whitening by a two-pass covariance.

Entries become integers, whose sums are exact whatever the order of tasks. The
second pass sums outer products of the centred vectors, one matrix product a
batch; matrices of dimensions x dimensions are merged by ``treeAggregate``, and
LAPACK's symmetric solver gives the components. The projection matrix goes to
the tasks with the function (dimensions x components doubles). A last pass
measures the covariance of what was whitened. No row is shuffled, and the
driver holds matrices of dimensions x dimensions only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.llm.shared import free_name, released, table
from surveyloom.sources.shipping import ship

SCALE, SHIFT = 64, 1_000_000
#: Integers stay within this, so that differences of two fit 64 bits. Entries beyond 3e16 are cut to it.
REACH = 1 << 61


@dataclass(frozen=True)
class Whitening:
    """n fitted vectors, their integer sums, falling eigenvalues, unit components (dimensions x dimensions, columns)."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    components: np.ndarray

    @property
    def dims(self) -> int:
        return len(self.sums)

    @property
    def alive(self) -> np.ndarray:
        """Components with variance: the others' eigenvalues are rounding."""
        return self.values > np.abs(self.values).max(initial=0) * max(1, self.dims) * np.finfo(float).eps

    def explained(self) -> np.ndarray:
        total = self.values.sum()
        return self.values / total if total > 0 else np.zeros(self.dims)


def integers(vectors: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the usable vectors of ``dims`` entries, and their integers (rows x dims)."""
    fits = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(vectors), dims), False).to_numpy(zero_copy_only=False))
    if not len(fits):
        return fits, np.zeros((0, dims), np.int64)
    flat = pc.list_flatten(vectors.take(pa.array(fits)))
    c = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)  # nulls become nan
    good = np.isfinite(c).all(axis=1)
    scaled = np.clip(np.floor(SCALE * c[good]), -float(REACH), float(REACH)).astype(np.int64)
    return fits[good], np.clip(scaled + SHIFT, -REACH, REACH)


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """x - S/n as doubles with one rounding each, and the exact integers x - S div n."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    near = x - whole
    return near - rest, near


def deviations(near: np.ndarray, n: int, sums: tuple[int, ...]) -> pa.Array:
    """Sums over dimensions of (n x - S)^2, exact; null where 38 digits do not hold them."""
    rest = [s % n for s in sums]
    kind = pa.decimal128(38, 0)
    if not near.size or (float(np.abs(near).max()) + 1) ** 2 * float(n) ** 2 * near.shape[1] < 2.0**62:
        d = n * near - np.array(rest, np.int64)
        return pa.array((d * d).sum(axis=1), pa.int64()).cast(kind)
    from decimal import Decimal

    found = [sum((n * int(a) - r) ** 2 for a, r in zip(row, rest, strict=True)) for row in near]
    return pa.array([Decimal(f) if f < 10**38 else None for f in found], kind)


def _merged(partials: DataFrame, merge, zero):
    """The merged partial results of all tasks, by a tree of merges."""
    import pickle

    return partials.rdd.map(lambda row: pickle.loads(row[0])).treeAggregate(zero, merge, merge, 3)


def _per_task(vectors: DataFrame, state, fold) -> DataFrame:
    """One pickled state a task, folded over its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        mine = state
        for batch in released(batches):
            mine = fold(mine, batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(mine)], pa.binary())], names=["b"])

    return vectors.mapInArrow(run, "b binary")


def _lengths(vectors: DataFrame, column: str) -> int:
    """The most frequent number of entries (the greatest of several)."""
    sizes = vectors.where(F.size(column) > 0).groupBy(F.size(column).alias("d")).agg(F.count(F.lit(1)).alias("c"))
    best = sizes.agg(F.max_by("d", F.struct("c", "d"))).first()[0]
    return best or 0


def _add(a, b):
    return b if a is None else a if b is None else tuple(x + y for x, y in zip(a, b, strict=True))


def _chan(a, b):
    """Merged (n, mean, centred products) of two sets."""
    if a is None or b is None:
        return b if a is None else a
    n, d = a[0] + b[0], b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)


def fit(vectors: DataFrame, column: str = "embedding") -> Whitening | None:
    """Components of all usable vectors; None if there are none.

    Vectors that are null, empty, hold a null or non-finite entry or have
    another length than the most frequent one are not fitted.
    """
    ship(vectors.sparkSession)
    dims = _lengths(vectors, column)
    if not dims:
        return None
    only = vectors.select(F.col(column).alias("v"))

    def add_sums(state, batch):
        _, x = integers(batch, dims)
        # high and low halves: neither sum can overflow within a task
        high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
        return _add(state, (len(x), *((int(h) << 32) + int(low_) for h, low_ in zip(high, low, strict=True))))

    total = _merged(_per_task(only, None, add_sums), _add, None)
    n, sums = (total[0], tuple(total[1:])) if total else (0, ())
    if not n:
        return None

    def add_products(state, batch):
        z, _ = centred(integers(batch, dims)[1], n, sums)
        return _add(state, (z.T @ z,))

    products = _merged(_per_task(only, None, add_products), _add, None)[0]
    values, components = np.linalg.eigh(products / n)
    return Whitening(n, sums, np.maximum(values[::-1], 0.0), np.ascontiguousarray(components[:, ::-1]))


def _projection(model: Whitening, k: int) -> np.ndarray:
    scale = np.where(model.alive[:k], np.sqrt(model.values[:k]), np.nan)
    return model.components[:, :k] / scale


def identity_error(vectors: DataFrame, model: Whitening, k: int, column: str = "embedding") -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, over components with variance."""
    live = np.flatnonzero(model.alive[:k])
    w = _projection(model, k)[:, live]

    def fold(state, batch):
        z, _ = centred(integers(batch, model.dims)[1], model.n, model.sums)
        if not len(z):
            return state
        y = z @ w
        mean = y.mean(axis=0)
        return _chan(state, (len(y), mean, (y - mean).T @ (y - mean)))

    total = _merged(_per_task(vectors.select(F.col(column).alias("v")), None, fold), _chan, None)
    return float(np.abs(total[2] / total[0] - np.eye(len(live))).max(initial=0.0))


def whiten(vectors: DataFrame, model: Whitening, k: int = 32, column: str = "embedding") -> DataFrame:
    """The usable rows with ``whitened`` array<double> of up to k components and ``deviation`` decimal(38, 0).

    Columns of these names in any case give the new ones an underscore at the
    end. An entry of ``whitened`` is null where its component has no variance.
    """
    ship(vectors.sparkSession)
    k = min(k, model.dims)
    names, at = vectors.columns, vectors.columns.index(column)
    whitened, deviation = free_name(names, "whitened"), free_name(names, "deviation")
    w = _projection(model, k)
    dead = np.isnan(w).all(axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            rows, x = integers(batch.column(at), model.dims)
            z, near = centred(x, model.n, model.sums)
            y = z @ np.nan_to_num(w)
            flat = pa.array(y.ravel(), pa.float64(), mask=np.tile(dead, len(y)))
            out = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * k, pa.int32()), flat)
            kept = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, out, deviations(near, model.n, model.sums)], names=[*names, whitened, deviation])

    fields = vectors.select("*", F.lit(None).cast("array<double>").alias(whitened), F.lit(None).cast("decimal(38,0)").alias(deviation)).schema
    return vectors.mapInArrow(run, fields)


#: Components of the registered query.
COMPONENTS = 32


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per usable vector and component: the whitened value, with the fit's size, the exact deviation, and the share explained.

    Without a usable vector there are no rows. Rows of null or repeated ids are whitened like any other.
    """
    vectors = table(spark, sf_dir, "embeddings")
    return whitened_rows(vectors)


def whitened_rows(vectors: DataFrame, k: int = COMPONENTS) -> DataFrame:
    vectors = vectors.select("vec_id", "embedding")
    model = fit(vectors)
    if model is None:
        model, error = Whitening(1, (), np.zeros(0), np.zeros((0, 0))), 0.0
        vectors = vectors.where("false")
    else:
        error = identity_error(vectors, model, k)
    shares = F.array(*[F.lit(float(v)) for v in model.explained()[:k]]) if model.dims else F.array().cast("array<double>")
    rows = whiten(vectors, model, k).select("vec_id", F.col("deviation").cast("bigint").alias("deviation"), F.posexplode("whitened").alias("p", "whitened"))
    return rows.select("vec_id", (F.col("p") + 1).cast("int").alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", F.get(shares, F.col("p")).alias("explained"), F.lit(error).alias("identity_error"))

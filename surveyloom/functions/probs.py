"""Probability and vector arrays (array<double>)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-12


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def at(p: Column, index: Column) -> Column:
    return F.get(p, index.cast("int"))


def normalise(p: Column) -> Column:
    return bind(total(p), lambda s: F.transform(p, lambda x: x / s))


def uniform(n: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), n), lambda _: F.lit(1.0) / n)


def smooth(counts: Column, alpha: float) -> Column:
    """Counts plus ``alpha`` each, as shares."""
    return bind(total(counts) + F.lit(alpha) * F.size(counts), lambda s: F.transform(counts, lambda c: (c + alpha) / s))


def softmax(values: Column) -> Column:
    """I24"""
    return bind(F.array_max(values), lambda m: normalise(F.transform(values, lambda x: F.exp(x - m))))


def argmax(p: Column) -> Column:
    """the first of the largest."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def nll(p: Column, answer: Column) -> Column:
    """I23"""
    return -F.log(F.greatest(at(p, answer), F.lit(FLOOR)))


def brier(p: Column, answer: Column) -> Column:
    return total(F.transform(p, lambda x, i: F.pow(x - (i == answer).cast("double"), F.lit(2.0))))


def running(p: Column) -> Column:
    """cumulative sums. Arrays of options are short, so a slice for each is cheap."""
    return F.transform(p, lambda _, i: total(F.slice(p, F.lit(1), i + 1)))


def rps(p: Column, answer: Column) -> Column:
    """Squared differences of the cumulative distributions, over n - 1; 0 for one option."""
    n = F.size(p)
    steps = F.transform(F.slice(running(p), F.lit(1), F.greatest(n - 1, F.lit(0))), lambda c, i: F.pow(c - (i >= answer).cast("double"), F.lit(2.0)))
    return F.when(n <= 1, F.lit(0.0)).otherwise(total(steps) / F.greatest(n - 1, F.lit(1)))


def expected_score(p: Column) -> Column:
    """Mean option position on 0 to 1."""
    return total(F.transform(p, lambda x, i: x * i)) / F.greatest(F.size(p) - 1, F.lit(1))


def temper(p: Column, temperature: Column) -> Column:
    """I25"""
    return normalise(F.transform(p, lambda x: F.pow(F.greatest(x, F.lit(FLOOR)), F.lit(1.0) / temperature)))


def log_pool(p: Column, q: Column, share: Column) -> Column:
    """Weighted geometric mean of two distributions."""
    return softmax(F.zip_with(p, q, lambda a, b: (1 - share) * F.log(F.greatest(a, F.lit(FLOOR))) + share * F.log(F.greatest(b, F.lit(FLOOR)))))


def unpermute(p: Column, order: Column) -> Column:
    """Probabilities by option from probabilities by label, where label i shows option order[i]."""
    return F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda s: F.get(p, (F.array_position(order, s) - 1).cast("int")))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Divergence in bits of two clipped distributions."""

    def of(pq: Column) -> Column:
        a, b = pq["p"], pq["q"]
        mean = F.zip_with(a, b, lambda x, y: (x + y) / 2)
        side = lambda z: total(F.zip_with(z, mean, lambda x, m: x * F.log2(x / m)))
        return (side(a) + side(b)) / 2

    clip = lambda z: normalise(F.transform(z, lambda x: F.greatest(x, F.lit(FLOOR))))
    return bind(F.struct(clip(p).alias("p"), clip(q).alias("q")), of)


def wasserstein(p: Column, q: Column) -> Column:
    """Distance of two distributions on one grid of 0 to 1."""
    return total(F.zip_with(running(p), running(q), lambda a, b: F.abs(a - b))) / F.greatest(F.size(p) - 1, F.lit(1))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """I30; norms are at least 1e-12."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(FLOOR)) * F.greatest(norm(b), F.lit(FLOOR)))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))))


def hamming(pairs: list[tuple[Column, Column]]) -> Column:
    """Fields that differ (null equals null)."""
    out = F.lit(0)
    for a, b in pairs:
        out = out + (~a.eqNullSafe(b)).cast("int")
    return out


def position_features(position: Column, n: Column) -> Column:
    """I32: constant, x, x squared, 1/n, first, last, and the scale's length (2, 4, 5, 6 or more)."""
    x = position / F.greatest(n - 1, F.lit(1))
    flag = lambda c: c.cast("double")
    return F.array(F.lit(1.0), x, x * x, F.lit(1.0) / n, flag(position == 0), flag(position == n - 1), flag(n == 2), flag(n == 4), flag(n == 5), flag(n >= 6))

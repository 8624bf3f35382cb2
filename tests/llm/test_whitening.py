"""Whitening against a plain numpy version."""

import math

import numpy as np
import pytest

from surveyloom.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, whitened string"


def plain(vectors, k):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    d = [int(sum((n * a - b) ** 2 for a, b in zip(r, s))) for r in x]
    z = np.array([[(n * a - b) / n for a, b in zip(r, s)] for r in x], float)
    v = z.T @ z / n
    e, c = np.linalg.eigh(v)
    e, c = e[::-1], c[:, ::-1]
    return d, (z @ c / np.sqrt(e))[:, :k], e[:k] / np.trace(v)


def test_whitening_equals_plain_version(spark):
    rng = np.random.default_rng(3)
    made = (rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) * [1, 2, 3, 4, 5, 6]).astype(np.float32).tolist()
    made += [made[0]] * 100  # a hot vector
    bad = [None, [], [1.0] * 5, [1.0, None, 1.0, 1.0, 1.0, 1.0], [float("nan")] + [1.0] * 5, [float("inf")] + [1.0] * 5]
    rows = [(i, v, "x") for i, v in enumerate(made)] + [(None, v, None) for v in bad]
    got = whitening.whitened_rows(spark.createDataFrame(rows, SCHEMA).repartition(5), 4).collect()
    d, w, share = plain(made, 4)
    assert len(got) == 4 * len(made)
    by = {(r.vec_id, r.component): r for r in got}
    for c in range(1, 5):
        mine = np.array([by[i, c].whitened for i in range(len(made))])
        assert min(np.abs(mine - w[:, c - 1]).max(), np.abs(mine + w[:, c - 1]).max()) < 1e-9
        assert abs(by[0, c].explained - share[c - 1]) < 1e-12
    assert [by[i, 1].deviation for i in range(len(made))] == d
    assert {r.n for r in got} == {len(made)} and 0 <= got[0].identity_error < 1e-10


def test_other_columns_stay_and_components_without_variance_are_null(spark):
    rows = [(1, [1.0, 5.0], "a"), (2, [2.0, 5.0], "b"), (2, [2.0, 5.0], None), (None, [4.0, 5.0], "c")]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = whitening.fit(docs)
    out = whitening.whiten(docs, model)
    assert out.columns == ["vec_id", "embedding", "whitened", "whitened_", "deviation"]
    got = out.collect()
    assert len(got) == 4 and all(r.whitened_[0] is not None and r.whitened_[1] is None for r in got)
    assert whitening.identity_error(docs, model, 2) < 1e-12


@pytest.mark.parametrize("rows", [[], [(1, None, "")], [(1, [None], "")], [(1, [], None)]])
def test_nothing_usable(spark, rows):
    assert whitening.whitened_rows(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_one_vector_and_large_entries(spark):
    assert [r.whitened for r in whitening.whitened_rows(spark.createDataFrame([(1, [3.0, 4.0], "")], SCHEMA)).collect()] == [None, None]
    rows = [(i, [float(i) * 1e12, 1.0 + i % 2], "") for i in range(4)]
    docs = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, whitened string")
    model = whitening.fit(docs)
    x = [64 * i * 10**12 + 10**6 for i in range(4)]
    y = [64 * (1 + i % 2) + 10**6 for i in range(4)]
    want = [(4 * a - sum(x)) ** 2 + (4 * b - sum(y)) ** 2 for a, b in zip(x, y)]
    assert [int(r.deviation) for r in whitening.whiten(docs, model).orderBy("vec_id").collect()] == want

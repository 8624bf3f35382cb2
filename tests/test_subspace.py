"""Sparse singular vectors against a dense decomposition."""

import numpy as np

from surveyloom.operators import subspace


def test_factors_equal_dense_decomposition(spark):
    rng = np.random.default_rng(0)
    rows = [(i, str(rng.integers(0, 3)), None if rng.random() < 0.2 else int(rng.integers(0, 5)), str(rng.integers(0, 2)), "x") for i in range(400)]
    df = spark.createDataFrame(rows, "id int, a string, b int, c string, hot string").drop("hot")
    columns = ["a", "b", "c"]
    model = subspace.fit_svd(df.repartition(5), columns, subspace.SvdRule(k=4, spare=4))
    dense = np.zeros((400, len(model.categories)))
    for r in rows:
        for c, v in zip(columns, r[1:4]):
            dense[r[0], model.categories[c, "Missing" if v is None else str(v)]] = 1
    u, s, vt = np.linalg.svd(dense, full_matrices=False)
    assert np.allclose(model.values, s[:4]) and len(model.categories) == 11
    assert np.allclose(np.abs(np.sum(model.vectors * vt[:4].T, axis=0)), 1) and (model.vectors[np.abs(model.vectors).argmax(axis=0), range(4)] > 0).all()
    z = dense @ model.vectors
    got = {r.id: r.factors for r in subspace.svd_factors(model, df).collect()}
    assert np.allclose(np.array([got[i] for i in range(400)]), (z - z.mean(axis=0)) / z.std(axis=0), atol=1e-8)
    assert np.allclose(model.explained, z.var(axis=0) / dense.var(axis=0).sum())
    new = spark.createDataFrame([(1, "9", None, "0")], "id int, a string, b int, c string")
    raw = subspace.svd_factors(model, new, standard=False).first().factors
    assert np.allclose(raw, model.vectors[model.categories["b", "Missing"]] + model.vectors[model.categories["c", "0"]])


def test_few_and_no_categories(spark):
    df = spark.createDataFrame([(1, "u"), (2, "u")], "id int, a string")
    model = subspace.fit_svd(df, ["a"])
    assert np.allclose(model.values, [np.sqrt(2)]) and subspace.svd_factors(model, df).first().factors == [0.0]
    assert subspace.fit_svd(df.limit(0), ["a"]) is None

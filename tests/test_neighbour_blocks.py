"""Blocks of a search are ranked some queries at a time, so a task's memory does not follow the index."""

import numpy as np

from surveyloom.operators import vectors


def test_ranked_cells_are_bounded(spark):
    assert vectors.CELLS // vectors.INDEX_BLOCK >= 1 and 5 * 8 * vectors.CELLS <= 64 << 20
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 4)).round(1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vector array<double>")
    got = {(r.id, r["rank"]): r.neighbour for r in vectors.neighbours(df, df, 2).collect()}  # 1,500 queries: more than one step
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    sims = np.round(unit @ unit.T, 12)
    np.fill_diagonal(sims, -9)
    want = np.lexsort((np.broadcast_to(np.arange(1500), sims.shape), -sims), axis=1)[:, :2]
    assert all(got[i, k + 1] == want[i, k] for i in range(1500) for k in range(2))

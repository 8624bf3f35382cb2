"""Losses of a grid are computed once for rows that are equal in what they read."""

import numpy as np
from pyspark.sql import functions as F

from surveyloom.functions import probs
from surveyloom.operators import calibration


def test_equal_rows_are_one_and_means_stay(spark, monkeypatch):
    rng = np.random.default_rng(5)
    kinds = [(rng.dirichlet(np.ones(3)).tolist(), int(rng.integers(0, 3))) for _ in range(12)]
    df = spark.createDataFrame([(i, *kinds[int(rng.integers(0, 12))]) for i in range(3000)], "row_id int, p array<double>, answer_index int").withColumn("q", F.reverse("p"))
    few = calibration.alike(df, "p", "answer_index")
    assert few.count() == 12 and few.agg(F.sum("_n")).first()[0] == 3000
    loss = lambda t: probs.nll(probs.temper(F.col("p"), t), F.col("answer_index"))
    grid = [0.5, 1.0, 2.0]
    assert np.allclose(calibration.mean_losses(few, loss, grid), calibration.mean_losses(df, loss, grid), atol=1e-11)
    two = lambda rows: calibration.sweep(rows, [(a, b) for a in grid for b in (0.0, 0.5)], lambda a, b: loss(a) + b).collect()
    assert two(few) == two(df)
    read, plain = [], calibration.mean_losses
    monkeypatch.setattr(calibration, "mean_losses", lambda rows, *x: read.append(rows.count()) or plain(rows, *x))
    calibration.fit_temperature(df)
    calibration.fit_share(df, "p", "q")
    assert set(read) == {12}

"""Halves of the ninth digit of an expected score go up whatever the last bit of a double is; values just below a half go down."""

import numpy as np

from surveyloom.plans import catalogue, scores

SHARE = 167 / 1024  # 0.1630859375


def test_expected_scores(spark, monkeypatch):
    shares = {"up": float(np.nextafter(SHARE, 0)), "down": SHARE - 4e-13}
    rows = [(i, [1 - 4 * x, 4 * x, 0.0, 0.0, 0.0], 0) for i, x in shares.items()]
    monkeypatch.setattr(scores, "predictions", lambda s, d: spark.createDataFrame(rows, "row_id string, p array<double>, answer_index int"))
    got = {r.row_id: r.expected for r in catalogue.QUERIES["rps_brier_nll_rows"](spark, "").collect()}
    assert got == {"up": 0.163085938, "down": 0.163085937}

"""Draws of respondents are made where they are used, the same as those of the SQL form."""

import numpy as np
from pyspark.sql import functions as F

from surveyloom.operators import inference


def test_draws_in_numpy_equal_those_in_sql(spark, monkeypatch):
    units = [("a::1", "a"), ("b::é", "b"), ("", "b")]
    want = spark.createDataFrame(units, "panel_id string, domain string").select(inference._all_draws(1701, 300, F.col("panel_id"), F.col("domain")).alias("n")).collect()
    assert (inference._draws_of(1701, 300, ["|".join(u) for u in units]) == np.array([r.n for r in want])).all()
    rng = np.random.default_rng(2)
    rows = [(f"d{p % 2}", f"d{p % 2}::{p}", f"d{p % 2}::q{q}", m, float(rng.normal())) for p in range(900) for q in range(4) for m in ("x", "y")]
    df = spark.createDataFrame(rows, "domain string, panel_id string, question_key string, method string, nll double")
    wide, plain = [], inference.gathered
    monkeypatch.setattr(inference, "gathered", lambda rows, fold: wide.extend(f.name for f in rows.schema if f.dataType.simpleString() == "array<tinyint>") or plain(rows, fold))
    a = inference.crossed_bootstrap(df, "x", "y", replicates=200).first()
    b = inference.crossed_bootstrap(df, "x", "y", replicates=200, most_items=0).first()
    assert not wide and all(abs(a[c] - b[c]) < 1e-9 if isinstance(a[c], float) else a[c] == b[c] for c in a.asDict())

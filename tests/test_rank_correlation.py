"""Spearman's correlation without a window over all rows."""

import numpy as np
from pyspark.sql import functions as F

from surveyloom.operators import metrics, questionnaires


def _ranks(v):
    v = np.array([-np.inf if x is None else x for x in v])
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def test_correlation_equals_loops(spark):
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 9, 300) / 4, rng.normal(size=300).round(1)
    rows = [(float(a) if i % 17 else None, float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    got = metrics.rank_correlation(spark.createDataFrame(rows, "a double, b double"), "a", "b").first()
    want = np.corrcoef(_ranks([r[0] for r in rows]), _ranks([r[1] for r in rows]))[0, 1]
    assert got.n == 300 and abs(got.rho - want) < 1e-12
    one = metrics.rank_correlation(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double"), "a", "b").first()
    assert one.n == 2 and one.rho is None
    none = metrics.rank_correlation(spark.createDataFrame([], "a double, b double"), "a", "b").first()
    assert none.n == 0 and none.rho is None


def test_audit_has_no_window_over_all_rows(spark):
    option = F.array(F.struct(F.lit(1).alias("code"), F.rand(1).alias("stance_direction"), F.rand(2).alias("behavior_intensity")))
    rows = spark.range(6).select((F.col("id") % 3).alias("item"), F.concat(F.lit("v"), (F.col("id") % 2 + 1).cast("string")).alias("template"), F.lit(True).alias("valid"), F.lit("a").alias("item_type"), F.lit("b").alias("scale_type"), option.alias("options"))
    plan = questionnaires.agreement_audit(rows)._jdf.queryExecution().analyzed().toString()
    # what is ordered as a whole has a row a partition
    assert "AS one" not in plan and all("_part" in line for line in plan.splitlines() if line.strip(" :+-").startswith("Window "))

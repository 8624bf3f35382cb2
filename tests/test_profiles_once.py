"""The starts of the clustering read profiles that were written, in place of computing them anew."""

from pyspark.sql import functions as F

from surveyloom.operators import models


def test_profiles_are_written(spark):
    rows = spark.range(40).groupBy("id").agg(F.array(F.first(F.col("id") % 2).cast("double"), F.lit(1.0)).alias("profile"))
    out = models.personas(rows, 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "FileScan parquet" in plan
    assert len({(r.id % 2, r.cluster) for r in out.collect()}) == 2

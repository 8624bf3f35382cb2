"""Records of items are dealt to tasks before they are sorted."""

from pyspark.sql import functions as F

from surveyloom.operators import questionnaires


def test_records_are_shuffled_before_they_are_sorted(spark):
    option = F.struct(F.lit(1).alias("code"), F.lit(0.5).alias("stance_direction"), F.lit(0.1).alias("behavior_intensity"), F.lit(True).alias("is_neutral"), F.lit(0.2).alias("uncertainty"))
    records = spark.range(0, 90_000, 1, 1).select(
        (F.col("id") % 45_000).cast("string").alias("item"), F.when(F.col("id") < 45_000, "v1").otherwise("v2").alias("template"), F.lit(questionnaires.ITEM_TYPES[0]).alias("item_type"), F.lit(questionnaires.SCALE_TYPES[0]).alias("scale_type"),
        F.array(F.lit("tin")).alias("domains"), F.array(F.struct(F.lit("b").alias("name"), F.lit(0.3).alias("relevance"))).alias("constructs"), F.lit(0.0).alias("global_uncertainty"), F.array(option).alias("options"),
    )
    asked = spark.createDataFrame([("7", 1), ("7", 2), ("x", 1)], "item string, option_code int")
    out = questionnaires.structured_matrix(asked, records, ["tin"], ["b"])
    assert sorted((r.item, r.option_code, r.known) for r in out.collect()) == [("7", 1, True), ("7", 2, False), ("x", 1, False)]
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "BroadcastHashJoin" not in plan

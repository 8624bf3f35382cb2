"""Tables of the driver and the survey views built on them (SQL twins for DuckDB alongside)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.functions import hashing
from surveyloom.operators import ranking
from surveyloom.sources.shipping import ship

SEED = 1701


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per respondent: id, domain, demographics, weight and split."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    key, bal = F.col("c_custkey"), F.col("c_acctbal")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(
        key.alias("person_id"),
        F.col("c_mktsegment").alias("domain"),
        F.concat_ws("::", "c_mktsegment", key.cast("string")).alias("panel_id"),
        F.col("n_name").alias("country"),
        F.when(key % 2 == 0, "female").otherwise("male").alias("sex"),
        F.when(bal < 1500, "18-29").when(bal < 4000, "30-44").when(bal < 7000, "45-64").otherwise("65+").alias("age_bin"),
        F.when(key % 3 == 0, "low").when(key % 3 == 1, "middle").otherwise("high").alias("education"),
        F.concat(F.lit("Q"), (key % 5 + 1).cast("string")).alias("income_quintile"),
        F.when(key % 7 < 4, "urban").otherwise("rural").alias("urbanicity"),
        (1 + F.col("c_nationkey") / 25.0).cast("double").alias("survey_weight"),
        hashing.split_of(hashing.little_endian_bucket(key, SEED)).alias("split"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first answer (by order key) of each respondent to each of twelve questions."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    code = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    return o.groupBy(F.col("o_custkey").alias("person_id"), F.month("o_orderdate").alias("q")).agg(F.min_by(code, "o_orderkey").alias("answer_index"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table: respondent by answered item, with 30 % of each domain's items held out as unseen."""
    qid = F.concat(F.lit("q"), F.lpad(F.col("q").cast("string"), 2, "0"))
    rows = answers(spark, sf_dir).join(people(spark, sf_dir), "person_id").select(
        F.concat_ws("::", "panel_id", qid).alias("row_id"),
        "panel_id", "person_id", "domain",
        qid.alias("question_id"),
        F.concat_ws("::", "domain", qid).alias("question_key"),
        "answer_index", F.lit(5).alias("n_options"),
        "country", "sex", "age_bin", "education", "income_quintile", "urbanicity", "survey_weight", "split",
    )
    return ranking.item_holdout(rows, 0.3, SEED)


def hex_sql(expression: str) -> str:
    return f"substr(sha256({expression}), 1, 16)"


def little_sql(expression: str, seed: int = SEED, modulus: int = 10) -> str:
    d = f"sha256('{seed}|' || {expression})"
    return f"(('0x' || {' || '.join(f'substr({d}, {2 * i + 1}, 2)' for i in range(7, -1, -1))})::UBIGINT % {modulus})::INTEGER"


PEOPLE_SQL = f"""
people AS (
  SELECT c_custkey AS person_id, c_mktsegment AS domain, c_mktsegment || '::' || c_custkey AS panel_id, n_name AS country,
    CASE WHEN c_custkey % 2 = 0 THEN 'female' ELSE 'male' END AS sex,
    CASE WHEN c_acctbal < 1500 THEN '18-29' WHEN c_acctbal < 4000 THEN '30-44' WHEN c_acctbal < 7000 THEN '45-64' ELSE '65+' END AS age_bin,
    CASE c_custkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'middle' ELSE 'high' END AS education,
    'Q' || (c_custkey % 5 + 1) AS income_quintile,
    CASE WHEN c_custkey % 7 < 4 THEN 'urban' ELSE 'rural' END AS urbanicity,
    1 + c_nationkey / 25.0::DOUBLE AS survey_weight,
    CASE WHEN {little_sql("c_custkey")} <= 5 THEN 'train' WHEN {little_sql("c_custkey")} <= 7 THEN 'validation' ELSE 'test' END AS split
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

RESPONSES_SQL = f"""{PEOPLE_SQL},
answers AS (
  SELECT o_custkey AS person_id, month(o_orderdate) AS q, arg_min(substr(o_orderpriority, 1, 1)::INTEGER - 1, o_orderkey) AS answer_index
  FROM orders GROUP BY 1, 2),
plain AS (
  SELECT panel_id || '::q' || lpad(q::VARCHAR, 2, '0') AS row_id, panel_id, person_id, domain, 'q' || lpad(q::VARCHAR, 2, '0') AS question_id,
    domain || '::q' || lpad(q::VARCHAR, 2, '0') AS question_key, answer_index, 5 AS n_options,
    country, sex, age_bin, education, income_quintile, urbanicity, survey_weight, split
  FROM answers JOIN people USING (person_id)),
held AS (
  SELECT question_key, row_number() OVER (PARTITION BY domain ORDER BY {hex_sql(f"'[{SEED}, \"item_holdout\", \"' || question_key || '\"]'")}) AS rn,
    count(*) OVER (PARTITION BY domain) AS n
  FROM (SELECT DISTINCT domain, question_key FROM plain)),
responses AS (
  SELECT plain.*, rn <= least(n - 1, greatest(1, round_even(n * 0.3, 0))) AS is_unseen_item
  FROM plain JOIN held USING (question_key))"""

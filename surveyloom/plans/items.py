"""Queries over item catalogues: audits, families, information and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom.functions import probs, text
from surveyloom.operators import baselines, metrics, ranking
from surveyloom.plans.catalogue import register
from surveyloom.plans.panel import sql
from surveyloom.plans.scores import rounded
from surveyloom.sources.tables import PEOPLE_SQL, SEED, people, responses, table


def _wide(s, d):
    """Items of the part table as columns, one row per part, and the same molten to (id, item, value)."""
    p = table(s, d, "part")
    return p.select(F.col("p_partkey").alias("caseid"), "p_brand", "p_type", F.col("p_size").cast("string").alias("p_size")).melt(["caseid"], ["p_brand", "p_type", "p_size"], "item", "value")


_WIDE = "wide AS (SELECT p_partkey AS caseid, unnest(['p_brand', 'p_type', 'p_size']) AS item, unnest([p_brand, p_type, p_size::VARCHAR]) AS value FROM part)"


def _audit(s, d):
    rows = _wide(s, d)
    n = table(s, d, "part").count()
    out = rows.groupBy("item").agg(F.count("value").alias("n"), F.countDistinct("value").alias("n_values"), F.min("value").alias("least"), F.max("value").alias("most"))
    out = out.withColumn("coverage", F.col("n") / n).withColumn("eligible", (F.col("n") >= 2000) & F.col("n_values").between(2, 11) & (F.col("coverage") >= 0.5))
    return rounded(out)


register(
    "closed_choice_audit",
    _audit,
    f"WITH {_WIDE} SELECT item, count(value) AS n, count(DISTINCT value) AS n_values, min(value) AS least, max(value) AS most, round(count(value) / (SELECT count(*) FROM part)::DOUBLE, 9) AS coverage, "
    "count(value) >= 2000 AND count(DISTINCT value) BETWEEN 2 AND 11 AND count(value) / (SELECT count(*) FROM part)::DOUBLE >= 0.5 AS eligible FROM wide GROUP BY 1",
)
register(
    "value_entropy",
    lambda s, d: rounded(metrics.entropy(_wide(s, d), "value", ["item"])),
    f"WITH {_WIDE}, c AS (SELECT item, value, count(*) AS n FROM wide WHERE value IS NOT NULL GROUP BY 1, 2), p AS (SELECT item, n / sum(n) OVER (PARTITION BY item)::DOUBLE AS p FROM c) "
    "SELECT item, round(-sum(p * ln(p)), 9) AS entropy, count(*) AS n_values FROM p GROUP BY 1",
)
register(
    "quantile_summary",
    lambda s, d: rounded(metrics.quantiles(table(s, d, "lineitem"), "l_extendedprice", [0.0, 0.25, 0.5, 0.75, 1.0], ["l_returnflag"]).select("l_returnflag", *[F.col("q")[i].alias(f"q{i}") for i in range(5)]), 6),
    "SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice::DOUBLE, {x}), 6) AS q{i}" for i, x in enumerate((0.0, 0.25, 0.5, 0.75, 1.0))) + " FROM lineitem GROUP BY 1",
)
register(
    "running_stats",
    lambda s, d: rounded(metrics.running_stats(table(s, d, "lineitem"), "l_quantity", ["l_returnflag", "l_linestatus"])),
    "SELECT l_returnflag, l_linestatus, count(l_quantity) AS n, round(avg(l_quantity), 9) AS mean, round(var_pop(l_quantity), 9) AS variance FROM lineitem GROUP BY 1, 2",
)


def _families(s, d):
    p = table(s, d, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("coverage"), F.round(F.avg("p_retailprice"), 6).alias("entropy")).withColumn("item", F.concat_ws("_", "p_brand", "p_type"))
    return ranking.one_per_family(p, "p_brand", [F.desc("coverage"), F.desc("entropy"), F.asc("item")], 10).select("p_brand", "item", "coverage", "entropy")


_FAM = "fa AS (SELECT p_brand, p_brand || '_' || p_type AS item, count(*) AS coverage, round(avg(p_retailprice), 6) AS entropy FROM part GROUP BY 1, 2)"
register(
    "family_representative",
    _families,
    f"WITH {_FAM}, o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY coverage DESC, entropy DESC, item) AS rn FROM fa) WHERE rn = 1) SELECT p_brand, item, coverage, entropy FROM o ORDER BY coverage DESC, entropy DESC, item LIMIT 10",
)
register(
    "family_balanced_select",
    lambda s, d: ranking.family_balanced(table(s, d, "part").select(F.col("p_brand").alias("family"), F.concat_ws("_", "p_brand", "p_type").alias("item")).distinct(), 30, SEED).select("family", "item"),
    f"WITH it AS (SELECT DISTINCT p_brand AS family, p_brand || '_' || p_type AS item FROM part), h AS (SELECT *, sha256('{SEED}|' || item) AS hh FROM it), "
    "t AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY hh, item) AS turn FROM h) SELECT family, item FROM t ORDER BY turn, hh, item LIMIT 30",
)
register(
    "exact_sample",
    lambda s, d: ranking.exact_sample(people(s, d).select("domain", "panel_id"), ["domain"], 40, SEED, "panel_id"),
    f"WITH {PEOPLE_SQL} SELECT domain, panel_id FROM (SELECT domain, panel_id, row_number() OVER (PARTITION BY domain ORDER BY sha256('{SEED}|' || panel_id), panel_id) AS rn FROM people) WHERE rn <= 40",
)
register(
    "position_features",
    lambda s, d: rounded(_positions(s, d)),
    "WITH ps AS (SELECT DISTINCT p_brand, p_size, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) - 1 AS i FROM part), pn AS (SELECT *, count(*) OVER (PARTITION BY p_brand) AS n FROM ps) "
    "SELECT p_brand, p_size::BIGINT AS p_size, 1.0::DOUBLE AS f0, round(i / greatest(n - 1, 1)::DOUBLE, 9) AS f1, round((i / greatest(n - 1, 1)::DOUBLE) ** 2, 9) AS f2, round(1 / n::DOUBLE, 9) AS f3, (i = 0)::INT::DOUBLE AS f4, (i = n - 1)::INT::DOUBLE AS f5, "
    "(n = 2)::INT::DOUBLE AS f6, (n = 4)::INT::DOUBLE AS f7, (n = 5)::INT::DOUBLE AS f8, (n >= 6)::INT::DOUBLE AS f9 FROM pn",
)


def _positions(s, d):
    from pyspark.sql import Window

    p = table(s, d, "part").select("p_brand", "p_size").distinct()
    w = Window.partitionBy("p_brand")
    p = p.withColumn("i", F.dense_rank().over(w.orderBy("p_size")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    p = p.withColumn("f", probs.position_features(F.col("i"), F.col("n")))
    return p.select("p_brand", "p_size", *[F.col("f")[i].alias(f"f{i}") for i in range(10)])


def _information(s, d):
    rows = responses(s, d).where("split = 'train'")
    pairs = baselines.co_answers(rows).select(F.col("h").alias("s"), F.col("t"), F.col("h_value").alias("x"), F.col("t_value").alias("y"))
    return baselines.mutual_information(pairs)


_INFO = (
    "mc AS (SELECT x.question_key AS s, y.question_key AS t, x.answer_index AS x, y.answer_index AS y, count(*) AS n FROM responses x JOIN responses y USING (domain, panel_id) WHERE x.split = 'train' AND x.question_key <> y.question_key GROUP BY 1, 2, 3, 4), "
    "mw AS (SELECT *, sum(n) OVER (PARTITION BY s, t)::DOUBLE AS a, sum(n) OVER (PARTITION BY s, t, x)::DOUBLE AS nx, sum(n) OVER (PARTITION BY s, t, y)::DOUBLE AS ny FROM mc), "
    "info AS (SELECT s, t, coalesce(sum(n / a * ln(n * a / (nx * ny))) / nullif(-sum(n / a * ln(ny / a)), 0), 0) AS score FROM mw GROUP BY 1, 2)"
)
register("mutual_information", lambda s, d: rounded(_information(s, d), 8), sql("SELECT s, t, round(score, 8) + 0 AS score FROM info", _INFO))


def _cover(s, d):
    """Four items for the targets of each domain; an item's name has its domain."""
    scores = _information(s, d).select(F.col("s").alias("item"), F.col("t").alias("target"), "score").cache()
    domain = F.substring_index("target", "::", 1)
    chosen = [(i, item, round(gain, 8) + 0.0) for r in scores.select(domain.alias("d")).distinct().orderBy("d").collect() for i, (item, gain) in enumerate(ranking.greedy_cover(scores.where(domain == r["d"]), 4))]
    scores.unpersist()
    return s.createDataFrame(chosen, "step bigint, item string, gain double")


def _cover_sql(k: int = 4) -> str:
    out = [_INFO, "b0 AS (SELECT DISTINCT t, 0.0::DOUBLE AS best FROM info)", "ch0 AS (SELECT NULL::VARCHAR AS dom, NULL::VARCHAR AS item, NULL::DOUBLE AS gain, NULL::BIGINT AS step WHERE false)"]
    for i in range(1, k + 1):
        out += [
            f"gn{i} AS (SELECT split_part(t, '::', 1) AS dom, s AS item, sum(greatest(score - best, 0)) AS gain FROM info JOIN b{i - 1} USING (t) WHERE s NOT IN (SELECT item FROM ch{i - 1}) GROUP BY 1, 2)",
            f"pk{i} AS (SELECT dom, arg_min(item, (-round(gain, 12), item)) AS item, arg_min(gain, (-round(gain, 12), item)) AS gain FROM gn{i} GROUP BY 1)",
            f"ch{i} AS (SELECT * FROM ch{i - 1} UNION ALL SELECT dom, item, gain, {i} FROM pk{i})",
            f"b{i} AS (SELECT b.t, greatest(best, coalesce(score, 0)) AS best FROM b{i - 1} b JOIN pk{i} ON dom = split_part(b.t, '::', 1) LEFT JOIN info x ON x.t = b.t AND x.s = pk{i}.item)",
        ]
    return sql(f"SELECT step - 1 AS step, item, round(gain, 8) AS gain FROM ch{k}", ", ".join(out))


register("greedy_cover", _cover, _cover_sql())


def _ordinal(s, d):
    p = table(s, d, "part")
    return p.select("p_partkey", text.is_ordinal(F.col("p_name"), F.array("p_type", F.when(F.col("p_size") > 40, F.lit("Strongly agree")).otherwise(F.lit("blue")))).alias("ordinal"), text.slug(F.col("p_type")).alias("slug"), text.family(F.col("p_brand"), r"^(Brand#\d)").alias("family"))


register(
    "ordinal_slug_family",
    _ordinal,
    "SELECT p_partkey, " + " OR ".join(f"contains(lower(p_name || ' ' || p_type || ' ' || CASE WHEN p_size > 40 THEN 'Strongly agree' ELSE 'blue' END), '{c}')" for c in text.ORDINAL_CUES)
    + " AS ordinal, regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') AS slug, coalesce(nullif(regexp_extract(p_brand, '^(Brand#\\d)', 1), ''), p_brand) AS family FROM part",
)
register(
    "option_code_order",
    lambda s, d: table(s, d, "part").groupBy("p_brand").agg(F.collect_set(F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("x"), F.col("p_size").cast("string"))).otherwise(F.col("p_size").cast("string"))).alias("c")).select("p_brand", F.array_join(text.option_order(F.col("c")), ",").alias("codes")),
    "SELECT p_brand, array_to_string(list(c ORDER BY try_cast(c AS DOUBLE) IS NULL, try_cast(c AS DOUBLE), c), ',') AS codes FROM (SELECT DISTINCT p_brand, CASE WHEN p_size % 7 = 0 THEN 'x' || p_size ELSE p_size::VARCHAR END AS c FROM part) GROUP BY 1",
)


def _headroom(s, d):
    rows = metrics.scored(_runs(s, d)).groupBy("method").agg(F.avg("nll").alias("nll"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct("question_key").alias("n_items"))
    return rounded(metrics.headroom(rows, "nll", "uniform", "mixed_seed1"), 7)


def _runs(s, d):
    from surveyloom.plans.scores import runs

    return runs(s, d)


def _headroom_sql():
    from surveyloom.plans.scores import RUNS_SQL, SCORE_SQL

    return sql(
        "SELECT method, round(nll, 7) AS nll, n_rows, n_items, round(100 * (f - nll) / (f - c), 7) + 0 AS headroom_pct FROM hm, (SELECT max(nll) FILTER (WHERE method = 'uniform') AS f, max(nll) FILTER (WHERE method = 'mixed_seed1') AS c FROM hm)",
        f"{RUNS_SQL}, {SCORE_SQL.format(source='runs')}, hm AS (SELECT method, avg(nll) AS nll, count(*) AS n_rows, count(DISTINCT question_key) AS n_items FROM scored GROUP BY 1)",
    )


register("headroom_summary", _headroom, _headroom_sql())

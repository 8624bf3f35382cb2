"""Queries over baseline predictions and their scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.functions import probs
from surveyloom.operators import baselines, joins, metrics, ranking
from surveyloom.plans.catalogue import register
from surveyloom.plans.panel import sql
from surveyloom.sources.tables import responses


def _counts(weight: str) -> str:
    part = lambda j: f"coalesce({'sum(survey_weight)' if weight == 'w' else 'count(*)'} FILTER (WHERE answer_index = {j}), 0)::DOUBLE"
    return f"[{', '.join(part(j) for j in range(5))}]"


_LEVELS = ["question_key, country, sex, age_bin", "question_key, country, sex", "question_key, country", "question_key"]
FREQUENCY_SQL = (
    "train AS (SELECT * FROM responses WHERE split = 'train' AND NOT is_unseen_item), "
    + ", ".join(f"f{i} AS (SELECT {c}, {_counts('w')} AS c{i}, count(*) AS n{i} FROM train GROUP BY {c})" for i, c in enumerate(_LEVELS))
    + ", fj AS (SELECT r.*, CASE WHEN n0 >= 25 THEN c0 WHEN n1 >= 25 THEN c1 WHEN n2 >= 25 THEN c2 ELSE c3 END AS c FROM responses r "
    + " ".join(f"LEFT JOIN f{i} USING ({c})" for i, c in enumerate(_LEVELS))
    + " WHERE r.split = 'test'), "
    "preds AS (SELECT *, CASE WHEN c IS NULL THEN [0.2, 0.2, 0.2, 0.2, 0.2]::DOUBLE[] ELSE list_transform(c, lambda x: (x + 1) / (list_sum(c) + 5)) END AS p, "
    "CASE WHEN is_unseen_item THEN 'unseen' ELSE 'seen' END AS item_pool FROM fj)"
)
_BEST = "(list_position(p, list_max(p)) - 1)"
_RPS = "list_sum(list_transform([1, 2, 3, 4], lambda i: (list_sum(p[1:i]) - (i > answer_index)::INT) ** 2)) / 4"
SCORE_SQL = (
    f"scored AS (SELECT *, -ln(greatest(p[answer_index + 1], 1e-12)) AS nll, list_sum(list_transform(range(5), lambda i: (p[i + 1] - (i = answer_index)::INT) ** 2)) AS brier, "
    f"{_RPS} AS rps, abs({_BEST} - answer_index) / 4.0::DOUBLE AS mae, ({_BEST} = answer_index)::INT AS correct FROM {{source}})"
)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequency predictions of all test rows, seen and unseen items."""
    rows = responses(spark, sf_dir)
    tables = baselines.frequency_tables(baselines.only_train(rows))
    out = baselines.frequency_predict(rows.where("split = 'test'"), tables)
    return out.withColumn("item_pool", F.when(F.col("is_unseen_item"), "unseen").otherwise("seen"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several methods and numbers of history items: the prediction mixed with uniform shares."""
    grid = F.explode(
        F.array(*[F.struct(F.lit(m).alias("method"), F.lit(k).alias("k"), F.lit(w).alias("w")) for m, k, w in RUNS])
    )
    rows = predictions(spark, sf_dir).withColumn("g", grid).select("*", "g.*").drop("g")
    return rows.withColumn("p", F.transform("p", lambda x: (1 - F.col("w")) * x + F.col("w") * 0.2))


RUNS = [(f"mixed_seed{s}", k, round(0.5 - 0.05 * k + 0.01 * s, 2)) for s in (1, 2) for k in (0, 1, 3, 5, 8)] + [("uniform", k, 1.0) for k in (0, 1, 3, 5, 8)]
RUNS_SQL = (
    FREQUENCY_SQL
    + f", grid(method, k, w) AS (VALUES {', '.join(f'({m!r}, {k}, {w}::DOUBLE)' for m, k, w in RUNS)}), "
    + "runs AS (SELECT preds.* EXCLUDE (p), method, k, list_transform(p, lambda x: (1 - w) * x + w * 0.2::DOUBLE) AS p FROM preds, grid)"
)
_M = ["nll", "brier", "rps", "mae", "correct"]
_R = "method, k, split, item_pool"


def _macro_sql(source: str, keys: str, ms: list[str]) -> str:
    avg = ", ".join(f"avg({m}) AS {m}" for m in ms)
    return (
        SCORE_SQL.format(source=source) + f", mp AS (SELECT {keys}, domain, panel_id, {avg} FROM scored GROUP BY {keys}, domain, panel_id), "
        f"md AS (SELECT {keys}, domain, {avg}, count(*) AS n_panels FROM mp GROUP BY {keys}, domain), "
        f"mm AS (SELECT {keys}, domain, {', '.join(ms)}, n_panels FROM md UNION ALL SELECT {keys}, 'macro', {avg}, sum(n_panels)::BIGINT FROM md GROUP BY {keys})"
    )


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded for comparison across engines."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c).cast("bigint").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes])


def r(column: str, digits: int = 9, name: str | None = None) -> str:
    return f"round({column}, {digits}) AS {name or column}"


def _macro(s, d):
    scored = metrics.scored(predictions(s, d))
    return rounded(metrics.respondent_macro(scored, _M, ["split", "item_pool"]))


def expected(p: str):
    """The expected score, without the noise of doubles that takes exact halves of the ninth digit down; 14 digits, so that no value below a half becomes one."""
    return F.round(probs.expected_score(F.col(p)), 14)


register(
    "macro_nll_frequency",
    _macro,
    sql(f"SELECT split, item_pool, domain, {', '.join(r(m) for m in _M)}, n_panels FROM mm", f"{FREQUENCY_SQL}, {_macro_sql('preds', 'split, item_pool', _M)}"),
)
register(
    "rps_brier_nll_rows",
    lambda s, d: rounded(metrics.scored(predictions(s, d)).select("row_id", "nll", "brier", "rps", "mae", "correct", expected("p").alias("expected"))),
    sql(
        f"SELECT row_id, {', '.join(r(m) for m in _M[:4])}, correct::BIGINT AS correct, round((p[2] + 2 * p[3] + 3 * p[4] + 4 * p[5]) / 4, 9) AS expected FROM scored",
        f"{FREQUENCY_SQL}, {SCORE_SQL.format(source='preds')}",
    ),
)


def _prior(s, d):
    rows = responses(s, d)
    prior = baselines.population_prior(baselines.only_train(rows))
    return rounded(prior["country"].select("question_key", "country", *[F.get("pc", F.lit(i)).alias(f"p{i}") for i in range(5)]))


def smooth_sql(c: str, alpha: float) -> str:
    return f"list_transform({c}, lambda x: (x + {alpha}) / (list_sum({c}) + 5 * {alpha}))"


PRIOR_SQL = (
    "ptrain AS (SELECT * FROM responses WHERE split = 'train' AND NOT is_unseen_item), "
    f"pq AS (SELECT question_key, {smooth_sql('c', 0.5)} AS pq FROM (SELECT question_key, {_counts('n')} AS c FROM ptrain GROUP BY 1)), "
    f"pc0 AS (SELECT question_key, country, {_counts('n')} AS c, count(*) AS n FROM ptrain GROUP BY 1, 2), "
    f"pc1 AS (SELECT question_key, country, list_transform(range(1, 6), lambda i: n / (n + 20.0::DOUBLE) * ((c[i] + 0.5) / (list_sum(c) + 2.5)) + (1 - n / (n + 20.0::DOUBLE)) * pq[i]) AS b FROM pc0 JOIN pq USING (question_key)), "
    "pc AS (SELECT question_key, country, list_transform(b, lambda x: x / list_sum(b)) AS pc FROM pc1), "
    f"pp AS (SELECT {smooth_sql('c', 0.5)} AS pp FROM (SELECT {_counts('n')} AS c FROM ptrain)), "
    "priors AS (SELECT r.*, CASE WHEN NOT is_unseen_item AND coalesce(pc, pq) IS NOT NULL THEN coalesce(pc, pq) ELSE pp END AS prior FROM responses r LEFT JOIN pc USING (question_key, country) LEFT JOIN pq USING (question_key), pp)"
)
_P5 = ", ".join(f"round({{0}}[{i + 1}], 9) AS p{i}" for i in range(5))
register("population_prior_country", _prior, sql(f"SELECT question_key, country, {_P5.format('pc')} FROM pc", PRIOR_SQL))


def with_prior(s, d):
    rows = responses(s, d)
    return baselines.prior_predict(rows, baselines.population_prior(baselines.only_train(rows)), ~F.col("is_unseen_item"))


register(
    "prior_backoff_predict",
    lambda s, d: rounded(with_prior(s, d).where("split = 'test'").select("row_id", *[F.get("prior", F.lit(i)).alias(f"p{i}") for i in range(5)])),
    sql(f"SELECT row_id, {_P5.format('prior')} FROM priors WHERE split = 'test'", PRIOR_SQL),
)
register(
    "majority_baseline",
    lambda s, d: rounded(baselines.majority(baselines.only_train(responses(s, d)))),
    sql("SELECT question_key, arg_max(answer_index, n * 10 - answer_index)::BIGINT AS majority, sum(n)::BIGINT AS n FROM (SELECT question_key, answer_index, count(*) AS n FROM responses WHERE split = 'train' AND NOT is_unseen_item GROUP BY 1, 2) GROUP BY 1"),
)


def _statistics(s, d):
    rows = responses(s, d)
    return rounded(baselines.with_statistics(rows, baselines.only_train(rows)).select("row_id", "question_mean", "question_std"))


register(
    "question_stats_left_join",
    _statistics,
    sql(
        "SELECT row_id, round(coalesce(m, 0.5), 9) AS question_mean, round(coalesce(s, 0.25), 9) AS question_std FROM responses LEFT JOIN st USING (question_key)",
        "st AS (SELECT question_key, avg(answer_index / 4.0::DOUBLE) AS m, greatest(coalesce(stddev_samp(answer_index / 4.0::DOUBLE), 0.25), 0.05) AS s FROM responses WHERE split = 'train' AND NOT is_unseen_item GROUP BY 1)",
    ),
)
_JS = (
    "gq AS (SELECT {keys}, domain, question_key, country, age_bin, " + ", ".join(f"sum(survey_weight) FILTER (WHERE answer_index = {i}) AS h{i}, sum(survey_weight * p[{i + 1}]) AS q{i}" for i in range(5)) + " FROM {source} GROUP BY ALL), "
    "gl AS (SELECT * EXCLUDE (h, q), list_transform(h, lambda x: greatest(x / list_sum(h), 1e-12)) AS h, list_transform(q, lambda x: greatest(x / list_sum(q), 1e-12)) AS q FROM "
    "(SELECT {keys}, domain, question_key, [" + ", ".join(f"coalesce(h{i}, 0)" for i in range(5)) + "] AS h, [" + ", ".join(f"q{i}" for i in range(5)) + "] AS q FROM gq)), "
    "gn AS (SELECT * EXCLUDE (h, q), list_transform(h, lambda x: x / list_sum(h)) AS h, list_transform(q, lambda x: x / list_sum(q)) AS q FROM gl), "
    "gj AS (SELECT {keys}, domain, list_sum(list_transform(range(1, 6), lambda i: h[i] * log2(h[i] / ((h[i] + q[i]) / 2)) + q[i] * log2(q[i] / ((h[i] + q[i]) / 2)))) / 2 AS js FROM gn), "
    "gd AS (SELECT {keys}, domain, avg(js) AS js FROM gj GROUP BY ALL)"
)
register(
    "group_js",
    lambda s, d: rounded(metrics.group_js(predictions(s, d), ["country", "age_bin"], ["split", "item_pool"])),
    sql(
        "SELECT split, item_pool, domain, round(js, 9) AS js FROM gd UNION ALL SELECT split, item_pool, 'macro', round(avg(js), 9) FROM gd GROUP BY 1, 2",
        f"{FREQUENCY_SQL}, {_JS.format(keys='split, item_pool', source='preds')}",
    ),
)
_CORR = "CASE WHEN stddev_pop({0}) * stddev_pop({1}) > 0 THEN covar_pop({0}, {1}) / (stddev_pop({0}) * stddev_pop({1})) END"
def _tilted(s, d):
    """Predictions that differ between panels: half a count more on an option that follows from income group and question."""
    own = F.pmod(F.substring("income_quintile", 2, 1).cast("int") + F.substring("question_id", 2, 2).cast("int"), F.lit(5))
    return predictions(s, d).withColumn("p", probs.normalise(F.transform("p", lambda x, i: x + F.when(i == own, 0.5).otherwise(0.0))))


register(
    "corr_structure",
    lambda s, d: rounded(metrics.correlation_structure(_tilted(s, d), 5, ["split", "item_pool"]), 6),
    sql(
        "SELECT split, item_pool, domain, round(e, 6) AS corr_err, round(c, 6) AS corr_sim FROM cd UNION ALL SELECT split, item_pool, 'macro', round(avg(e), 6), round(avg(c), 6) FROM cd GROUP BY 1, 2",
        FREQUENCY_SQL + ", tl AS (SELECT preds.* EXCLUDE (p), list_transform(range(1, 6), lambda i: (p[i] + 0.5 * (i - 1 = (substr(income_quintile, 2, 1)::INT + substr(question_id, 2, 2)::INT) % 5)::INT) / 1.5) AS p FROM preds), "
        "cs AS (SELECT split, item_pool, domain, panel_id, question_key AS q, (p[2] + 2 * p[3] + 3 * p[4] + 4 * p[5]) / 4 AS e, answer_index / 4.0::DOUBLE AS h FROM tl), "
        f"cp AS (SELECT a.split, a.item_pool, a.domain, a.q AS qa, b.q AS qb, count(*) AS n, {_CORR.format('a.h', 'b.h')} AS x, {_CORR.format('a.e', 'b.e')} AS y FROM cs a JOIN cs b USING (split, item_pool, domain, panel_id) WHERE a.q < b.q GROUP BY ALL), "
        f"cd AS (SELECT split, item_pool, domain, sqrt(avg((x - y) ** 2)) AS e, {_CORR.format('x', 'y')} AS c FROM cp WHERE n >= 5 AND x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2, 3)",
    ),
)
register(
    "worst_group_accuracy",
    lambda s, d: rounded(metrics.worst_group_accuracy(metrics.scored(predictions(s, d)), ["age_bin", "education"], 10, ["split", "item_pool"])),
    sql(
        "SELECT split, item_pool, round(min(a), 9) AS worst_group_accuracy, round(avg(a), 9) AS mean_group_accuracy, count(*) AS n_groups FROM "
        "(SELECT split, item_pool, age_bin, education, avg(a) AS a FROM (SELECT split, item_pool, panel_id, age_bin, education, avg(correct) AS a FROM scored GROUP BY ALL) GROUP BY ALL HAVING count(*) >= 10) GROUP BY 1, 2",
        f"{FREQUENCY_SQL}, {SCORE_SQL.format(source='preds')}",
    ),
)
register(
    "population_wasserstein",
    lambda s, d: rounded(metrics.population_wasserstein(predictions(s, d), ["item_pool", "domain"])),
    sql(
        "SELECT item_pool, domain, round(sum(w * dd) / sum(w), 9) AS wasserstein FROM (SELECT item_pool, domain, w, list_sum(list_transform(range(1, 6), lambda i: abs(list_sum(h[1:i]) / list_sum(h) - list_sum(q[1:i]) / list_sum(q)))) / 4 AS dd FROM wl) GROUP BY 1, 2",
        FREQUENCY_SQL + f", wl AS (SELECT item_pool, domain, question_key, sum(survey_weight) AS w, {_counts('w')} AS h, [{', '.join(f'sum(survey_weight * p[{i + 1}])' for i in range(5))}] AS q FROM preds GROUP BY 1, 2, 3)",
    ),
)


def _macro_runs(s, d):
    return metrics.respondent_macro(metrics.scored(runs(s, d)), _M)


_MR = f"{RUNS_SQL}, {_macro_sql('runs', _R, _M)}"
register("respondent_macro_runs", lambda s, d: rounded(_macro_runs(s, d)), sql(f"SELECT {_R.replace(' k,', ' k::BIGINT AS k,')}, domain, {', '.join(r(m) for m in _M)}, n_panels FROM mm", _MR))
register(
    "delta_k",
    lambda s, d: rounded(metrics.delta_k(_macro_runs(s, d), "nll").select("method", "k", "item_pool", "domain", "delta_nll")),
    sql("SELECT method, k::BIGINT AS k, item_pool, domain, round(nll - max(nll) FILTER (WHERE k = 0) OVER (PARTITION BY method, split, item_pool, domain), 9) + 0 AS delta_nll FROM mm", _MR),
)
register("auac", lambda s, d: rounded(metrics.auac(_macro_runs(s, d), "nll")), sql("SELECT method, split, item_pool, domain, round(avg(nll), 9) AS auac_nll FROM mm GROUP BY 1, 2, 3, 4", _MR))
register(
    "main_table_pivot",
    lambda s, d: rounded(metrics.main_table(_macro_runs(s, d).where("item_pool = 'seen'"))),
    sql(
        f"SELECT method, {', '.join(f'round(max(nll) FILTER (WHERE k = {k}), 9) AS nll_k{k}' for k in (0, 1, 3, 5, 8))}, round(avg(nll), 9) AS auac, round(max(mae) FILTER (WHERE k = 5), 9) AS mae, round(max(rps) FILTER (WHERE k = 5), 9) AS rps FROM mm WHERE item_pool = 'seen' AND domain = 'macro' GROUP BY 1",
        _MR,
    ),
)
register(
    "seed_aggregate",
    lambda s, d: rounded(metrics.aggregate_seeds(_macro_runs(s, d), ["nll", "rps"])),
    sql("SELECT regexp_replace(method, '_seed\\d+$', '') AS method, k::BIGINT AS k, split, item_pool, domain, round(avg(nll), 9) AS nll, round(avg(rps), 9) AS rps, round(stddev_samp(nll), 9) AS nll_std, round(stddev_samp(rps), 9) AS rps_std, count(DISTINCT m) AS n_seeds FROM (SELECT *, method AS m FROM mm) GROUP BY 1, 2, 3, 4, 5".replace("(SELECT *, method AS m FROM mm)", "(SELECT method AS m, * FROM mm)"), _MR),
)
register(
    "seed_average",
    lambda s, d: rounded(metrics.scored(metrics.average_decoder_seeds(runs(s, d).where("k = 3"), ["row_id", "answer_index"])).select("method", "row_id", "nll", "n_decoder_seeds")),
    sql(
        "SELECT base AS method, row_id, round(-ln(greatest(avg(pa), 1e-12)), 9) AS nll, count(DISTINCT method) AS n_decoder_seeds FROM (SELECT regexp_replace(method, '_seed\\d+$', '') AS base, method, row_id, p[answer_index + 1] AS pa FROM runs WHERE k = 3) GROUP BY 1, 2",
        RUNS_SQL,
    ),
)


def _permutation(s, d):
    rows = metrics.scored(runs(s, d)).withColumn("base", F.regexp_replace("method", r"_seed\d+$", ""))
    return rounded(metrics.permutation_consistency(rows, ["k"], "row_id", "method"))


register(
    "permutation_consistency",
    _permutation,
    sql(
        f"SELECT k::BIGINT AS k, round(avg((dd = 1)::INT), 9) AS consistency, count(*) AS n_rows FROM (SELECT k, row_id, count(DISTINCT b) AS dd FROM (SELECT k, row_id, {_BEST} AS b FROM runs) GROUP BY 1, 2) GROUP BY 1",
        RUNS_SQL,
    ),
)


def _paired(s, d):
    rows = metrics.scored(runs(s, d)).where("k = 5 and item_pool = 'seen'")
    return rounded(joins.paired(rows, "mixed_seed1", "uniform", "nll", ["domain", "panel_id"]))


register(
    "paired_difference",
    _paired,
    sql(
        "SELECT domain, panel_id, round(c, 9) AS candidate, round(u, 9) AS reference, round(c - u, 9) AS difference FROM (SELECT domain, panel_id, avg(nll) FILTER (WHERE method = 'mixed_seed1') AS c, avg(nll) FILTER (WHERE method = 'uniform') AS u FROM scored WHERE k = 5 AND item_pool = 'seen' GROUP BY 1, 2)",
        f"{RUNS_SQL}, {SCORE_SQL.format(source='runs')}",
    ),
)


def _align(s, d):
    rows = runs(s, d).where("k = 5")
    left, right = (rows.where(F.col("method") == m).select("row_id", "panel_id", "question_key", "answer_index", "n_options", F.get("p", F.lit(0)).alias("p0")) for m in ("mixed_seed1", "uniform"))
    return rounded(joins.strict_align(left, right).select("row_id", "p0", "p0_right"))


register("strict_align", _align, sql("SELECT row_id, round(max(p[1]) FILTER (WHERE method = 'mixed_seed1'), 9) AS p0, round(max(p[1]) FILTER (WHERE method = 'uniform'), 9) AS p0_right FROM runs WHERE k = 5 AND method IN ('mixed_seed1', 'uniform') GROUP BY 1", RUNS_SQL))


def _holm(s, d):
    rows = metrics.scored(predictions(s, d)).groupBy("domain", "country").agg(F.round(F.avg("nll") / 20, 9).alias("p_value"))
    return rounded(ranking.holm(rows, by=["domain"]))


register(
    "holm_stepdown",
    _holm,
    sql(
        "SELECT domain, country, p_value, round(h, 9) AS holm_threshold, min((p_value <= h)::INT) OVER (PARTITION BY domain ORDER BY p_value, country ROWS UNBOUNDED PRECEDING) = 1 AS reject_null FROM "
        "(SELECT *, 0.05::DOUBLE / (count(*) OVER (PARTITION BY domain) - row_number() OVER (PARTITION BY domain ORDER BY p_value, country) + 1) AS h FROM (SELECT domain, country, round(avg(nll) / 20, 9) AS p_value FROM scored GROUP BY 1, 2))",
        f"{FREQUENCY_SQL}, {SCORE_SQL.format(source='preds')}",
    ),
)


def _temperature(s, d):
    rows = predictions(s, d).where("item_pool = 'seen'").withColumn("temperature", F.explode(F.array(*[F.lit(x) for x in TEMPERATURES])))
    losses = rows.select("domain", "temperature", probs.nll(probs.temper(F.col("p"), F.col("temperature")), F.col("answer_index")).alias("nll")).groupBy("domain", "temperature").agg(F.round(F.avg("nll"), 9).alias("nll"))
    return losses.groupBy("domain").agg(F.round(F.min_by("temperature", F.struct("nll", "temperature")), 9).alias("temperature"), F.min("nll").alias("nll"))


#: The protocol's grid: 25 log-spaced points from 0.25 to 4.
TEMPERATURES = [0.25 * 16 ** (i / 24) for i in range(25)]
register(
    "temperature_grid",
    _temperature,
    sql(
        "SELECT domain, round(arg_min(t, (nll, t)), 9) AS temperature, min(nll) AS nll FROM (SELECT domain, t, round(avg(-ln(greatest(pt[answer_index + 1] / list_sum(pt), 1e-12))), 9) AS nll FROM "
        f"(SELECT domain, answer_index, t, list_transform(p, lambda x: greatest(x, 1e-12) ** (1 / t)) AS pt FROM preds, (SELECT unnest({TEMPERATURES}::DOUBLE[]) AS t) WHERE item_pool = 'seen') GROUP BY 1, 2) GROUP BY 1",
        FREQUENCY_SQL,
    ),
)


def _lambda(s, d):
    rows = predictions(s, d).where("item_pool = 'seen'").withColumn("share", F.explode(F.array(*[F.lit(i / 100) for i in range(101)])))
    u = F.transform("p", lambda _: F.lit(0.2))
    losses = rows.select("share", probs.nll(probs.log_pool(F.col("p"), u, F.col("share")), F.col("answer_index")).alias("nll")).groupBy("share").agg(F.round(F.avg("nll"), 9).alias("nll"))
    return losses.agg(F.min_by("share", F.struct("nll", "share")).alias("share"), F.min("nll").alias("nll"))


register(
    "lambda_grid",
    _lambda,
    sql(
        "SELECT arg_min(l, (nll, l)) AS share, min(nll) AS nll FROM (SELECT l, round(avg(-ln(greatest(pt[answer_index + 1] / list_sum(pt), 1e-12))), 9) AS nll FROM "
        "(SELECT answer_index, l, list_transform(p, lambda x: exp((1 - l) * ln(greatest(x, 1e-12)) + l * ln(0.2::DOUBLE))) AS pt FROM preds, (SELECT unnest(range(101)) / 100.0::DOUBLE AS l) WHERE item_pool = 'seen') GROUP BY 1)",
        FREQUENCY_SQL,
    ),
)


def _alpha(s, d):
    """L1: the share, in steps of 0.05, of the frequency predictor in a geometric blend with the population prior that loses least."""
    prior = with_prior(s, d).select("row_id", "prior")
    rows = predictions(s, d).where("item_pool = 'seen'").join(prior, "row_id").withColumn("alpha", F.explode(F.array(*[F.lit(i / 20) for i in range(21)])))
    losses = rows.select("alpha", probs.nll(probs.log_pool(F.col("prior"), F.col("p"), F.col("alpha")), F.col("answer_index")).alias("nll")).groupBy("alpha").agg(F.round(F.avg("nll"), 9).alias("nll"))
    return losses.agg(F.min_by("alpha", F.struct("nll", "alpha")).alias("alpha"), F.min("nll").alias("nll"))


register(
    "alpha_grid",
    _alpha,
    sql(
        "SELECT arg_min(al, (nll, al)) AS alpha, min(nll) AS nll FROM (SELECT al, round(avg(-ln(greatest(z[answer_index + 1] / list_sum(z), 1e-12))), 9) AS nll FROM (SELECT al, preds.answer_index, list_transform(range(1, 6), lambda i: exp((1 - al) * ln(greatest(prior[i], 1e-12)) + al * ln(greatest(p[i], 1e-12)))) AS z "
        "FROM preds JOIN (SELECT row_id, prior FROM priors) USING (row_id), (SELECT unnest(range(21)) / 20.0::DOUBLE AS al) WHERE item_pool = 'seen') GROUP BY 1)",
        f"{FREQUENCY_SQL}, {PRIOR_SQL}",
    ),
)

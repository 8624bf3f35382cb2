"""Queries over item pairs, matched panels and donors."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom.operators import baselines, joins
from surveyloom.plans.catalogue import register
from surveyloom.plans.panel import hashed, sql
from surveyloom.plans.scores import _CORR, PRIOR_SQL, RUNS_SQL, _counts, rounded, runs, smooth_sql, with_prior
from surveyloom.sources.tables import PEOPLE_SQL, SEED, people, responses




def _train(s, d):
    return baselines.only_train(responses(s, d)).withColumn("normalized_answer", F.col("answer_index") / 4.0)


_T = "tr AS (SELECT domain, panel_id, question_key AS q, answer_index AS a FROM responses WHERE split = 'train' AND NOT is_unseen_item)"
register(
    "item_pair_counts",
    lambda s, d: baselines.co_answers(_train(s, d)).groupBy("domain", "t", "h").agg(F.count(F.lit(1)).alias("n")),
    sql("SELECT x.domain, x.q AS t, y.q AS h, count(*) AS n FROM tr x JOIN tr y USING (domain, panel_id) WHERE x.q <> y.q GROUP BY 1, 2, 3", _T),
)
_GRAPH = (
    f"{_T}, gp AS (SELECT x.domain, x.q AS a, y.q AS b, x.a AS xa, y.a AS ya FROM tr x JOIN tr y USING (domain, panel_id) WHERE x.q < y.q), "
    "gr AS (SELECT *, rank() OVER (PARTITION BY domain, a, b ORDER BY xa) + (count(*) OVER (PARTITION BY domain, a, b, xa) - 1) / 2.0::DOUBLE AS rx, "
    "rank() OVER (PARTITION BY domain, a, b ORDER BY ya) + (count(*) OVER (PARTITION BY domain, a, b, ya) - 1) / 2.0::DOUBLE AS ry FROM gp), "
    f"graph AS (SELECT domain, a, b, count(*) AS n, CASE WHEN count(*) >= 10 THEN coalesce(count(*) / (count(*) + 20.0::DOUBLE) * {_CORR.format('rx', 'ry')}, 0) ELSE 0 END AS c FROM gr GROUP BY 1, 2, 3)"
)
register("item_graph_spearman", lambda s, d: rounded(baselines.item_graph(_train(s, d))), sql("SELECT domain, a, b, n, round(c, 9) + 0 AS c FROM graph", _GRAPH))
_COND = (
    f"ow AS (SELECT q AS t, {smooth_sql('c', 0.5)} AS mg FROM (SELECT q, {_counts('n').replace('answer_index', 'a')} AS c FROM tr GROUP BY 1)), "
    "jp AS (SELECT x.q AS t, y.q AS h, y.a AS hv, x.a AS tv FROM tr x JOIN tr y USING (domain, panel_id) WHERE x.q <> y.q), "
    "jn AS (SELECT t, h, count(*) AS n FROM jp GROUP BY 1, 2 HAVING count(*) >= 20), "
    f"jc AS (SELECT t, h, hv, {_counts('n').replace('answer_index', 'tv')} AS c FROM jp GROUP BY 1, 2, 3), "
    "jf AS (SELECT t, h, n, hv, list_transform(range(1, 6), lambda i: coalesce(c[i], 0) + 5 * mg[i]) AS z FROM jn CROSS JOIN (SELECT unnest(range(5))::INTEGER AS hv) LEFT JOIN jc USING (t, h, hv) JOIN ow USING (t)), "
    "cond AS (SELECT t, h, hv, n, list_transform(z, lambda x: x / list_sum(z)) AS cp FROM jf)"
)
register(
    "item_conditional_tables",
    lambda s, d: rounded(baselines.conditional_tables(_train(s, d)).select("t", "h", "h_value", "n", *[F.get("conditional", F.lit(i)).alias(f"p{i}") for i in range(5)])),
    sql(f"SELECT t, h, hv::BIGINT AS h_value, n, {', '.join(f'round(cp[{i + 1}], 9) AS p{i}' for i in range(5))} FROM cond", f"{_T}, {_COND}"),
)


def _conditional_predict(s, d):
    train = _train(s, d)
    rows = with_prior(s, d).where("split = 'test' and not is_unseen_item")
    history = rows.select("panel_id", F.col("question_key").alias("h"), F.col("answer_index").alias("h_value"))
    history = rows.select("row_id", "panel_id", "question_key").join(history, "panel_id").where(F.col("h") != F.col("question_key")).select("row_id", "h", "h_value")
    out = baselines.conditional_predict(rows, history, baselines.conditional_tables(train), baselines.item_graph(train))
    return rounded(out.select("row_id", *[F.get("p", F.lit(i)).alias(f"p{i}") for i in range(5)]), 8)


register(
    "item_conditional_predict",
    _conditional_predict,
    sql(
        f"SELECT row_id, {', '.join(f'round(e[{i + 1}] / list_sum(e), 8) AS p{i}' for i in range(5))} FROM (SELECT row_id, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM zz)",
        f"{PRIOR_SQL}, {_GRAPH}, {_COND}, te AS (SELECT row_id, panel_id, question_key, answer_index, prior FROM priors WHERE split = 'test' AND NOT is_unseen_item), "
        "g2 AS (SELECT a AS t, b AS h, c FROM graph UNION ALL SELECT b, a, c FROM graph), "
        "ev AS (SELECT t.row_id, c, cp, t.prior AS pr FROM te t JOIN te h ON t.panel_id = h.panel_id AND t.question_key <> h.question_key JOIN g2 ON g2.t = t.question_key AND g2.h = h.question_key "
        "JOIN cond ON cond.t = t.question_key AND cond.h = h.question_key AND cond.hv = h.answer_index), "
        f"ti AS (SELECT row_id, [{', '.join(f'sum(abs(c) * (ln(cp[{i}]) - ln(pr[{i}])))' for i in range(1, 6))}] AS tl FROM ev GROUP BY 1), "
        "zz AS (SELECT te.row_id, list_transform(range(1, 6), lambda i: ln(prior[i]) + coalesce(tl[i], 0)) AS z FROM te LEFT JOIN ti USING (row_id))",
    ),
)
_A = ["age_bin", "education", "income_quintile", "urbanicity"]


def _matched_all(s, d):
    return joins.matched_pairs(people(s, d), _A, 1)


_BUCKETS = " UNION ALL ".join(
    f"SELECT domain, panel_id, age_bin, education, income_quintile, urbanicity, concat_ws('|', '{i}', {', '.join(a for a in _A if a != drop)}) AS bucket FROM people" for i, drop in enumerate(_A)
)
PAIRS = (
    f"bk AS ({_BUCKETS}), bc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain, bucket ORDER BY sha256('{SEED}|' || bucket || '|' || panel_id), panel_id) AS rn FROM bk) WHERE rn <= 200), "
    "mp2 AS (SELECT DISTINCT x.domain, x.panel_id AS panel_id_a, y.panel_id AS panel_id_b, (x.age_bin <> y.age_bin)::INT + (x.education <> y.education)::INT + (x.income_quintile <> y.income_quintile)::INT + (x.urbanicity <> y.urbanicity)::INT AS distance "
    "FROM bc x JOIN bc y USING (domain, bucket) WHERE x.panel_id < y.panel_id), pairs AS (SELECT * FROM mp2 WHERE distance <= 1)"
)
register("matched_pairs", lambda s, d: rounded(_matched_all(s, d)), f"WITH {PEOPLE_SQL}, {PAIRS} SELECT domain, panel_id_a, panel_id_b, distance::BIGINT AS distance FROM pairs")
DIVERGENCE = (
    f"{PAIRS}, dv AS (SELECT p.domain, panel_id_a, panel_id_b, a.question_key AS q, abs(a.answer_index - b.answer_index) / 4.0::DOUBLE AS x, "
    f"row_number() OVER (PARTITION BY p.domain, panel_id_a, panel_id_b ORDER BY {hashed(str(SEED), 'divergence_selection', '{a.question_key}')}) AS rr "
    "FROM pairs p JOIN responses a ON a.panel_id = panel_id_a JOIN responses b ON b.panel_id = panel_id_b AND b.question_key = a.question_key), "
    "dp AS (SELECT domain, panel_id_a, panel_id_b, avg(x) AS history_divergence, list(q ORDER BY rr) AS items FROM dv WHERE rr <= 5 GROUP BY 1, 2, 3 HAVING count(*) >= 3 AND avg(x) >= 0.35)"
)
register(
    "pair_divergence",
    lambda s, d: rounded(joins.pair_divergence(_matched_all(s, d), responses(s, d)).select("domain", "panel_id_a", "panel_id_b", "history_divergence", F.array_join("selection_items", ",").alias("items"))),
    sql("SELECT domain, panel_id_a, panel_id_b, round(history_divergence, 9) AS history_divergence, array_to_string(items, ',') AS items FROM dp", DIVERGENCE),
)


def _hetero(s, d):
    rows = runs(s, d).where("k in (0, 5)")
    return rounded(joins.heterogeneity(rows, _matched_all(s, d), 2, 5), 7)


register(
    "heterogeneity",
    _hetero,
    sql(
        f"SELECT method, k::BIGINT AS k, count(*) AS n_pairs, round(CASE WHEN count(*) >= 5 THEN {_CORR.format('rt', 'rp')} END, 7) AS rho_heterogeneity, round(CASE WHEN count(*) >= 5 AND avg(dt) > 0 THEN avg(dp_) / avg(dt) END, 7) AS drr FROM ht GROUP BY 1, 2",
        f"{RUNS_SQL}, {PAIRS}, hs AS (SELECT method, k, panel_id, question_key, (p[2] + 2 * p[3] + 3 * p[4] + 4 * p[5]) / 4 AS e, answer_index / 4.0::DOUBLE AS h FROM runs WHERE k IN (0, 5)), "
        "hd AS (SELECT a.method, a.k, panel_id_a, panel_id_b, avg(abs(a.h - b.h)) AS dt, avg(abs(a.e - b.e)) AS dp_ FROM pairs JOIN hs a ON a.panel_id = panel_id_a JOIN hs b ON b.panel_id = panel_id_b AND b.method = a.method AND b.k = a.k AND b.question_key = a.question_key GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2), "
        "ht AS (SELECT *, rank() OVER (PARTITION BY method, k ORDER BY dt) + (count(*) OVER (PARTITION BY method, k, dt) - 1) / 2.0::DOUBLE AS rt, rank() OVER (PARTITION BY method, k ORDER BY dp_) + (count(*) OVER (PARTITION BY method, k, dp_) - 1) / 2.0::DOUBLE AS rp FROM hd)",
    ),
)


def _donors(s, d):
    rows = responses(s, d).where("split = 'test'")
    return rounded(joins.donor_shuffle(rows, rows, ["country", "sex", "age_bin"]))


register(
    "matched_donor_shuffle",
    _donors,
    sql(
        "SELECT panel_id, question_key, CASE WHEN nx <> panel_id THEN nx WHEN f1 <> panel_id THEN f1 ELSE coalesce(f2, panel_id) END AS donor, (CASE WHEN nx <> panel_id THEN na WHEN f1 <> panel_id THEN a1 ELSE coalesce(a2, answer_index) END)::BIGINT AS answer_index FROM "
        "(SELECT *, coalesce(lead(panel_id) OVER w, first_value(panel_id) OVER w) AS nx, coalesce(lead(answer_index) OVER w, first_value(answer_index) OVER w) AS na FROM te WINDOW w AS (PARTITION BY question_key, country, sex, age_bin ORDER BY h, panel_id)) JOIN "
        "(SELECT question_key, max(panel_id) FILTER (WHERE r = 1) AS f1, max(answer_index) FILTER (WHERE r = 1) AS a1, max(panel_id) FILTER (WHERE r = 2) AS f2, max(answer_index) FILTER (WHERE r = 2) AS a2 FROM (SELECT *, row_number() OVER (PARTITION BY question_key ORDER BY h, panel_id) AS r FROM te) GROUP BY 1) USING (question_key)",
        f"te AS (SELECT *, sha256('{SEED}|' || question_key || '|' || panel_id) AS h FROM responses WHERE split = 'test')",
    ),
)
register(
    "stratum_shuffle",
    lambda s, d: joins.stratum_shuffle(people(s, d).select("panel_id", "sex", "age_bin", "education", "country"), ["sex", "age_bin", "education"], "panel_id", ["country"], SEED),
    f"WITH {PEOPLE_SQL}, a AS (SELECT panel_id, sex, age_bin, education, country, row_number() OVER (PARTITION BY sex, age_bin, education ORDER BY panel_id) AS rn, "
    f"row_number() OVER (PARTITION BY sex, age_bin, education ORDER BY sha256('{SEED}|' || panel_id), panel_id) AS rh FROM people) "
    "SELECT x.panel_id, x.sex, x.age_bin, x.education, x.country, y.country AS shuffled_country FROM a x JOIN a y ON x.sex = y.sex AND x.age_bin = y.age_bin AND x.education = y.education AND x.rn = y.rh",
)


def _cell_donor(s, d):
    rows = people(s, d).select("panel_id", "sex", "age_bin", "education", "split")
    cell = ["sex", "age_bin", "education"]
    return joins.cell_donor(rows.where("split = 'test'").drop("split"), rows.where("split = 'train'").drop("split"), cell, "panel_id", SEED).select("panel_id", "donor")


register(
    "cell_donor",
    _cell_donor,
    f"WITH {PEOPLE_SQL}, tn AS (SELECT sex, age_bin, education, list(panel_id ORDER BY panel_id) AS l FROM people WHERE split = 'train' GROUP BY 1, 2, 3) "
    f"SELECT panel_id, l[('0x' || substr(sha256('{SEED}|donor|' || panel_id), 1, 15))::BIGINT % len(l) + 1] AS donor FROM people JOIN tn USING (sex, age_bin, education) WHERE split = 'test'",
)
_PERSONA = "CASE WHEN income_quintile IN ('Q1', 'Q2') THEN 0 WHEN income_quintile = 'Q3' THEN 1 ELSE 2 END"


def _posterior(s, d):
    rows = responses(s, d).withColumn("cluster", F.expr(_PERSONA))
    tables = baselines.persona_tables(rows.where("split = 'train'"))
    test = rows.where("split = 'test'")
    prior = test.select("panel_id").distinct().withColumn("cluster", F.explode(F.array(*[F.lit(i) for i in range(3)]))).withColumn("prior", F.lit(1 / 3))
    return rounded(baselines.persona_posterior(prior, test.select("panel_id", "question_key", "answer_index"), tables))


register(
    "persona_posterior",
    _posterior,
    sql(
        "SELECT panel_id, cl AS cluster, round(e / sum(e) OVER (PARTITION BY panel_id), 9) AS posterior FROM (SELECT *, exp(z - max(z) OVER (PARTITION BY panel_id)) AS e FROM "
        "(SELECT t.panel_id, cl, ln(1 / 3.0::DOUBLE) + sum(ln(greatest(pp[t.answer_index + 1], 1e-12))) AS z FROM responses t JOIN pt ON pt.question_key = t.question_key WHERE t.split = 'test' GROUP BY 1, 2))",
        f"pt AS (SELECT cl::BIGINT AS cl, question_key, {smooth_sql('c', 0.5)} AS pp FROM (SELECT {_PERSONA} AS cl, question_key, {_counts('n')} AS c FROM responses WHERE split = 'train' GROUP BY 1, 2))",
    ),
)

"""Queries over fitted models and resampling; most have no SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom.functions import probs
from surveyloom.functions.text import STOP_WORDS
from surveyloom.operators import inference, metrics, models
from surveyloom.plans.catalogue import register
from surveyloom.operators.joins import paired
from surveyloom.plans.panel import sql
from surveyloom.plans.scores import FREQUENCY_SQL, RUNS_SQL, SCORE_SQL, predictions, rounded, runs
from surveyloom.sources.scratch import written
from surveyloom.sources.tables import PEOPLE_SQL, people, responses, table


def _seen(s, d):
    return metrics.scored(runs(s, d).where("k = 5 and item_pool = 'seen'"))


REPLICATES = 2000


def _drawn(seed: int, *columns: str) -> str:
    """SQL of inference._poisson over columns."""
    text = " || '|' || ".join(f"{c}::VARCHAR" for c in columns)
    u = f"((('0x' || substr(md5('{seed}|' || {text}), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)"
    return f"list_sum(list_transform({inference.POISSON}::DOUBLE[], lambda c: ({u} > c)::INT))"


_SEEN = f"{RUNS_SQL}, {SCORE_SQL.format(source='runs')}, sk AS (SELECT * FROM scored WHERE k = 5 AND item_pool = 'seen')"
_REPS = f"reps AS (SELECT unnest(range({REPLICATES})) AS rep)"


def _cells_sql(name: str, keys: str, other: str) -> str:
    return (
        f"{name} AS (SELECT {keys}, avg(nll) FILTER (WHERE method = 'mixed_seed1') - avg(nll) FILTER (WHERE method = '{other}') AS difference FROM sk WHERE method IN ('mixed_seed1', '{other}') "
        f"GROUP BY ALL HAVING count(*) FILTER (WHERE method = 'mixed_seed1') > 0 AND count(*) FILTER (WHERE method = '{other}') > 0)"
    )


def _summary_sql(stat: str) -> str:
    side = lambda c: f"(count(*) FILTER (WHERE d {c} 0) + 1) / (count(d) + 1)::DOUBLE"
    return f"round(quantile_cont(d, 0.025), 9) AS ci_low, round(quantile_cont(d, 0.975), 9) AS ci_high, round(least(1.0, 2 * least({side('<=')}, {side('>=')})), 9) AS p_two_sided FROM {stat}"


def _crossed_sql(name: str, other: str, seed: int = 1701) -> str:
    """CTEs of a crossed bootstrap; ``<name>`` has one row with difference, sizes, interval and p."""
    return (
        f"{_cells_sql(name + 'c', 'domain, panel_id, question_key', other)}, "
        f"{name}p AS (SELECT domain, panel_id, rep, {_drawn(seed, 'rep', 'panel_id', 'domain')} AS w FROM (SELECT DISTINCT domain, panel_id FROM {name}c), reps), "
        f"{name}q AS (SELECT domain, question_key, rep, {_drawn(seed + 1, 'rep', 'question_key', 'domain')} AS v FROM (SELECT DISTINCT domain, question_key FROM {name}c), reps), "
        f"{name}s AS (SELECT rep, avg(d) AS d FROM (SELECT domain, rep, sum(w * v * difference) / nullif(sum(w * v), 0) AS d FROM {name}c JOIN {name}p USING (domain, panel_id) JOIN {name}q USING (domain, question_key, rep) GROUP BY 1, 2) GROUP BY 1), "
        f"{name} AS (SELECT * FROM (SELECT round(avg(x), 9) AS difference FROM (SELECT avg(difference) AS x FROM {name}c GROUP BY domain)), (SELECT count(DISTINCT panel_id) AS n_panels, count(DISTINCT question_key) AS n_items FROM {name}c), (SELECT {_summary_sql(name + 's')}))"
    )


def _strata_sql(cells: str, unit: str, pooled: bool, seed: int = 1701) -> str:
    """CTEs st (replicates) and ob (observed) of a stratified bootstrap of ``cells`` (domain, unit, difference)."""
    sums = f"sm AS (SELECT domain, rep, sum(w * x) AS sx, sum(w) AS sw FROM (SELECT domain, x, rep, {_drawn(seed, 'rep', unit, 'domain')} AS w FROM pu, reps) GROUP BY 1, 2)"
    units = f"pu AS (SELECT domain, {unit}, avg(difference) AS x FROM {cells} GROUP BY 1, 2)"
    if pooled:
        return f"{units}, {sums}, st AS (SELECT rep, sum(sx) / nullif(sum(sw), 0) AS d FROM sm GROUP BY 1), ob AS (SELECT round(avg(x), 9) AS difference, count(*) AS n_units FROM pu)"
    return f"{units}, {sums}, st AS (SELECT rep, avg(sx / nullif(sw, 0)) AS d FROM sm GROUP BY 1), ob AS (SELECT round(avg(x), 9) AS difference, sum(n)::BIGINT AS n_units FROM (SELECT avg(x) AS x, count(*) AS n FROM pu GROUP BY domain))"


_NAMES = "'mixed_seed1' AS method, 'uniform' AS reference, 'nll' AS metric"
register(
    "bootstrap_ci",
    lambda s, d: rounded(inference.paired_bootstrap(_seen(s, d), "mixed_seed1", "uniform", "nll", REPLICATES)),
    sql(f"SELECT {_NAMES}, * FROM ob, (SELECT {_summary_sql('st')})", f"{_SEEN}, {_REPS}, {_cells_sql('ce', 'domain, panel_id', 'uniform')}, {_strata_sql('ce', 'panel_id', False)}"),
)
register(
    "crossed_bootstrap",
    lambda s, d: rounded(inference.crossed_bootstrap(_seen(s, d), "mixed_seed1", "uniform", "nll", REPLICATES)),
    sql(f"SELECT {_NAMES}, *, difference < 0 AS favors_candidate FROM cx", f"{_SEEN}, {_REPS}, {_crossed_sql('cx', 'uniform')}"),
)


def _family(s, d):
    return inference.primary_family(_seen(s, d), "mixed_seed1", ["mixed_seed2", "uniform"], "nll", replicates=REPLICATES)


_FAMILY = (
    f"{_SEEN}, {_REPS}, {_crossed_sql('ca', 'mixed_seed2')}, {_crossed_sql('cb', 'uniform')}, fm AS (SELECT 'mixed_seed2' AS reference, * FROM ca UNION ALL SELECT 'uniform', * FROM cb), "
    "hl AS (SELECT *, 0.05::DOUBLE / (3 - row_number() OVER (ORDER BY p_two_sided, reference)) AS h, row_number() OVER (ORDER BY p_two_sided, reference) AS rk FROM fm), "
    "hr AS (SELECT *, min((p_two_sided <= h)::INT) OVER (ORDER BY rk) = 1 AS reject_null FROM hl)"
)
register(
    "primary_family",
    lambda s, d: rounded(_family(s, d).select("method", "reference", "difference", "ci_low", "ci_high", "p_value", "holm_threshold", "reject_null", "practical_effect", "primary_claim_supported")),
    sql("SELECT 'mixed_seed1' AS method, reference, difference, ci_low, ci_high, p_two_sided AS p_value, round(h, 9) AS holm_threshold, reject_null, difference <= -0.02 AS practical_effect, reject_null AND difference <= -0.02 AND ci_high < 0 AS primary_claim_supported FROM hr", _FAMILY),
)
register(
    "claim_gates",
    lambda s, d: inference.gates(_family(s, d), F.col("reference").isin("uniform", "mixed_seed2")),
    sql("SELECT min(c::INT) = 1 AS gate_supported, sum(c::INT)::BIGINT AS n_supported, count(*) AS n_required FROM (SELECT reject_null AND difference <= -0.02 AND ci_high < 0 AS c FROM hr)", _FAMILY),
)


def _gap(s, d):
    """The loss gap of two methods by respondent, pooled over domains; J7 without strata."""
    cells = paired(_seen(s, d), "mixed_seed1", "uniform", "nll", ["domain", "panel_id"])
    return inference.bootstrap(cells, "difference", "panel_id", ["domain"], [], REPLICATES, pooled=True)


register("respondent_gap_bootstrap", lambda s, d: rounded(_gap(s, d)), sql(f"SELECT * FROM ob, (SELECT {_summary_sql('st')})", f"{_SEEN}, {_REPS}, {_cells_sql('ce', 'domain, panel_id', 'uniform')}, {_strata_sql('ce', 'panel_id', True)}"))


def _item_gap(s, d):
    cells = paired(_seen(s, d), "mixed_seed1", "uniform", "nll", ["domain", "question_key"])
    return inference.bootstrap(cells, "difference", "question_key", ["domain"], [], REPLICATES, pooled=True)


register("item_bootstrap", lambda s, d: rounded(_item_gap(s, d)), sql(f"SELECT * FROM ob, (SELECT {_summary_sql('st')})", f"{_SEEN}, {_REPS}, {_cells_sql('ce', 'domain, question_key', 'uniform')}, {_strata_sql('ce', 'question_key', True)}"))


def _one_sample(s, d):
    """The mean of one number per unit, without strata, for each segment."""
    rows = people(s, d).select("domain", "panel_id", (F.col("survey_weight") - 1.5).alias("x"))
    return inference.bootstrap(rows, "x", "panel_id", [], ["domain"], 200, pooled=True)


register(
    "one_sample_bootstrap",
    lambda s, d: rounded(_one_sample(s, d)),
    f"WITH {PEOPLE_SQL}, dr AS (SELECT domain, rep, sum(w * x) / nullif(sum(w), 0) AS d FROM (SELECT domain, survey_weight - 1.5 AS x, rep, {_drawn(1701, 'rep', 'panel_id')} AS w FROM people, (SELECT unnest(range(200)) AS rep)) GROUP BY 1, 2), "
    "ob AS (SELECT domain, round(avg(survey_weight - 1.5), 9) AS difference, count(*) AS n_units FROM people GROUP BY 1) "
    f"SELECT * FROM ob JOIN (SELECT domain, {_summary_sql('dr')} GROUP BY domain) USING (domain)",
)
register(
    "cluster_bootstrap",
    lambda s, d: rounded(inference.cluster_bootstrap(_seen(s, d).where("method = 'mixed_seed1'").withColumn("gain", F.col("nll") - 1.6), "gain", "question_key", ["domain"], 500)),
    sql(
        f"SELECT * FROM (SELECT domain, round(sum(x) / sum(z), 9) AS difference, count(*) AS n_units FROM cl GROUP BY 1) JOIN (SELECT domain, {_summary_sql('dr')} GROUP BY domain) USING (domain)",
        f"{_SEEN}, cl AS (SELECT domain, question_key, sum(nll - 1.6) AS x, count(*) AS z FROM sk WHERE method = 'mixed_seed1' GROUP BY 1, 2), "
        f"dr AS (SELECT domain, rep, sum(w * x) / nullif(sum(w * z), 0) AS d FROM (SELECT domain, x, z, rep, {_drawn(1701, 'rep', 'question_key')} AS w FROM cl, (SELECT unnest(range(500)) AS rep)) GROUP BY 1, 2)",
    ),
)
register(
    "selector_positions",
    lambda s, d: rounded(inference.position_means(predictions(s, d), ["domain"], "p")),
    sql("SELECT domain, i - 1 AS position, round(avg(p[i]), 9) AS mean, count(*) AS n FROM preds, (SELECT unnest(range(1, 6)) AS i) GROUP BY 1, 2", FREQUENCY_SQL),
)


def _cosine_of_documents(s, d):
    docs, items = table(s, d, "documents").select("doc_id", "text"), table(s, d, "benchmark").select("item_id", "text")
    b = written(models.tfidf_terms(items, "item_id").withColumnRenamed("w", "v"), "item-terms")
    a = models.tfidf_terms(docs, "doc_id", only=b).repartition("doc_id")  # pairs of item and document are summed where the document is
    cos = a.join(b, "term").groupBy("item_id", "doc_id").agg(F.round(F.sum(F.col("w") * F.col("v")), 12).alias("cosine"))
    return cos.groupBy("item_id").agg(F.max_by("doc_id", F.struct("cosine", "doc_id")).alias("doc_id"), F.max("cosine").alias("cosine"))


_TERMS = (
    "{n}w AS (SELECT {key} AS k, list_filter(regexp_extract_all(lower(text), '\\w\\w+'), lambda w: NOT list_contains(" + str(STOP_WORDS) + ", w)) AS w FROM {table} WHERE text IS NOT NULL), "
    "{n}t AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM {n}w) GROUP BY 1, 2), "
    "{n}d AS (SELECT term, count(*) AS df FROM {n}t GROUP BY 1), {n}x AS (SELECT k, term, tf * (ln((1.0 + (SELECT count(*) FROM {table})) / (1 + df)) + 1) AS x FROM {n}t JOIN {n}d USING (term)), "
    "{n} AS (SELECT k, term, x / sqrt(sum(x * x) OVER (PARTITION BY k)) AS w FROM {n}x)"
)
register(
    "tfidf_cosine",
    lambda s, d: rounded(_cosine_of_documents(s, d), 7),
    f"WITH {_TERMS.format(n='da', key='doc_id', table='documents')}, {_TERMS.format(n='ib', key='item_id', table='benchmark')}, c AS (SELECT ib.k AS item_id, da.k AS doc_id, round(sum(da.w * ib.w), 12) AS cosine FROM da JOIN ib USING (term) GROUP BY 1, 2) "
    "SELECT item_id, arg_max(doc_id, (cosine, doc_id)) AS doc_id, round(max(cosine), 7) AS cosine FROM c GROUP BY 1",
)


def _profiles(s, d):
    rows = responses(s, d)
    hot = rows.groupBy("panel_id", "split", "country", "sex", "age_bin").pivot("question_id", [f"q{i:02d}" for i in range(1, 13)]).agg(F.first("answer_index"))
    flags = [F.coalesce((F.col(f"q{i:02d}") == a).cast("double"), F.lit(0.0)) for i in range(1, 13) for a in range(5)]
    return hot.select("panel_id", "split", "country", "sex", "age_bin", F.array(*flags).alias("profile"))


register("kmeans_personas", lambda s, d: models.personas(_profiles(s, d), 4).select("panel_id", "cluster"))


def _router(s, d):
    rows = models.personas(_profiles(s, d), 4)
    out = models.demographic_router(rows.where("split = 'train'"), rows.where("split = 'test'"), ["country", "sex", "age_bin"])
    return out.select("panel_id", "prior")


register("router_logit", _router)


def _choice(s, d):
    rows = responses(s, d).select("row_id", "split", "question_id", "age_bin", "sex", "answer_index")
    cand = rows.withColumn("option_index", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("chosen", (F.col("option_index") == F.col("answer_index")).cast("int"))
    feats = [F.col("option_index"), F.substring("question_id", 2, 2).cast("double"), (F.col("sex") == "male").cast("int"), F.substring("age_bin", 1, 2).cast("double")]
    return models.choice_model(cand, feats, F.col("split") == "train").where("split = 'test'").select("row_id", "option_index", "p")


register("gbt_choice", _choice)
register("pca_vectors", lambda s, d: models.inductive_pca(table(s, d, "embeddings").select("vec_id", F.col("embedding").alias("vector")), F.col("vec_id") % 5 != 0, 4).select("vec_id", "pca"))
register("svd_factors", lambda s, d: models.factors(people(s, d).select("panel_id", "sex", "age_bin", "education", "urbanicity"), ["sex", "age_bin", "education", "urbanicity"], 3).select("panel_id", "factors"))


def _ridge(s, d):
    p = table(s, d, "part").select("p_brand", F.col("p_size").cast("double").alias("p_size"), (F.col("p_partkey") % 7).cast("double").alias("r"), "p_retailprice")
    return s.createDataFrame(models.group_ridge(p, ["p_size", "r"], "p_retailprice", "p_brand"))


_ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0)


def _det(*m: str) -> str:
    a, b, c, d, e, f, g, h, i = (f"({x})" for x in m)
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def _ridge_sql() -> str:
    """Normal equations by group; three unknowns by determinants."""
    cells = ["n", "sx", "sz", "sx", "sxx", "sxz", "sz", "sxz", "szz"]
    right = ["sy", "sxy", "szy"]
    sums = "count(*)::DOUBLE AS n, sum(x) AS sx, sum(z) AS sz, sum(x * x) AS sxx, sum(x * z) AS sxz, sum(z * z) AS szz, sum(y) AS sy, sum(x * y) AS sxy, sum(z * y) AS szy, sum(y * y) AS syy"

    def solved(name, minus):
        term = lambda c: f"t.{c} - g.{c}" if minus else f"t.{c}"
        h = [term(c) + (" + a" if i in (4, 8) else "") for i, c in enumerate(cells)]
        r = [term(c) for c in right]
        column = lambda j: _det(*[r[i // 3] if i % 3 == j else h[i] for i in range(9)])
        return ", ".join(f"{column(j)} / {_det(*h)} AS b{j}" for j in range(3))

    return (
        f"WITH d AS (SELECT p_brand AS grp, p_size::DOUBLE AS x, (p_partkey % 7)::DOUBLE AS z, p_retailprice::DOUBLE AS y FROM part), g AS (SELECT grp, {sums} FROM d GROUP BY 1), t AS (SELECT {sums} FROM d), al AS (SELECT unnest({list(_ALPHAS)}::DOUBLE[]) AS a), "
        f"lo AS (SELECT a, g.*, {solved('g', True)} FROM g, t, al), er AS (SELECT a, sum(syy - 2 * (b0 * sy + b1 * sxy + b2 * szy) + b0 * b0 * n + b1 * b1 * sxx + b2 * b2 * szz + 2 * (b0 * b1 * sx + b0 * b2 * sz + b1 * b2 * sxz)) / sum(n) AS e FROM lo GROUP BY 1), "
        f"be AS (SELECT arg_min(a, (round(e, 9), a)) AS a, min(e) AS e FROM er), fi AS (SELECT a, e, {solved('t', False)} FROM t, be) "
        "SELECT unnest(['intercept', 'p_size', 'r']) AS term, round(unnest([b0, b1, b2]), 4) AS coefficient, a AS alpha, round(e, 4) AS loo_mse FROM fi"
    )


register("ridge_groups", lambda s, d: rounded(_ridge(s, d), 4), _ridge_sql())

_COEF = {0: (0.2, 0.1, -0.3), 1: (0.0, -0.2, 0.4), 2: (-0.5, 0.3, 0.1)}


def _softmax(s, d):
    p = table(s, d, "part").select("p_partkey", "p_brand", (F.col("p_size") / 50.0).alias("x1"), (F.col("p_retailprice") / 2000.0).alias("x2"))
    brands = p.select("p_brand").distinct()
    coef = brands.withColumn("o", F.explode(F.array(*[F.struct(F.lit(k).alias("option_index"), F.array(*[F.lit(v) for v in c]).alias("coefficients")) for k, c in _COEF.items()]))).select("p_brand", "o.*")
    out = models.option_softmax(p, coef, ["x1", "x2"], "p_partkey", "p_brand", "option_index")
    return out.select("p_partkey", "p_brand", F.col("option_index").cast("bigint").alias("option_index"), F.round("p", 9).alias("p"))


register(
    "logsoftmax_from_coefficients",
    _softmax,
    "WITH c(o, a, b, c) AS (VALUES " + ", ".join(f"({k}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for k, (a, b, c) in _COEF.items()) + "), "
    "z AS (SELECT p_partkey, p_brand, o, a + b * (p_size / 50.0::DOUBLE) + c * (p_retailprice / 2000.0::DOUBLE) AS s FROM part, c) "
    "SELECT p_partkey, p_brand, o::BIGINT AS option_index, round(exp(s) / sum(exp(s)) OVER (PARTITION BY p_partkey, p_brand), 9) AS p FROM z",
)


def _read(s, d):
    from surveyloom.operators.vectors import read_prompts

    c = table(s, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("prompt"), F.lit(4).alias("n_options"))
    return rounded(read_prompts(c).select("conv_id", "turn", probs.argmax(F.col("p")).alias("choice"), F.col("p")[0].alias("p0")))


register(
    "dummy_reader",
    _read,
    "WITH b AS (SELECT conv_id, turn, list_transform(range(4), lambda i: ('0x' || substr(sha256(coalesce(text, '')), 1 + 2 * i, 2))::INT) AS z FROM conversations), e AS (SELECT *, list_transform(z, lambda x: exp((x - list_max(z)) / 64.0::DOUBLE)) AS e FROM b) "
    "SELECT conv_id, turn::BIGINT AS turn, (list_position(z, list_max(z)) - 1)::BIGINT AS choice, round(e[1] / list_sum(e), 9) AS p0 FROM e",
)


def _permuted(s, d):
    """Options are shown in an order of their own for each row; the reader's shares are put back."""
    from surveyloom.functions import hashing
    from surveyloom.operators.vectors import read_prompts

    rows = responses(s, d).where("split = 'test'").select("row_id", hashing.hash_order(7, F.col("row_id"), F.lit(5)).alias("order"), F.concat(F.lit("prompt of "), F.col("row_id")).alias("prompt"), F.lit(5).alias("n_options"))
    out = read_prompts(rows).withColumn("p", probs.unpermute(F.col("p"), F.col("order")))
    return rounded(out.select("row_id", *[F.col("p")[i].alias(f"p{i}") for i in range(5)]))


register(
    "permuted_reader",
    _permuted,
    sql(
        "SELECT row_id, " + ", ".join(f"round(e[list_position(o, {i})] / list_sum(e), 9) AS p{i}" for i in range(5)) + " FROM (SELECT row_id, list_transform(range(5), lambda i: exp(('0x' || substr(sha256('prompt of ' || row_id), 1 + 2 * i, 2))::INT / 64.0::DOUBLE)) AS e, "
        "(SELECT list(i ORDER BY sha256('7|' || row_id || '|' || i)) FROM (SELECT unnest(range(5)) AS i)) AS o FROM responses WHERE split = 'test')"
    ),
)


def _logits(s, d):
    rows = table(s, d, "part").select("p_brand", (F.col("p_size") / 50.0).alias("x"), F.when(F.col("p_brand") == "Brand#11", 1).otherwise((F.col("p_retailprice") > 1400 + (F.col("p_size") % 7) * 30).cast("int")).alias("y"))
    out = models.option_logits(rows, ["p_brand"], ["x"])
    return rounded(out.select("p_brand", F.col("coefficients")[0].alias("b0"), F.col("coefficients")[1].alias("b1")), 6)


def _newton_sql(steps: int = 6, ridge: float = 1.0) -> str:
    out = ["d AS (SELECT p_brand AS g, p_size / 50.0::DOUBLE AS x, CASE WHEN p_brand = 'Brand#11' THEN 1 ELSE (p_retailprice > 1400 + (p_size % 7) * 30)::INT END AS y FROM part)",
           "c0 AS (SELECT g, ln(least(greatest(avg(y), 0.01), 0.99) / (1 - least(greatest(avg(y), 0.01), 0.99))) AS b0, 0.0::DOUBLE AS b1, avg(y) IN (0, 1) AS flat FROM d GROUP BY 1)"]
    for i in range(steps):
        out.append(
            f"c{i + 1} AS (SELECT g, b0 + CASE WHEN flat THEN 0 ELSE (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) END AS b0, b1 + CASE WHEN flat THEN 0 ELSE (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) END AS b1, flat FROM "
            f"(SELECT g, any_value(b0) AS b0, any_value(b1) AS b1, any_value(flat) AS flat, sum(y - p) - 1e-9 * any_value(b0) AS g0, sum((y - p) * x) - {ridge} * any_value(b1) AS g1, sum(p * (1 - p)) + 1e-9 AS h00, sum(p * (1 - p) * x) AS h01, sum(p * (1 - p) * x * x) + {ridge} AS h11 "
            f"FROM (SELECT d.*, b0, b1, flat, 1 / (1 + exp(-(b0 + b1 * x))) AS p FROM d JOIN c{i} USING (g)) GROUP BY g))"
        )
    return "WITH " + ", ".join(out) + f" SELECT g AS p_brand, round(b0, 6) AS b0, round(b1, 6) AS b1 FROM c{steps}"


register("option_logits", _logits, _newton_sql())


def _fisher(s, d):
    rows = responses(s, d).where("split = 'test'").select("panel_id", F.array((F.col("answer_index") / 4.0), (F.length("question_key") / 10.0)).alias("chosen"), F.array(F.lit(0.5), F.lit(1.2)).alias("expected"), F.array(F.lit(0.3), F.lit(0.1), F.lit(0.1), F.lit(0.2)).alias("spread"))
    return rounded(models.fisher_update(rows, 2).select("panel_id", F.col("delta")[0].alias("d0"), F.col("delta")[1].alias("d1")), 8)


register(
    "fisher_update",
    _fisher,
    sql(
        "SELECT panel_id, round((h1 * g0 - h01 * g1) / (h0 * h1 - h01 * h01), 8) AS d0, round((h0 * g1 - h01 * g0) / (h0 * h1 - h01 * h01), 8) AS d1 FROM "
        "(SELECT panel_id, sum(answer_index / 4.0::DOUBLE - 0.5) AS g0, sum(length(question_key) / 10.0::DOUBLE - 1.2) AS g1, count(*) * 0.3::DOUBLE + 1 AS h0, count(*) * 0.1::DOUBLE AS h01, count(*) * 0.2::DOUBLE + 1 AS h1 FROM responses WHERE split = 'test' GROUP BY 1)"
    ),
)

"""Queries that calibrate shares, ready units for readers, split items by cluster and audit signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom.functions import probs
from surveyloom.operators import baselines, calibration, joins, materialise, protocols, ranking, vectors
from surveyloom.plans.catalogue import register
from surveyloom.plans.files import AGREE
from surveyloom.plans.pairs import _COND, _GRAPH, _train
from surveyloom.plans.panel import FOLD_SQL, FOLDS, ORDERS, _folds, _orders, sql
from surveyloom.plans.questionnaires import _CATALOGUE, _catalogue
from surveyloom.plans.scores import _P5, FREQUENCY_SQL, PRIOR_SQL, _counts, predictions, rounded, smooth_sql, with_prior
from surveyloom.sources.scratch import written
from surveyloom.sources.tables import SEED, little_sql, responses, table

_ROUNDS, _POINTS = 4, 17


def search_sql(name: str, source: str, loss: str, low: float, high: float) -> str:
    """CTEs that narrow a grid as calibration.bounded_minimum does; the last is ``<name>`` with ``best``."""
    out = [f"{name}0 AS (SELECT {low}::DOUBLE AS lo, {high}::DOUBLE AS hi, NULL::DOUBLE AS best)"]
    for r in range(_ROUNDS):
        out += [
            f"{name}g{r} AS (SELECT i, lo, hi, lo + i * ((hi - lo) / {_POINTS - 1}) AS x FROM {name}{r}, (SELECT unnest(range({_POINTS})) AS i))",
            f"{name}l{r} AS (SELECT i, any_value(lo) AS lo, any_value(hi) AS hi, any_value(x) AS x, round(avg({loss}), 12) AS l FROM {source}, {name}g{r} GROUP BY i)",
            f"{name}{r + 1} AS (SELECT lo + greatest(ia - 1, 0) * ((hi - lo) / {_POINTS - 1}) AS lo, lo + least(ia + 1, {_POINTS - 1}) * ((hi - lo) / {_POINTS - 1}) AS hi, lo + ia * ((hi - lo) / {_POINTS - 1}) AS best "
            f"FROM (SELECT any_value(lo) AS lo, any_value(hi) AS hi, arg_min(i, (l, i)) AS ia FROM {name}l{r}))",
        ]
    return ", ".join([*out, f"{name} AS (SELECT best FROM {name}{_ROUNDS})"])


_TEMPERED = "list_transform({p}, lambda v: greatest(v, 1e-12) ** (1 / {t}))"
_NLL_AT = "-ln(greatest({z}[answer_index + 1] / list_sum({z}), 1e-12))"
_TLOSS = _NLL_AT.format(z=_TEMPERED.format(p="{p}", t="exp(x)"))


def _fitted(s, d):
    rows = predictions(s, d).where("item_pool = 'seen'")
    return s.createDataFrame([(round(calibration.fit_temperature(rows), 6),)], "temperature double")


register("fitted_temperature", _fitted, sql("SELECT round(exp(best), 6) AS temperature FROM ft", f"{FREQUENCY_SQL}, sn AS (SELECT p, answer_index FROM preds WHERE item_pool = 'seen'), {search_sql('ft', 'sn', _TLOSS.format(p='p'), -3.0, 5.0)}"))


def _hybrid(s, d):
    keep = ["row_id", "panel_id", "question_key", "answer_index", "n_options", "p", "item_pool"]
    stat = written(predictions(s, d).select(*keep), "predictions")  # read on both sides of each split, several times
    reader = stat.withColumn("p", probs.normalise(F.transform("p", lambda x, i: F.sqrt(x) + F.when(i == F.pmod(F.col("answer_index") + F.length("row_id"), F.lit(2)), 0.1).otherwise(0.0))))
    side = lambda pool: tuple(x.where(F.col("item_pool") == pool).drop("item_pool") for x in (stat, reader))
    rows, found = calibration.hybrid(side("seen"), side("unseen"), SEED)
    return rounded(rows.select("row_id", "method", *[F.col("p")[i].alias(f"p{i}") for i in range(5)]).withColumn("temperature", F.lit(found["temperature"])).withColumn("share", F.lit(found["share"])), 6)


_POOL = "list_transform(range(1, 6), lambda i: exp((1 - {s}) * ln(greatest({p}[i], 1e-12)) + {s} * ln(greatest({q}[i], 1e-12))))"
register(
    "hybrid_calibration",
    _hybrid,
    sql(
        f"SELECT row_id, method, {', '.join(f'round(f[{i + 1}] / list_sum(f), 6) AS p{i}' for i in range(5))}, round(exp(tb.best), 6) AS temperature, round(sh.share, 6) AS share FROM ("
        f"SELECT row_id, 'scaled_reader' AS method, q AS f FROM tq UNION ALL SELECT row_id, 'hybrid', {_POOL.format(s='share', p='p', q='q')} FROM tq, sh), tb, sh",
        f"{FREQUENCY_SQL}, rd0 AS (SELECT *, list_transform(range(1, 6), lambda i: sqrt(p[i]) + CASE WHEN i - 1 = (answer_index + length(row_id)) % 2 THEN 0.1 ELSE 0 END) AS r0, {little_sql('panel_id', SEED, 2)} AS side FROM preds), "
        f"rd AS (SELECT * EXCLUDE (r0), list_transform(r0, lambda v: v / list_sum(r0)) AS r FROM rd0), va AS (SELECT r, answer_index FROM rd WHERE item_pool = 'seen' AND side = 0), {search_sql('tb', 'va', _TLOSS.format(p='r'), -3.0, 5.0)}, "
        f"sq AS (SELECT * EXCLUDE (z), list_transform(z, lambda v: v / list_sum(z)) AS q FROM (SELECT rd.*, {_TEMPERED.format(p='r', t='exp(best)')} AS z FROM rd, tb)), "
        f"sl AS (SELECT l, round(avg({_NLL_AT.format(z='f')}), 12) AS v FROM (SELECT l, answer_index, {_POOL.format(s='l', p='p', q='q')} AS f FROM sq, (SELECT unnest(range(101)) / 100.0::DOUBLE AS l) WHERE item_pool = 'seen' AND side = 1) GROUP BY 1), "
        "sh AS (SELECT arg_min(l, (v, l)) AS share FROM sl), tq AS (SELECT * FROM sq WHERE item_pool = 'unseen')",
    ),
)
#: Fifteen log-spaced temperatures from 0.25 to 4, and eleven shares.
_GRID = [(0.25 * 16 ** (i / 14), w / 10) for i in range(15) for w in range(11)]


def _sweep(s, d):
    rows = calibration.alike(predictions(s, d).where("item_pool = 'seen'"), "p", "answer_index").withColumn("u", F.transform("p", lambda _: F.lit(0.2)))
    return calibration.sweep(rows, _GRID, lambda t, w: probs.nll(probs.log_pool(probs.temper(F.col("p"), t), F.col("u"), w), F.col("answer_index"))).select(F.round("a", 9).alias("temperature"), F.col("b").alias("share"), "loss")


register(
    "sweep_best",
    _sweep,
    sql(
        f"SELECT round(t, 9) AS temperature, w AS share, round(avg({_NLL_AT.format(z='f')}), 9) AS loss FROM (SELECT t, w, answer_index, list_transform(z, lambda v: exp((1 - w) * ln(greatest(v / list_sum(z), 1e-12)) + w * ln(0.2::DOUBLE))) AS f FROM "
        f"(SELECT t, w, answer_index, {_TEMPERED.format(p='p', t='t')} AS z FROM preds, gr WHERE item_pool = 'seen')) GROUP BY t, w ORDER BY loss, t, w LIMIT 5",
        f"{FREQUENCY_SQL}, gr(t, w) AS (VALUES {', '.join(f'({t}::DOUBLE, {w}::DOUBLE)' for t, w in _GRID)})",
    ),
)


def _coefficients(s, d):
    n = F.col("b") % 3 + 3
    p = table(s, d, "part").withColumn("b", F.substring("p_brand", 7, 2).cast("int"))
    rows = p.withColumn("option_position", F.pmod(F.col("p_size"), n)).groupBy(F.col("p_brand").alias("item"), n.alias("n_options"), "option_position")
    return rows.agg(F.array(F.avg("p_retailprice") / 1000, F.avg("p_size") / 50, F.lit(0.5)).alias("coefficients"))


def _pooled(s, d):
    rows = _coefficients(s, d)
    found, mean = calibration.pooled_prior(rows, rows.where("item like 'Brand#1%'").select("item"))
    asked = rows.select("item", "n_options", "option_position").unionByName(s.createDataFrame([("new", 9, 0)], "item string, n_options int, option_position int"))
    out = calibration.prior_of_options(asked, found, mean)
    return rounded(out.select("item", "option_position", *[F.col("prior")[i].alias(f"c{i}") for i in range(3)]), 7)


register(
    "pooled_prior",
    _pooled,
    "WITH pb AS (SELECT p_brand AS item, substr(p_brand, 7, 2)::INT % 3 + 3 AS n, p_size, p_retailprice FROM part), c AS (SELECT item, n, p_size % n AS pos, avg(p_retailprice) / 1000 AS c0, avg(p_size) / 50 AS c1 FROM pb GROUP BY 1, 2, 3), "
    "k AS (SELECT * FROM c WHERE item NOT LIKE 'Brand#1%'), t AS (SELECT n, pos, avg(c0) AS c0, avg(c1) AS c1 FROM k GROUP BY 1, 2), m AS (SELECT avg(c0) AS m0, avg(c1) AS m1 FROM k), a AS (SELECT item, n, pos FROM c UNION ALL SELECT 'new', 9, 0) "
    "SELECT item, pos::BIGINT AS option_position, round(coalesce(c0, m0), 7) AS c0, round(coalesce(c1, m1), 7) AS c1, 0.5::DOUBLE AS c2 FROM a LEFT JOIN t USING (n, pos), m",
)


def _multi(s, d):
    rows = responses(s, d).select("split", F.col("panel_id").alias("unit"), F.col("question_key").alias("target"), F.col("answer_index").alias("label"))
    return rounded(calibration.multi_output_prior(rows.where("split = 'train'").drop("split"), rows.where("split = 'test'").drop("split")), 8)


register(
    "multi_output_prior",
    _multi,
    sql(
        "SELECT round(avg(-ln(greatest(coalesce(c / t, 0), 1e-12))), 8) AS nll, round(avg((label = mode)::INT), 8) AS accuracy, count(*) AS n_rows, count(DISTINCT panel_id) AS n_units, count(DISTINCT target) AS n_targets FROM "
        "(SELECT panel_id, question_key AS target, answer_index AS label FROM responses WHERE split = 'test') JOIN ts USING (target) LEFT JOIN ce USING (target, label)",
        "ce AS (SELECT question_key AS target, answer_index AS label, count(*) + 0.5::DOUBLE AS c FROM responses WHERE split = 'train' GROUP BY 1, 2), ts AS (SELECT target, sum(c) AS t, arg_min(label, (-c, label)) AS mode FROM ce GROUP BY 1)",
    ),
)


def _positions(s, d):
    rows = responses(s, d).where("split = 'train'")
    own, plain = baselines.position_prior(rows, ["sex", "age_bin"])
    shown = lambda c: [F.col(c)[i].alias(f"p{i}") for i in range(5)]
    return rounded(own.select("sex", "age_bin", *shown("pd")).unionByName(plain.select(F.lit("all").alias("sex"), F.lit("all").alias("age_bin"), *shown("ps"))))


register(
    "position_prior",
    _positions,
    sql(
        f"SELECT sex, age_bin, {_P5.format('p')} FROM (SELECT sex, age_bin, {smooth_sql('c', 0.5)} AS p FROM (SELECT sex, age_bin, {_counts('n')} AS c FROM responses WHERE split = 'train' GROUP BY 1, 2 HAVING count(*) >= 25) UNION ALL "
        f"SELECT 'all', 'all', {smooth_sql('c', 0.5)} FROM (SELECT {_counts('n')} AS c FROM responses WHERE split = 'train'))"
    ),
)


def asked(s, d):
    """Responses with the texts of question, options and profile."""
    return responses(s, d).select(
        "*", F.concat(F.lit("How do you see "), F.col("question_id"), F.lit("?")).alias("question"), F.array(*[F.lit(x) for x in AGREE]).alias("options"), F.concat(F.lit("Country: "), F.col("country"), F.lit("; Gender: "), F.col("sex")).alias("demographic_text")
    )


def _prompts(s, d):
    rows = asked(s, d)
    units = protocols.protocol_b(rows, _folds(rows), "test", 0, FOLDS)
    out = materialise.prompts(units, rows, 2, "all", option_seed=7)
    return out.select("row_id", F.array_join("history_keys", ",").alias("history"), F.array_join(F.transform("order", lambda x: x.cast("string")), "").alias("shown"), F.col("correct_label").cast("bigint").alias("correct_label"), "prompt_hash")


register(
    "materialised_prompts",
    _prompts,
    sql(
        "SELECT row_id, coalesce(array_to_string(hk, ','), '') AS history, array_to_string(ord7, '') AS shown, (list_position(ord7, answer_index) - 1)::BIGINT AS correct_label, "
        "substr(sha256('[\"' || replace('" + materialise.PROMPT_TASK + "' || chr(10) || chr(10) || 'Respondent background:' || chr(10) || 'Country: ' || country || '; Gender: ' || sex || chr(10) || chr(10) || 'Relevant previous responses:' || chr(10) || coalesce(hb, '" + materialise.NO_HISTORY + "') || chr(10) || chr(10) || "
        "'Target question:' || chr(10) || 'How do you see ' || question_id || '?' || chr(10) || chr(10) || 'Options:' || chr(10) || array_to_string(list_transform(range(1, 6), lambda i: 'ABCDE'[i] || '. ' || (" + str(AGREE) + ")[ord7[i] + 1]), chr(10)) || chr(10) || chr(10) || 'Answer:', chr(10), '\\n') || '\"]'), 1, 16) AS prompt_hash "
        "FROM (SELECT t.*, hk, hb, (SELECT list(i ORDER BY sha256('7|' || row_id || '|' || i)) FROM (SELECT unnest(range(5)) AS i)) AS ord7 FROM tg t LEFT JOIN ht USING (row_id))",
        f"{FOLD_SQL}, tg AS (SELECT * FROM responses JOIN roles USING (domain, question_key) WHERE split = 'test' AND role = 'test'), "
        "po AS (SELECT panel_id, question_key, question_id, answer_index, row_number() OVER (PARTITION BY panel_id ORDER BY question_key) AS rn FROM responses JOIN roles USING (domain, question_key) WHERE split = 'test' AND role = 'calibration'), "
        f"ht AS (SELECT t.row_id, list(po.question_key ORDER BY rn) AS hk, string_agg(rn || '. How do you see ' || po.question_id || '? -> ' || ({AGREE})[po.answer_index + 1], chr(10) ORDER BY rn) AS hb FROM tg t JOIN po USING (panel_id) WHERE rn <= 2 GROUP BY 1)",
    ),
)


def _respondent_prompts(s, d):
    rows = asked(s, d).where("split = 'test'")
    pairs = rows.groupBy("panel_id").agg(F.first("demographic_text").alias("t"), F.array_sort(F.collect_list(F.struct("question_key", "question", F.get("options", F.col("answer_index")).alias("answer")))).alias("h"))
    return pairs.select("panel_id", F.sha2(materialise.respondent_prompt(F.col("t"), F.col("h")), 256).alias("prompt"))


register(
    "respondent_prompts",
    _respondent_prompts,
    sql(
        f"SELECT panel_id, sha256('{materialise.RESPONDENT_TASK.replace(chr(39), chr(39) * 2)}' || chr(10) || chr(10) || 'Respondent background:' || chr(10) || 'Country: ' || any_value(country) || '; Gender: ' || any_value(sex) || chr(10) || chr(10) || 'Known previous responses:' || chr(10) || "
        f"string_agg(rn || '. How do you see ' || question_id || '? -> ' || ({AGREE})[answer_index + 1], chr(10) ORDER BY rn)) AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY panel_id ORDER BY question_key) AS rn FROM responses WHERE split = 'test') GROUP BY 1"
    ),
)


def _selected(s, d):
    rows = responses(s, d).where("split = 'test'").groupBy("panel_id").agg(F.collect_set("question_key").alias("keys"))
    modes = [("all", 3), ("random", 3), ("none", 0)]
    picked = F.array(*[F.struct(F.lit(m).alias("mode"), F.array_join(materialise.select_history(F.col("keys"), k, "all" if m == "none" else m, SEED, F.col("panel_id")), ",").alias("history")) for m, k in modes])
    return rows.select("panel_id", F.explode(picked).alias("m")).select("panel_id", "m.*")


register(
    "history_selection",
    _selected,
    sql(
        "SELECT panel_id, 'all' AS mode, array_to_string(list(question_key ORDER BY question_key)[1:3], ',') AS history FROM te GROUP BY 1 UNION ALL "
        f"SELECT panel_id, 'random', array_to_string(list(question_key ORDER BY sha256('{SEED}|' || panel_id || '|history|' || question_key))[1:3], ',') FROM te GROUP BY 1 UNION ALL SELECT DISTINCT panel_id, 'none', '' FROM te",
        "te AS (SELECT * FROM responses WHERE split = 'test')",
    ),
)


def _choices(s, d):
    rows = responses(s, d).where("split = 'test'")
    out = materialise.choice_rows(rows, rows, _folds(responses(s, d)).where("fold is null"), 2, SEED)
    shown = F.array_join(F.transform(F.coalesce("history", F.array().cast("array<struct<question_key:string,answer_index:int>>")), lambda x: F.concat(x["question_key"], F.lit("="), F.coalesce(x["answer_index"].cast("string"), F.lit("-")))), ",")
    return out.select("row_id", shown.alias("history"), F.round(F.col("log_prior")[0], 9).alias("log_prior"))


register(
    "choice_rows",
    _choices,
    sql(
        "SELECT row_id, coalesce(string_agg(k || '=' || coalesce(a, '-'), ',' ORDER BY rn), '') AS history, round(-ln(5), 9) AS log_prior FROM (SELECT row_id FROM te) LEFT JOIN (SELECT x.row_id, x.k, x.rn, r.answer_index::VARCHAR AS a FROM hk x LEFT JOIN te r ON r.panel_id = x.panel_id AND r.question_key = x.k WHERE rn <= 2) USING (row_id) GROUP BY 1",
        f"{FOLD_SQL}, te AS (SELECT * FROM responses WHERE split = 'test'), hk AS (SELECT t.row_id, t.panel_id, f.question_key AS k, row_number() OVER (PARTITION BY t.row_id ORDER BY sha256('{SEED}|' || t.panel_id || '|' || f.question_key)) AS rn "
        "FROM te t JOIN folds f USING (domain) WHERE f.fold IS NULL AND f.question_key <> t.question_key)",
    ),
)
_FOLD_PRIOR = PRIOR_SQL.replace("WHERE split = 'train' AND NOT is_unseen_item)", "JOIN roles USING (domain, question_key) WHERE split = 'train' AND role = 'train')", 1).replace("CASE WHEN NOT is_unseen_item AND coalesce(pc, pq)", "CASE WHEN coalesce(pc, pq)")


def _arrays(s, d):
    rows = responses(s, d)
    prior, train = materialise.fold_prior(rows, _folds(rows), 0, FOLDS)
    cache = rows.select("row_id", "person_id").join(table(s, d, "embeddings").select(F.col("vec_id").alias("person_id"), F.col("embedding").alias("vector")), "person_id")
    out = materialise.cached_arrays(cache, rows.where("split = 'test'"), prior, train)
    return rounded(out.select("row_id", F.col("vector")[0].cast("double").alias("v0"), *[F.col("log_prior")[i].alias(f"l{i}") for i in range(5)]), 7)


register(
    "cached_arrays",
    _arrays,
    sql(f"SELECT row_id, round(embedding[1]::DOUBLE, 7) AS v0, {', '.join(f'round(ln(greatest(prior[{i + 1}], 1e-12)), 7) AS l{i}' for i in range(5))} FROM priors JOIN embeddings ON vec_id = person_id WHERE split = 'test'", f"{FOLD_SQL}, {_FOLD_PRIOR}"),
)


def _signals(s, d):
    """What history is worth on seen items, and a known distribution on unseen ones."""
    all_rows, train = responses(s, d), _train(s, d)
    rows = with_prior(s, d).where("split = 'test' and not is_unseen_item").join(_orders(all_rows), "panel_id")
    listed = rows.select("row_id", "panel_id", F.explode(ranking.history_first_k(F.col("ordered_question_ids"), F.col("question_id"), 5)).alias("question_id"))
    history = listed.join(all_rows.select("panel_id", "question_id", F.col("question_key").alias("h"), F.col("answer_index").alias("h_value")), ["panel_id", "question_id"]).select("row_id", "h", "h_value")
    out = baselines.conditional_predict(rows, history, baselines.conditional_tables(train, least=10), baselines.item_graph(train))
    k = F.explode(F.array(F.struct(F.lit(0).alias("k"), probs.nll(F.col("prior"), F.col("answer_index")).alias("nll")), F.struct(F.lit(5).alias("k"), probs.nll(F.col("p"), F.col("answer_index")).alias("nll"))))
    each = out.select("domain", "panel_id", k.alias("x")).select("domain", "panel_id", "x.*")
    macro = each.groupBy("k", "domain", "panel_id").agg(F.avg("nll").alias("nll")).groupBy("k", "domain").agg(F.avg("nll").alias("nll"))
    seen = macro.agg(F.avg(F.when(F.col("k") == 0, F.col("nll"))).alias("seen_k0_nll"), F.avg(F.when(F.col("k") == 5, F.col("nll"))).alias("seen_k5_nll"))
    folds = _folds(all_rows)
    prior, _ = materialise.fold_prior(all_rows, folds, 0, FOLDS)
    items = folds.where(ranking.fold_role(F.col("fold"), F.lit(0), FOLDS) == "test").select("question_key")
    oracle = baselines.histogram(joins.semi(all_rows.where("split = 'train'"), items, ["question_key"]), ["question_key"]).select("question_key", probs.smooth(F.col("counts"), 0.5).alias("o"))
    units = joins.semi(all_rows.where("split = 'test'"), items, ["question_key"]).join(oracle, "question_key", "left").join(prior["position"], "n_options", "left")
    flat = probs.uniform(F.col("n_options"))
    gap = probs.nll(F.coalesce("pp", flat), F.col("answer_index")) - probs.nll(F.coalesce("o", flat), F.col("answer_index"))
    unseen = units.agg(F.avg(gap).alias("unseen_oracle_headroom"))
    both = seen.crossJoin(unseen)  # one row each
    budget = F.col("seen_k0_nll") - F.col("seen_k5_nll")
    return rounded(both.withColumn("seen_history_budget", budget).withColumn("seen_gate", budget >= 0.02).withColumn("unseen_gate", F.col("unseen_oracle_headroom") >= 0.05), 7)


register(
    "signal_audit",
    _signals,
    sql(
        "SELECT round(s0, 7) AS seen_k0_nll, round(s5, 7) AS seen_k5_nll, round(s0 - s5, 7) AS seen_history_budget, round(u, 7) AS unseen_oracle_headroom, s0 - s5 >= 0.02 AS seen_gate, u >= 0.05 AS unseen_gate FROM "
        "(SELECT avg(n0) AS s0, avg(n5) AS s5 FROM (SELECT domain, avg(n0) AS n0, avg(n5) AS n5 FROM (SELECT domain, panel_id, avg(-ln(greatest(prior[answer_index + 1], 1e-12))) AS n0, avg(-ln(greatest(e[answer_index + 1] / list_sum(e), 1e-12))) AS n5 FROM sz GROUP BY 1, 2) GROUP BY 1)), "
        "(SELECT avg(-ln(greatest(pp[answer_index + 1], 1e-12)) + ln(greatest(oc[answer_index + 1], 1e-12))) AS u FROM responses JOIN roles USING (domain, question_key) JOIN orc USING (question_key), fpp WHERE split = 'test' AND role = 'test')",
        f"{ORDERS}, {FOLD_SQL}, {PRIOR_SQL}, {_GRAPH}, {_COND.replace('>= 20', '>= 10')}, te AS (SELECT row_id, domain, panel_id, question_id, question_key, answer_index, prior FROM priors WHERE split = 'test' AND NOT is_unseen_item), "
        "g2 AS (SELECT a AS t, b AS h, c FROM graph UNION ALL SELECT b, a, c FROM graph), h5 AS (SELECT row_id, panel_id, unnest(list_filter(o, lambda x: x <> question_id)[1:5]) AS question_id FROM te JOIN ord USING (panel_id)), "
        "ev AS (SELECT te.row_id, c, cp, prior AS pr FROM h5 JOIN responses r USING (panel_id, question_id) JOIN te ON te.row_id = h5.row_id JOIN g2 ON g2.t = te.question_key AND g2.h = r.question_key JOIN cond ON cond.t = te.question_key AND cond.h = r.question_key AND cond.hv = r.answer_index), "
        f"ti AS (SELECT row_id, [{', '.join(f'sum(abs(c) * (ln(cp[{i}]) - ln(pr[{i}])))' for i in range(1, 6))}] AS tl FROM ev GROUP BY 1), "
        "sz AS (SELECT te.*, list_transform(range(1, 6), lambda i: exp(ln(prior[i]) + coalesce(tl[i], 0))) AS e FROM te LEFT JOIN ti USING (row_id)), "
        f"orc AS (SELECT question_key, {smooth_sql('c', 0.5)} AS oc FROM (SELECT question_key, {_counts('n')} AS c FROM responses JOIN roles USING (domain, question_key) WHERE split = 'train' AND role = 'test' GROUP BY 1)), "
        f"fpp AS (SELECT {smooth_sql('c', 0.5)} AS pp FROM (SELECT {_counts('n')} AS c FROM responses JOIN roles USING (domain, question_key) WHERE split = 'train' AND role = 'train'))",
    ),
)


def _fold_faults(s, d):
    """Items of all outer folds; one domain's are wrongly tested in the next fold as well."""
    folds = _folds(responses(s, d)).where("fold is not null")
    wrong = folds.where("domain = 'BUILDING'").withColumn("fold", F.pmod(F.col("fold") + 1, F.lit(FOLDS)))
    return protocols.fold_faults(folds.unionByName(wrong), ["domain", "question_key"])


register("fold_faults", _fold_faults, sql("SELECT domain, question_key, 2::BIGINT AS n FROM folds WHERE fold IS NOT NULL AND domain = 'BUILDING'", FOLD_SQL))


def _respondent_vectors(s, d):
    rows = responses(s, d)
    kept = rows.where("income_quintile <> 'Q5'").groupBy("panel_id", "domain").agg(F.array(F.avg("answer_index"), F.count(F.lit(1)).cast("double")).alias("vector"))
    return rounded(materialise.with_respondent_vectors(rows.where("split = 'test'").select("row_id", "panel_id", "domain"), kept).select("row_id", F.col("vector")[0].alias("v0"), F.col("vector")[1].alias("v1")))


register(
    "respondent_vector_join",
    _respondent_vectors,
    sql("SELECT row_id, round(v0, 9) AS v0, v1 FROM responses JOIN (SELECT panel_id, domain, avg(answer_index) AS v0, count(*)::DOUBLE AS v1 FROM responses WHERE income_quintile <> 'Q5' GROUP BY 1, 2) USING (panel_id, domain) WHERE split = 'test'"),
)


def _candidates(s, d):
    rows = asked(s, d).where("split = 'test'").select("row_id", "question_key", "answer_index", "options")
    shares = responses(s, d).where("split = 'train'").groupBy("question_key", F.col("answer_index").alias("option_index")).agg(F.count(F.lit(1)).alias("n"))
    out = joins.expand_options(rows, F.col("options"), shares)
    return out.select("row_id", F.col("option_index").cast("bigint").alias("option_index"), "option", (F.col("option_index") == F.col("answer_index")).alias("chosen"), "n")


register(
    "candidate_options",
    _candidates,
    sql(f"SELECT row_id, i::BIGINT AS option_index, ({AGREE})[i + 1] AS option, i = r.answer_index AS chosen, n FROM responses r JOIN (SELECT unnest(range(5)) AS i) ON true LEFT JOIN (SELECT question_key, answer_index AS i, count(*) AS n FROM responses WHERE split = 'train' GROUP BY 1, 2) USING (question_key, i) WHERE split = 'test'"),
)


def _support(s, d):
    support = table(s, d, "lineitem").groupBy(F.concat(F.lit("CC20_"), F.col("l_partkey").cast("string")).alias("item")).agg(F.countDistinct("l_quantity").alias("n_values"))
    return joins.one_to_one(_catalogue(s, d).select("item", "wave"), support, ["item"], "left")


register("catalogue_support", _support, f"WITH {_CATALOGUE} SELECT item, wave, n_values FROM cat LEFT JOIN (SELECT 'CC20_' || l_partkey AS item, count(DISTINCT l_quantity) AS n_values FROM lineitem GROUP BY 1) USING (item)")
register(
    "rows_of_role_items",
    lambda s, d: joins.semi(responses(s, d).where(F.col("split").isin("train", "validation")), _folds(responses(s, d)).where("fold is null"), ["question_key"]).select("row_id"),
    sql("SELECT row_id FROM responses WHERE split IN ('train', 'validation') AND question_key IN (SELECT question_key FROM folds WHERE fold IS NULL)", FOLD_SQL),
)


def _roles(s, d):
    folds = _folds(responses(s, d))
    role = lambda outer: folds.select(F.substring_index("question_key", "::", -1).alias("item"), ranking.fold_role(F.col("fold"), F.lit(outer), FOLDS).alias("role"))
    out = role(0)
    for outer in range(1, FOLDS):
        out = out.union(role(outer))
    return out.where("role in ('test', 'calibration')").distinct()


register(
    "role_item_union",
    _roles,
    sql("SELECT DISTINCT split_part(question_key, '::', 2) AS item, CASE WHEN fold IS NULL THEN 'calibration' ELSE 'test' END AS role FROM folds", FOLD_SQL),
)


def _complete(s, d):
    wide = responses(s, d).groupBy("panel_id").pivot("question_id", ["q01", "q02"]).agg(F.first(F.when(F.col("answer_index") == 4, float("nan")).otherwise(F.col("answer_index").cast("double"))))
    return joins.complete_cases(wide, ["q01", "q02"])


register(
    "complete_cases",
    _complete,
    sql("SELECT panel_id, max(answer_index) FILTER (WHERE question_id = 'q01')::DOUBLE AS q01, max(answer_index) FILTER (WHERE question_id = 'q02')::DOUBLE AS q02 FROM responses GROUP BY 1 HAVING q01 < 4 AND q02 < 4"),
)


def _options_of_items(s, d):
    """Vectors of five options for each question: rows of the embeddings by the number of the question."""
    keys = responses(s, d).select("question_key").distinct()
    number = keys.select("question_key", (F.dense_rank().over(_by_key()) - 1).alias("i"))
    e = table(s, d, "embeddings").select((F.col("vec_id") / 5).cast("bigint").alias("i"), (F.col("vec_id") % 5).cast("int").alias("option_index"), F.col("embedding").alias("vector"))
    return number.join(e, "i").drop("i")


def _by_key():
    from pyspark.sql import Window

    return Window.orderBy("question_key")  # questions of a catalogue


_OPTIONS = "qn AS (SELECT question_key, row_number() OVER (ORDER BY question_key) - 1 AS i FROM (SELECT DISTINCT question_key FROM responses)), ov AS (SELECT question_key, vec_id % 5 AS option_index, embedding FROM qn JOIN embeddings ON vec_id // 5 = i)"


def _database(s, d):
    return materialise.self_database(asked(s, d), _options_of_items(s, d), _folds(responses(s, d)).where("fold is null"))


_SELF = f"{FOLD_SQL}, {_OPTIONS}, sd AS (SELECT r.*, embedding FROM responses r JOIN (SELECT question_key FROM folds WHERE fold IS NULL) USING (question_key) JOIN ov ON ov.question_key = r.question_key AND ov.option_index = r.answer_index)"
register(
    "self_database",
    lambda s, d: rounded(_database(s, d).select("panel_id", "question_key", "question", "answer", F.col("vector")[0].cast("double").alias("v0")), 6),
    sql(f"SELECT panel_id, question_key, 'How do you see ' || question_id || '?' AS question, ({AGREE})[answer_index + 1] AS answer, round(embedding[1]::DOUBLE, 6) AS v0 FROM sd", _SELF),
)
register(
    "persona_summaries",
    lambda s, d: vectors.summaries(_database(s, d), 2),
    sql(
        f"SELECT panel_id, domain, '[' || domain || '] tendencies (calibration only): ' || string_agg('How do you see ' || question_id || '? -> ' || ({AGREE})[answer_index + 1], '; ' ORDER BY rn) AS summary FROM "
        "(SELECT *, row_number() OVER (PARTITION BY panel_id, domain ORDER BY question_key) AS rn FROM sd) WHERE rn <= 2 GROUP BY 1, 2",
        _SELF,
    ),
)


def _collaborative(s, d):
    splits = responses(s, d).select("panel_id", "split").distinct()
    return rounded(materialise.collaborative_index(_database(s, d), splits)[1].select("panel_id", *[F.col("centroid")[i].alias(f"c{i}") for i in (0, 31, 63)]), 7)


register("collaborative_index", _collaborative, sql("SELECT panel_id, round(avg(embedding[1]::DOUBLE), 7) AS c0, round(avg(embedding[32]::DOUBLE), 7) AS c31, round(avg(embedding[64]::DOUBLE), 7) AS c63 FROM sd WHERE split = 'train' GROUP BY 1", _SELF))


def _item_vectors(s, d):
    """Items in five clear groups: one-hot vectors with a trace of the item."""
    q = F.substring("question_id", 2, 2).cast("int")
    v = F.array(*[((q % 5) == i).cast("double") for i in range(5)], *[F.when(q == i, 0.01).otherwise(0.0) for i in range(1, 13)])
    return responses(s, d).select("domain", "question_key", v.alias("vector")).distinct()


_GROUPS = "it AS (SELECT DISTINCT domain, question_key, substr(question_id, 2)::INT % 5 AS g FROM responses), gm AS (SELECT domain, g, count(*) AS sz, row_number() OVER (PARTITION BY domain ORDER BY min(question_key)) - 1 AS c FROM it GROUP BY 1, 2), ic AS (SELECT domain, question_key, c, row_number() OVER (PARTITION BY domain, c ORDER BY question_key) AS place FROM it JOIN gm USING (domain, g))"
_DEALT = (
    "SELECT domain, question_key, c AS cluster, CASE WHEN cal THEN NULL ELSE ((row_number() OVER (PARTITION BY domain, cal ORDER BY "
    + f"substr(sha256('[{SEED}, \"cluster_folds\", \"' || question_key || '\"]'), 1, 16)) - 1) % 3)::BIGINT END AS fold FROM "
)
register(
    "cluster_split",
    lambda s, d: materialise.cluster_split(_item_vectors(s, d), 4, 3, 5, SEED).withColumn("fold", F.col("fold").cast("bigint")),
    sql(
        _DEALT + "(SELECT domain, question_key, c, list_contains(chosen, c) AS cal FROM ic JOIN best USING (domain))",
        f"{_GROUPS}, ms AS (SELECT domain, m, sum(sz) AS t, count(*) AS k, list(c ORDER BY c) AS chosen FROM gm, (SELECT unnest(range(1, 32)) AS m) WHERE (m >> c) & 1 = 1 GROUP BY 1, 2), tt AS (SELECT domain, sum(sz) AS n FROM gm GROUP BY 1), "
        "best AS (SELECT domain, arg_min(chosen, (abs(t - 4), (t > 4)::INT, k, chosen)) AS chosen FROM ms JOIN tt USING (domain) WHERE n - t >= 3 GROUP BY 1)",
    ),
)
register(
    "representative_split",
    lambda s, d: materialise.cluster_split(_item_vectors(s, d), 3, 3, 5, SEED, True).withColumn("fold", F.col("fold").cast("bigint")),
    sql(_DEALT + "(SELECT domain, question_key, c, c < 3 AND place = 1 AS cal FROM ic)", _GROUPS),
)

"""Queries over readers, encoders, latent traits, transfer and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom.functions import probs
from surveyloom.operators import baselines, joins, latent, metrics, readers
from surveyloom.plans.catalogue import register
from surveyloom.plans.files import AGREE
from surveyloom.plans.panel import OOD, _ood, sql
from surveyloom.plans.readying import _coefficients, asked
from surveyloom.plans.scores import _counts, rounded, smooth_sql
from surveyloom.sources import io
from surveyloom.sources.tables import SEED, responses, table

register(
    "encoded_texts",
    lambda s, d: rounded(readers.encoded(table(s, d, "part").select("p_partkey", "p_type"), "p_type", 4).select("p_partkey", *[F.col("vector")[i].alias(f"v{i}") for i in range(4)])),
    "SELECT p_partkey, " + ", ".join(f"round(('0x' || substr(sha256(p_type), {1 + 2 * i}, 2))::INT / 255.0::DOUBLE, 9) AS v{i}" for i in range(4)) + " FROM part",
)


def _variants(s, d):
    rows = asked(s, d).where("split = 'test'")
    donors = joins.donor_shuffle(rows, rows, ["country", "sex", "age_bin"], SEED).withColumnRenamed("answer_index", "donor_answer")
    both = rows.join(donors.select("panel_id", "question_key", "donor_answer"), ["panel_id", "question_key"])
    told = both.select("panel_id", "question_key", F.struct("question_key", "question", F.get("options", F.col("answer_index")).alias("answer")).alias("o"), F.struct("question_key", "question", F.get("options", F.col("donor_answer")).alias("answer")).alias("z"))
    held = told.groupBy("panel_id").agg(F.array_sort(F.collect_list("o")).alias("own"), F.array_sort(F.collect_list("z")).alias("other"))
    others = lambda c: F.slice(F.filter(c, lambda x: x["question_key"] != F.col("question_key")), 1, 2)
    targets = rows.join(held, "panel_id").select("row_id", "demographic_text", F.when(F.col("sex") == "female", F.lit("tends to agree")).otherwise("").alias("persona"), others("own").alias("history"), others("other").alias("shuffled_history"), "question", "options")
    return readers.variant_prompts(targets, list(readers.VARIANTS)).withColumn("prompt", F.sha2("prompt", 256))


_Q = "'How do you see ' || question_id || '?'"
register(
    "variant_prompts",
    _variants,
    sql(
        f"SELECT row_id, v AS variant, sha256('{readers.PERSONA_TASK}' || n || n || 'Respondent background:' || n || CASE WHEN v = 'pe_no_persona' THEN 'Withheld.' ELSE 'Country: ' || country || '; Gender: ' || sex END || n || n || CASE WHEN v = 'pe_demographic_behavior' AND sex = 'female' THEN 'Persona tendencies:' || n || 'tends to agree' || n || n ELSE '' END || "
        f"'Relevant previous responses:' || n || CASE WHEN v = 'pe_history' THEN coalesce(h, 'None') WHEN v = 'pe_shuffled_behavior' THEN coalesce(z, 'None') ELSE 'None' END || n || n || 'Target question:' || n || {_Q} || n || n || 'Options:' || n || array_to_string(list_transform(range(1, 6), lambda i: 'ABCDE'[i] || '. ' || ({AGREE})[i]), chr(10)) || n || n || 'Answer:') AS prompt "
        "FROM te LEFT JOIN hs USING (row_id), (SELECT chr(10) AS n), (VALUES " + ", ".join(f"('{v}')" for v in readers.VARIANTS) + ") vs(v)",
        f"te AS (SELECT *, sha256('{SEED}|' || question_key || '|' || panel_id) AS h0 FROM responses WHERE split = 'test'), "
        "dn AS (SELECT row_id, CASE WHEN nx <> panel_id THEN na WHEN f1 <> panel_id THEN a1 ELSE coalesce(a2, answer_index) END AS da FROM (SELECT *, coalesce(lead(panel_id) OVER w, first_value(panel_id) OVER w) AS nx, coalesce(lead(answer_index) OVER w, first_value(answer_index) OVER w) AS na FROM te WINDOW w AS (PARTITION BY question_key, country, sex, age_bin ORDER BY h0, panel_id)) "
        "JOIN (SELECT question_key, max(panel_id) FILTER (WHERE r = 1) AS f1, max(answer_index) FILTER (WHERE r = 1) AS a1, max(answer_index) FILTER (WHERE r = 2) AS a2 FROM (SELECT *, row_number() OVER (PARTITION BY question_key ORDER BY h0, panel_id) AS r FROM te) GROUP BY 1) USING (question_key)), "
        f"pr AS (SELECT t.row_id, o.question_key AS k, 'How do you see ' || o.question_id || '? -> ' AS q, ({AGREE})[o.answer_index + 1] AS a, ({AGREE})[da + 1] AS b, row_number() OVER (PARTITION BY t.row_id ORDER BY o.question_key) AS rn FROM te t JOIN te o ON o.panel_id = t.panel_id AND o.question_key <> t.question_key JOIN dn ON dn.row_id = o.row_id), "
        "hs AS (SELECT row_id, string_agg(rn || '. ' || q || a, chr(10) ORDER BY rn) AS h, string_agg(rn || '. ' || q || b, chr(10) ORDER BY rn) AS z FROM pr WHERE rn <= 2 GROUP BY 1)",
    ),
)


def _replies(s, d):
    k = F.col("p_partkey")
    entry = lambda token, x: F.concat(F.lit('{"token": "' + token + '", "logprob": '), x.cast("string"), F.lit("}"))
    items = F.concat_ws(", ", entry(" A", -(k % 7) / 2.0), entry("B", -(k % 5) / 4.0), F.when(k % 9 != 0, entry("C", -(k % 3) / 1.0)), entry("A", -(k % 4) / 1.0), entry("zz", F.lit(0.5)))
    payload = F.when(k % 11 == 0, F.lit('{"error": 1}')).otherwise(F.concat(F.lit('{"choices": [{"logprobs": {"content": [{"top_logprobs": ['), items, F.lit("]}]}}]}")))
    p = readers.label_shares(payload, ["A", "B", "C"])
    return rounded(table(s, d, "part").select("p_partkey", *[F.coalesce(p[i], F.lit(-1.0)).alias(f"p{i}") for i in range(3)]))


register(
    "reply_shares",
    _replies,
    "WITH z AS (SELECT p_partkey, p_partkey % 9 <> 0 AND p_partkey % 11 <> 0 AS ok, [greatest(-(p_partkey % 7) / 2.0, -(p_partkey % 4))::DOUBLE, -(p_partkey % 5) / 4.0::DOUBLE, -(p_partkey % 3)::DOUBLE] AS z FROM part), e AS (SELECT *, list_transform(z, lambda x: exp(x)) AS e FROM z) "
    "SELECT p_partkey, " + ", ".join(f"round(CASE WHEN ok THEN e[{i + 1}] / list_sum(e) ELSE -1 END, 9) AS p{i}" for i in range(3)) + " FROM e",
)


def _traits(s, d):
    """L9 with one dimension: the start follows from the income group, the history is the odd questions, the even ones are predicted."""
    rows = responses(s, d).withColumn("y", F.col("answer_index") / 4.0).withColumn("theta", F.array((F.substring("income_quintile", 2, 1).cast("int") - 3) / 2.0)).withColumn("odd", F.substring("question_id", 2, 2).cast("int") % 2 == 1)
    loadings = latent.item_loadings(rows.where("split = 'train'").select("question_key", "theta", "y"), 1)
    test = rows.where("split = 'test'")
    starts = test.select("panel_id", "theta").distinct()
    traits = latent.trait_update(test.where("odd").select("panel_id", "question_key", "y"), starts, loadings, 1)
    return rounded(latent.trait_scores(test.where("not odd").select("row_id", "panel_id", "question_key"), traits, loadings).select("row_id", "expected"), 8)


register(
    "trait_scores",
    _traits,
    sql(
        "SELECT row_id, round(least(greatest(b + a * th, 0), 1), 8) AS expected FROM x JOIN up USING (panel_id) LEFT JOIN ld USING (question_key) WHERE split = 'test' AND NOT odd",
        "x AS (SELECT *, answer_index / 4.0::DOUBLE AS y, (substr(income_quintile, 2, 1)::INT - 3) / 2.0::DOUBLE AS t, substr(question_id, 2, 2)::INT % 2 = 1 AS odd FROM responses), "
        "ld AS (SELECT question_key, (h1 * g0 - h01 * g1) / (h0 * h1 - h01 * h01) AS b, (h0 * g1 - h01 * g0) / (h0 * h1 - h01 * h01) AS a FROM (SELECT question_key, sum(y) AS g0, sum(y * t) AS g1, count(*)::DOUBLE AS h0, sum(t) AS h01, sum(t * t) + 1 AS h1 FROM x WHERE split = 'train' GROUP BY 1)), "
        "up AS (SELECT panel_id, any_value(t) + coalesce(sum(a * (y - b - a * t)) FILTER (WHERE odd), 0) / (coalesce(sum(a * a) FILTER (WHERE odd), 0) + 1) AS th FROM x LEFT JOIN ld USING (question_key) WHERE split = 'test' GROUP BY 1)",
    ),
)


def _kappa(s, d):
    """Options of brands, with coefficients of the part table; families are the first digit of a brand."""
    own = _coefficients(s, d).withColumn("family", F.substring("item", 1, 7)).withColumn("m", F.lit(20))
    options = latent.left_out_priors(own)
    p = table(s, d, "part")
    answer = F.pmod(F.col("p_size"), F.substring("p_brand", 7, 2).cast("int") % 3 + 3)
    rows = p.select(F.col("p_brand").alias("item"), (F.col("p_size") / 25.0 - 1).alias("z1"), (F.col("p_retailprice") / 1500.0 - 1).alias("z2"), answer.alias("answer"))
    return rounded(latent.select_kappa(options, rows), 7)


register(
    "select_kappa",
    _kappa,
    "WITH pb AS (SELECT p_brand AS item, substr(p_brand, 1, 7) AS fam, substr(p_brand, 7, 2)::INT % 3 + 3 AS n, p_size, p_retailprice FROM part), c AS (SELECT item, any_value(fam) AS fam, n, p_size % n AS pos, avg(p_retailprice) / 1000 AS c0, avg(p_size) / 50 AS c1, 0.5::DOUBLE AS c2 FROM pb GROUP BY 1, 3, 4), "
    "q AS (SELECT c.item, c.pos, any_value(c.c0) AS c0, any_value(c.c1) AS c1, coalesce(avg(o.c0) FILTER (WHERE o.n = c.n AND o.pos = c.pos), avg(o.c0)) AS q0, coalesce(avg(o.c1) FILTER (WHERE o.n = c.n AND o.pos = c.pos), avg(o.c1)) AS q1 FROM c JOIN c o ON o.fam <> c.fam GROUP BY 1, 2), "
    "k AS (SELECT item, pos, kappa, 20 / (20 + kappa) * c0 + (1 - 20 / (20 + kappa)) * q0 AS b0, 20 / (20 + kappa) * c1 + (1 - 20 / (20 + kappa)) * q1 AS b1 FROM q, (SELECT unnest([0.5, 1, 2, 5, 20, 50, 200]::DOUBLE[]) AS kappa)), "
    "e AS (SELECT row_number() OVER () AS r, item, p_size / 25.0::DOUBLE - 1 AS z1, p_retailprice / 1500.0::DOUBLE - 1 AS z2, p_size % n AS ans FROM pb), "
    "s AS (SELECT r, kappa, b0 + b1 * z1 + 0.5 * z2 AS s, pos = ans AS hit FROM e JOIN k USING (item)), l AS (SELECT r, kappa, -ln(sum(exp(s)) FILTER (WHERE hit) / sum(exp(s))) AS l FROM s GROUP BY 1, 2), "
    "m AS (SELECT kappa, round(avg(l), 9) AS loss FROM l GROUP BY 1) SELECT kappa, round(loss, 7) AS loss, row_number() OVER (ORDER BY loss, kappa) = 1 AS chosen FROM m",
)


def _transfer(s, d):
    """R2 tests each domain with shares of the others; R3 tests held-out demographic cells with shares of the rest."""
    rows = responses(s, d)
    # a domain's own counts are taken off those of all
    own = baselines.histogram(rows.where("split = 'train'"), ["domain"]).select("domain", F.posexplode("counts").alias("i", "x"))
    every = own.groupBy("i").agg(F.sum("x").alias("total"))
    rest = own.join(every, "i").groupBy("domain").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", (F.col("total") - F.col("x")).alias("x")))), lambda c: c["x"]).alias("counts"))
    shares = rest.select("domain", probs.smooth(F.col("counts"), 0.5).alias("p"))
    r2 = rows.where("split = 'test'").join(shares, "domain").withColumn("regime", F.lit("R2"))
    cells = _ood(s, d).select("panel_id", "is_ood_intersection")
    marked = rows.join(cells, "panel_id")
    inside = baselines.histogram(marked.where("not is_ood_intersection"), ["question_key"]).select("question_key", probs.smooth(F.col("counts"), 0.5).alias("p"))
    r3 = marked.where("is_ood_intersection").drop("is_ood_intersection").join(inside, "question_key").withColumn("regime", F.lit("R3"))
    scored = metrics.scored(r2.unionByName(r3))
    return rounded(metrics.respondent_macro(scored, ["nll", "correct"], ["regime"]), 8)


register(
    "transfer_evaluation",
    _transfer,
    sql(
        "SELECT regime, domain, round(nll, 8) AS nll, round(correct, 8) AS correct, n_panels FROM md UNION ALL SELECT regime, 'macro', round(avg(nll), 8), round(avg(correct), 8), sum(n_panels)::BIGINT FROM md GROUP BY 1",
        f"{OOD}, hd AS (SELECT h.domain, {_counts('n')} AS c FROM responses r JOIN (SELECT DISTINCT domain FROM responses) h ON h.domain <> r.domain WHERE split = 'train' GROUP BY 1), mk AS (SELECT r.*, is_ood_intersection AS o FROM responses r JOIN (SELECT panel_id, is_ood_intersection FROM ood) USING (panel_id)), "
        f"iq AS (SELECT question_key, {_counts('n')} AS c FROM mk WHERE NOT o GROUP BY 1), "
        f"al AS (SELECT 'R2' AS regime, domain, panel_id, answer_index, {smooth_sql('c', 0.5)} AS p FROM responses JOIN hd USING (domain) WHERE split = 'test' UNION ALL SELECT 'R3', domain, panel_id, answer_index, {smooth_sql('c', 0.5)} FROM mk JOIN iq USING (question_key) WHERE o), "
        "mp AS (SELECT regime, domain, panel_id, avg(-ln(greatest(p[answer_index + 1], 1e-12))) AS nll, avg((list_position(p, list_max(p)) - 1 = answer_index)::INT) AS correct FROM al GROUP BY 1, 2, 3), md AS (SELECT regime, domain, avg(nll) AS nll, avg(correct) AS correct, count(*) AS n_panels FROM mp GROUP BY 1, 2)",
    ),
)


def _review(s, d):
    k = F.col("p_partkey")
    p = table(s, d, "part").select(k.cast("int").alias("position"), F.concat(F.lit("CC20_"), k.cast("string")).alias("item"), F.when(k % 3 != 0, k % 40).alias("page"), ((k % 20) / 20.0).alias("coverage"), F.filter(F.array(F.when(k % 2 == 0, F.lit("branch_risk")), F.when(k % 5 == 0, F.lit("randomized"))), lambda x: x.isNotNull()).alias("flags"), F.col("p_name").alias("snippet"))
    return rounded(io.review_report(p, "Target review"))


register(
    "review_report",
    _review,
    "WITH l AS (SELECT p_partkey AS position, ['## CC20_' || p_partkey, '- Page: ' || CASE WHEN p_partkey % 3 <> 0 THEN (p_partkey % 40)::VARCHAR ELSE 'not found' END, '- Coverage: ' || format('{:.4f}', p_partkey % 20 / 20.0::DOUBLE), '- Automated flags: ' || CASE WHEN p_partkey % 10 = 0 THEN 'branch_risk, randomized' WHEN p_partkey % 2 = 0 THEN 'branch_risk' WHEN p_partkey % 5 = 0 THEN 'randomized' ELSE 'none' END, "
    "'- Manual decision: PENDING', p_name] AS t FROM part) SELECT position, unnest(range(6)) AS line, unnest(t) AS text FROM l UNION ALL SELECT -1, 0, '# Target review'",
)


def _respondent_means(s, d):
    """Each respondent's mean loss and accuracy over its rows."""
    rows = responses(s, d)
    shares = baselines.histogram(rows.where("split = 'train'"), ["question_key"]).select("question_key", probs.smooth(F.col("counts"), 0.5).alias("p"))
    scored = metrics.scored(rows.where("split = 'test'").join(shares, "question_key"))
    return rounded(scored.groupBy("panel_id").agg(F.avg("nll").alias("nll"), F.avg("correct").alias("accuracy"), F.count(F.lit(1)).alias("n")))


register(
    "respondent_means",
    _respondent_means,
    sql(
        "SELECT panel_id, round(avg(-ln(greatest(p[answer_index + 1], 1e-12))), 9) AS nll, round(avg((list_position(p, list_max(p)) - 1 = answer_index)::INT), 9) AS accuracy, count(*) AS n FROM responses JOIN sh USING (question_key) WHERE split = 'test' GROUP BY 1",
        f"sh AS (SELECT question_key, {smooth_sql('c', 0.5)} AS p FROM (SELECT question_key, {_counts('n')} AS c FROM responses WHERE split = 'train' GROUP BY 1))",
    ),
)

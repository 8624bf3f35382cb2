"""Queries over item catalogues and questionnaires, built from the part table."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom.functions import probs, text
from surveyloom.operators import baselines, questionnaires
from surveyloom.plans.catalogue import register
from surveyloom.plans.items import _wide
from surveyloom.plans.pairs import _PERSONA
from surveyloom.plans.panel import sql
from surveyloom.plans.scores import _counts, rounded, smooth_sql
from surveyloom.sources import io, scratch
from surveyloom.sources.tables import PEOPLE_SQL, SEED, people, responses, table


def _catalogue(s, d):
    p, k = table(s, d, "part"), F.col("p_partkey")
    return p.select(
        F.concat(F.lit("CC20_"), k.cast("string")).alias("item"), F.concat(F.lit("CC20_"), F.floor(k / 3).cast("string")).alias("family"), F.when(k % 2 == 0, "source_pre").otherwise("target_post").alias("wave"),
        (k % 10 != 0).alias("found"), F.when(k % 7 != 0, k % 11 != 0).alias("item_specific_text"), F.when(k % 5 != 0, k % 13 == 0).alias("dynamic_text"),
        (F.lit(0.8) + (k % 20) / 100.0).alias("paired_coverage"), ((k % 9) / 10.0).alias("entropy_nats"), (k % 4 != 0).alias("eligible"),
    )


_CATALOGUE = (
    "cat AS (SELECT 'CC20_' || p_partkey AS item, 'CC20_' || (p_partkey // 3) AS family, CASE WHEN p_partkey % 2 = 0 THEN 'source_pre' ELSE 'target_post' END AS wave, p_partkey % 10 <> 0 AS found, "
    "CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 11 <> 0 END AS ist, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 13 = 0 END AS dyn, 0.8::DOUBLE + (p_partkey % 20) / 100.0::DOUBLE AS cov, (p_partkey % 9) / 10.0::DOUBLE AS ent, p_partkey % 4 <> 0 AS eligible FROM part)"
)
register(
    "usable_items",
    lambda s, d: questionnaires.usable_items(_catalogue(s, d), ["target_post"]).select("item", "family"),
    f"WITH {_CATALOGUE} SELECT item, family FROM cat WHERE wave = 'target_post' AND found AND coalesce(ist, false) AND NOT coalesce(dyn, false) AND cov >= 0.85 AND ent >= 0.25",
)


def _pages(s, d):
    k = F.col("p_partkey")
    name = F.concat(F.lit("CC20_"), F.col("p_size").cast("string"))
    line = F.when(k % 4 == 0, F.concat(F.lit("["), name, F.lit("] "), F.col("p_name"))).when(k % 4 == 1, F.concat(F.lit("show if "), name, F.lit(" asked"))).when(k % 4 == 2, F.concat(F.col("p_name"), F.lit(" random $x"))).otherwise(F.concat(name, F.lit("-a check all that apply")))
    p = table(s, d, "part").select("p_brand", F.struct("p_partkey", line.alias("line")).alias("x"))
    return p.groupBy(F.col("p_brand").alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("text"))


def _items(s, d):
    return table(s, d, "part").select(F.concat(F.lit("CC20_"), F.col("p_size").cast("string")).alias("item")).distinct().unionByName(s.createDataFrame([("CC20_none",)], "item string")).withColumn("family", text.family(F.col("item")))


register(
    "located_items",
    lambda s, d: questionnaires.locate_items(_pages(s, d), _items(s, d)).select("item", "found", "page", "definitions", F.sha2("snippet", 256).alias("snippet"), "branch_risk", "randomized", "multiple_select", "dynamic_text"),
    "WITH ln AS (SELECT p_brand AS page, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, CASE p_partkey % 4 WHEN 0 THEN '[CC20_' || p_size || '] ' || p_name WHEN 1 THEN 'show if CC20_' || p_size || ' asked' WHEN 2 THEN p_name || ' random $x' ELSE 'CC20_' || p_size || '-a check all that apply' END AS line FROM part), "
    "its AS (SELECT DISTINCT 'CC20_' || p_size AS item FROM part UNION ALL SELECT 'CC20_none'), "
    "ht AS (SELECT item, page, i, starts_with(line, '[' || item || '] ') OR starts_with(line, item || '-') AS ex FROM ln JOIN its ON contains(lower(line), lower(item))), "
    "pg AS (SELECT item, page, coalesce(min(i) FILTER (WHERE ex), min(i)) AS i, coalesce(nullif(count(*) FILTER (WHERE ex), 0), count(*)) AS n FROM ht GROUP BY 1, 2), "
    "fs AS (SELECT item, min(page) AS page, arg_min(i, page) AS i, sum(n)::BIGINT AS definitions FROM pg GROUP BY 1), "
    "st AS (SELECT f.item, coalesce(max(l.i) FILTER (WHERE l.i <= f.i AND (starts_with(l.line, '[' || item || ']') OR starts_with(l.line, item || '-') OR starts_with(l.line, item || ' '))), greatest(any_value(f.i) - 8, 0)) AS a FROM fs f JOIN ln l USING (page) GROUP BY f.item), "
    "sn AS (SELECT f.item, string_agg(l.line, ' ' ORDER BY l.i) AS t FROM fs f JOIN st USING (item) JOIN ln l ON l.page = f.page AND l.i >= a AND l.i < f.i + 16 GROUP BY 1) "
    "SELECT item, page IS NOT NULL AS found, page, coalesce(definitions, 0) AS definitions, sha256(coalesce(t, '')) AS snippet, contains(lower(coalesce(t, '')), 'show if') AS branch_risk, contains(lower(coalesce(t, '')), 'random') AS randomized, "
    "contains(lower(coalesce(t, '')), 'check all') OR contains(lower(coalesce(t, '')), 'multiple') AS multiple_select, contains(coalesce(t, ''), '$') AS dynamic_text FROM its LEFT JOIN fs USING (item) LEFT JOIN sn USING (item)",
)


def _printed(s, d):
    """Printed option lists in four layouts, with the codes that were observed."""
    k, a, b = F.col("p_partkey"), F.col("p_type"), F.col("p_brand")
    item = F.concat(F.lit("CC20_"), k.cast("string"))
    cat = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in c])
    layout = (
        F.when(k % 5 == 0, cat("Do you agree or disagree? [", item, "]"))
        .when(k % 5 == 1, cat("4 ○ before ", item, " ask 1 ○ ", a, " 2 ○ ", b, " 3 Skipped"))
        .when(k % 5 == 2, cat("◯ [1] ", a, " ◯ [2]   ", b, " [CC20_next] more"))
        .when(k % 5 == 3, cat("[1] ", a, " [2] ", b, " [7] never seen [1] again"))
        .otherwise(cat(item, " without any list"))
    )
    observed = F.when(k % 5 == 0, F.array(*[F.lit(i) for i in range(1, 6)])).otherwise(F.array(F.lit(1), F.lit(2)))
    return table(s, d, "part").select(item.alias("item"), F.concat(F.lit("CC20_"), F.floor(k / 7).cast("string")).alias("family"), layout.alias("snippet"), observed.alias("observed"))


def _labelled(s, d):
    return _printed(s, d).withColumn("labels", text.option_labels(F.col("snippet"), F.col("item"), F.col("observed")))


def _shown(m: str):
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"])), "|")


_AGREE = "1=Strongly agree|2=Somewhat agree|3=Neither agree nor disagree|4=Somewhat disagree|5=Strongly disagree"
register(
    "option_label_map",
    lambda s, d: _labelled(s, d).select("item", _shown("labels").alias("labels")),
    f"SELECT 'CC20_' || p_partkey AS item, CASE p_partkey % 5 WHEN 0 THEN '{_AGREE}' WHEN 4 THEN '' ELSE '1=' || p_type || '|2=' || p_brand END AS labels FROM part",
)
register(
    "completed_labels",
    lambda s, d: questionnaires.completed_labels(_labelled(s, d)).select("item", _shown("labels").alias("labels"), F.array_join("missing", ",").alias("missing"), "retained"),
    "WITH l AS (SELECT p_partkey AS k, p_partkey // 7 AS f, unnest([1, 2, 3, 4, 5]) AS code, unnest(CASE p_partkey % 5 WHEN 0 THEN ['Strongly agree', 'Somewhat agree', 'Neither agree nor disagree', 'Somewhat disagree', 'Strongly disagree'] WHEN 4 THEN [NULL, NULL, NULL, NULL, NULL]::VARCHAR[] ELSE [p_type, p_brand, NULL, NULL, NULL] END) AS label FROM part), "
    "b AS (SELECT f, code, arg_min(label, (-length(label), 'CC20_' || k)) AS label FROM l WHERE label IS NOT NULL GROUP BY 1, 2), "
    "w AS (SELECT k, code, coalesce(l.label, b.label) AS label, code <= 2 OR k % 5 = 0 AS seen FROM l LEFT JOIN b USING (f, code)) "
    "SELECT 'CC20_' || k AS item, coalesce(string_agg(code || '=' || label, '|' ORDER BY code), '') AS labels, coalesce(string_agg(code::VARCHAR, ',' ORDER BY code) FILTER (WHERE seen AND label IS NULL), '') AS missing, count(*) FILTER (WHERE seen AND label IS NULL) = 0 AS retained FROM w GROUP BY k",
)


def _prose(s, d):
    k = F.col("p_partkey")
    inner = F.concat(F.lit('{"b": {"name": "'), F.col("p_brand"), F.lit('"}, "a": '), k.cast("string"), F.lit("}"))
    prose = F.when(k % 4 == 0, F.concat(F.lit("no object {here} or {"), F.col("p_name"))).when(k % 4 == 1, F.concat(F.lit("first {broken: "), inner, F.lit("} and then {}"))).otherwise(F.concat(F.lit("Sure:\n```"), inner, F.lit("``` {\"c\": 1}")))
    return table(s, d, "part").select("p_partkey", questionnaires.first_json(prose).alias("json"))


register("json_in_prose", _prose, """SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN '{"a":' || p_partkey || ',"b":{"name":"' || p_brand || '"}}' END AS json FROM part""")


def _structured(s, d):
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in questionnaires.ITEM_TYPES]), (k % 7 + 1).cast("int"))
    scale = F.element_at(F.array(*[F.lit(x) for x in questionnaires.SCALE_TYPES]), (k % 6 + 1).cast("int"))
    both = table(s, d, "part").withColumn("v", F.explode(F.array(F.lit(1), F.lit(2))))
    option = lambda c: F.struct(F.lit(c).alias("code"), ((k % 9 - 4) / 4.0 * (c - 1.5) + F.col("v") * (k % 3) / 10.0).alias("stance_direction"), ((k % 5) / 5.0 + c / 10.0).alias("behavior_intensity"), (k % 8 == c).alias("is_neutral"), ((k % 4) / 4.0).alias("uncertainty"))
    return both.select(
        F.concat(F.lit("CC20_"), k.cast("string")).alias("item"), F.concat(F.lit("v"), F.col("v").cast("string")).alias("template"), ((k + F.col("v")) % 12 != 0).alias("valid"),
        F.when((F.col("v") == 2) & (k % 5 == 0), F.lit("other")).otherwise(kind).alias("item_type"), scale.alias("scale_type"), F.split(F.lower("p_type"), " ").alias("domains"),
        F.array(F.struct(F.col("p_brand").alias("name"), (k % 10 / 10.0).alias("relevance"))).alias("constructs"), ((k % 6) / 6.0).alias("global_uncertainty"), F.array(option(1), option(2)).alias("options"),
    )


_DOMAINS, _CONSTRUCTS = ["brass", "steel", "tin"], ["Brand#11", "Brand#23"]


def _features(s, d):
    records = _structured(s, d).where("valid")
    asked = table(s, d, "part").select(F.concat(F.lit("CC20_"), F.col("p_partkey").cast("string")).alias("item"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("option_code"))
    out = questionnaires.structured_matrix(asked, records, _DOMAINS, _CONSTRUCTS)
    return out.select("item", F.col("option_code").cast("bigint").alias("option_code"), "known", F.array_join(F.transform("features", lambda x: F.round(x * 1000).cast("bigint").cast("string")), ",").alias("features"))


register(
    "structured_features",
    _features,
    "WITH o AS (SELECT p_partkey AS k, p_brand, lower(p_type) AS t, unnest([1, 2, 3]) AS c FROM part), v AS (SELECT *, CASE WHEN (k + 1) % 12 <> 0 THEN 1 WHEN (k + 2) % 12 <> 0 THEN 2 END AS v FROM o) "
    "SELECT 'CC20_' || k AS item, c::BIGINT AS option_code, c < 3 AS known, CASE WHEN c = 3 THEN array_to_string(list_transform(range(23), lambda x: '0'), ',') ELSE array_to_string(list_transform(list_concat([(k % 9 - 4) / 4.0::DOUBLE * (c - 1.5) + v * (k % 3) / 10.0::DOUBLE, (k % 5) / 5.0::DOUBLE + c / 10.0::DOUBLE, (k % 8 = c)::INT, (k % 4) / 4.0::DOUBLE], "
    "list_transform(range(7), lambda i: (i = CASE WHEN v = 2 AND k % 5 = 0 THEN 6 ELSE k % 7 END)::INT::DOUBLE), list_transform(range(6), lambda i: (i = k % 6)::INT::DOUBLE), "
    f"list_transform({_DOMAINS}, lambda w: list_contains(string_split(t, ' '), w)::INT::DOUBLE), list_transform({_CONSTRUCTS}, lambda b: CASE WHEN b = p_brand THEN k % 10 / 10.0::DOUBLE ELSE 0 END), [(k % 6) / 6.0::DOUBLE]), lambda x: round(x * 1000)::BIGINT::VARCHAR), ',') END AS features FROM v",
)
register(
    "item_prompts",
    lambda s, d: questionnaires.item_prompts(
        table(s, d, "part").select(F.col("p_partkey").cast("string").alias("item"), F.col("p_name").alias("question")),
        table(s, d, "part").select(F.col("p_partkey").cast("string").alias("item"), F.explode(F.array(F.struct(F.lit(1).alias("position"), F.lit(5).alias("code"), F.col("p_type").alias("label")), F.struct(F.lit(0).alias("position"), F.lit(9).alias("code"), F.col("p_brand").alias("label")))).alias("o")).select("item", "o.*"),
        '{"type":"object"}',
    ).withColumn("prompt", F.sha2("prompt", 256)),
    "WITH q AS (SELECT p_partkey::VARCHAR AS item, p_name AS question, '- [9] ' || p_brand || chr(10) || '- [5] ' || p_type AS options FROM part), t(template, w) AS (VALUES "
    + ", ".join(f"('{k}', '{v.replace(chr(10), '~')}')" for k, v in questionnaires.ITEM_TEMPLATES.items())
    + ") SELECT item, template, sha256(concat_ws(chr(31), item, question, options, template)) AS cache_key, sha256(replace(replace(replace(replace(replace(w, '~', chr(10)), '{schema}', '{\"type\":\"object\"}'), '{item}', item), '{options}', options), '{question}', question)) AS prompt FROM q, t",
)
register(
    "agreement_audit",
    lambda s, d: rounded(questionnaires.agreement_audit(_structured(s, d)), 8),
    "WITH r AS (SELECT p_partkey AS k, unnest([1, 2]) AS v FROM part), g AS (SELECT *, (k + v) % 12 <> 0 AS valid, CASE WHEN v = 2 AND k % 5 = 0 THEN 6 ELSE k % 7 END AS it FROM r), "
    "b AS (SELECT a.k, a.it = b.it AS same FROM g a JOIN g b ON a.k = b.k AND a.v = 1 AND b.v = 2 WHERE a.valid AND b.valid), "
    "o AS (SELECT k, unnest([1, 2]) AS c FROM b), z AS (SELECT (k % 9 - 4) / 4.0::DOUBLE * (c - 1.5) + (k % 3) / 10.0::DOUBLE AS sa, (k % 9 - 4) / 4.0::DOUBLE * (c - 1.5) + 2 * (k % 3) / 10.0::DOUBLE AS sb, (k % 5) / 5.0::DOUBLE + c / 10.0::DOUBLE AS i FROM o), "
    "y AS (SELECT rank() OVER (ORDER BY sa) + (count(*) OVER (PARTITION BY sa) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY sb) + (count(*) OVER (PARTITION BY sb) - 1) / 2.0::DOUBLE AS rb FROM z), "
    "x AS (SELECT (SELECT count(*) FROM g) AS records, (SELECT count(*) FROM g WHERE valid) AS valid_records, (SELECT count(*) FROM b) AS paired_items, (SELECT round(avg(same::INT), 8) FROM b) AS item_type_agreement, 1.0::DOUBLE AS scale_type_agreement, (SELECT round(corr(ra, rb), 8) FROM y) AS option_stance_spearman, 1.0::DOUBLE AS option_intensity_spearman) "
    "SELECT *, round(valid_records / records, 8) AS valid_rate, valid_records / records >= 0.9 AND option_stance_spearman >= 0.5 AS stable_enough FROM x",
)


def _pretest(s, d):
    rows = responses(s, d).where("split = 'test'").groupBy("person_id").pivot("question_id", [f"q{i:02d}" for i in range(1, 13)]).agg(F.first("answer_index"))
    return questionnaires.pretest_respondents(rows, "person_id", ["q11"], [f"q{i:02d}" for i in range(1, 11)], 4, 5).select("person_id", F.col("history_count").cast("bigint").alias("history_count"))


register(
    "pretest_respondents",
    _pretest,
    sql("SELECT person_id, count(*) FILTER (WHERE question_id <= 'q10') AS history_count FROM responses WHERE split = 'test' GROUP BY 1 HAVING count(*) FILTER (WHERE question_id = 'q11') = 1 AND count(*) FILTER (WHERE question_id <= 'q10') >= 4 ORDER BY 1 LIMIT 5"),
)


def _locked(s, d):
    path = scratch.fresh_path(s, "split") + "/manifest.json"
    io.save_manifest(s, path, questionnaires.locked_split(_catalogue(s, d), 12, SEED))
    back = io.load_manifest(s, path)
    rows = [("source", i, None) for i in back["source_items"]] + [("target", i, f) for i, f in zip(back["target_items"], back["target_families"], strict=True)]
    return s.createDataFrame(rows, "role string, item string, family string")


register(
    "locked_split",
    _locked,
    f"WITH {_CATALOGUE}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY cov DESC, ent DESC, item) AS r FROM cat WHERE eligible AND wave = 'target_post' AND cov >= 0.95) WHERE r = 1 ORDER BY cov DESC, ent DESC, family LIMIT 12) "
    "SELECT 'source' AS role, item, NULL AS family FROM cat WHERE eligible AND wave = 'source_pre' UNION ALL SELECT 'target', item, family FROM t",
)


def _deviating(s, d):
    rows = responses(s, d).where("split = 'train'").withColumn("cluster", F.expr(_PERSONA))
    population = baselines.histogram(rows, ["question_key"]).select("question_key", probs.smooth(F.col("counts"), 0.5).alias("pq"))
    options = F.array(*[F.lit(x) for x in ("never", "seldom", "at times", "often", "always")])
    catalogue = rows.select("question_key", F.concat(F.lit("Topic "), F.col("question_id")).alias("question"), options.alias("options")).distinct()
    return questionnaires.deviating_questions(baselines.persona_tables(rows), population, catalogue).withColumn("cluster", F.col("cluster").cast("bigint"))


register(
    "deviating_questions",
    _deviating,
    sql(
        "SELECT cl AS cluster, 'Persona tendencies (calibration only): ' || string_agg('Topic ' || split_part(question_key, '::', 2) || ' -> ' || (['never', 'seldom', 'at times', 'often', 'always'])[list_position(pp, list_max(pp))], '; ' ORDER BY rk) AS persona FROM "
        "(SELECT *, row_number() OVER (PARTITION BY cl ORDER BY round(list_max(list_transform(range(1, 6), lambda i: abs(pp[i] - pq[i]))), 12) DESC, question_key) AS rk FROM pt JOIN pl USING (question_key)) WHERE rk <= 3 GROUP BY 1",
        f"tr AS (SELECT *, {_PERSONA} AS cl FROM responses WHERE split = 'train'), pt AS (SELECT cl::BIGINT AS cl, question_key, {smooth_sql('c', 0.5)} AS pp FROM (SELECT cl, question_key, {_counts('n')} AS c FROM tr GROUP BY 1, 2)), "
        f"pl AS (SELECT question_key, {smooth_sql('c', 0.5)} AS pq FROM (SELECT question_key, {_counts('n')} AS c FROM tr GROUP BY 1))",
    ),
)


def _loadings(s, d):
    p = table(s, d, "part").groupBy(F.col("p_brand").alias("factor"), F.col("p_type").alias("feature")).agg(F.round(F.avg("p_retailprice") - 1000, 6).alias("loading"))
    return questionnaires.strongest_loadings(p, 3).withColumn("rank", F.col("rank").cast("bigint"))


register(
    "strongest_loadings",
    _loadings,
    "WITH l AS (SELECT p_brand AS factor, p_type AS feature, round(avg(p_retailprice) - 1000, 6) AS loading FROM part GROUP BY 1, 2) SELECT factor, feature, loading, rank, 'positive' AS side FROM (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY loading DESC, feature) AS rank FROM l) WHERE rank <= 3 "
    "UNION ALL SELECT factor, feature, loading, rank, 'negative' FROM (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY loading, feature) AS rank FROM l) WHERE rank <= 3",
)
_DEMOGRAPHICS = ["country", "sex", "age_bin", "education", "income_quintile"]


def _vocabulary(s, d):
    rows = people(s, d).select("person_id", "split", *_DEMOGRAPHICS)
    fitted = questionnaires.fitted_vocabulary(rows.where("split = 'train' and country <> 'FRANCE'"), _DEMOGRAPHICS)
    return rounded(questionnaires.encoded_columns(rows, fitted, _DEMOGRAPHICS).select("person_id", *[f"{c}_code" for c in _DEMOGRAPHICS]))


register(
    "demographic_codes",
    _vocabulary,
    f"WITH {PEOPLE_SQL}, "
    + ", ".join(f"v{i} AS (SELECT {c}, row_number() OVER (ORDER BY {c}) AS c{i} FROM (SELECT DISTINCT {c} FROM people WHERE split = 'train' AND country <> 'FRANCE'))" for i, c in enumerate(_DEMOGRAPHICS))
    + " SELECT person_id, " + ", ".join(f"coalesce(c{i}, 0) AS {c}_code" for i, c in enumerate(_DEMOGRAPHICS)) + " FROM people " + " ".join(f"LEFT JOIN v{i} USING ({c})" for i, c in enumerate(_DEMOGRAPHICS)),
)


def _padded(s, d):
    rows = _wide(s, d).groupBy("item").agg(F.array_sort(F.collect_set("value")).alias("v")).withColumn("v", F.transform("v", lambda x: F.char_length(x).cast("double")))
    whole, mask = questionnaires.padded_options(F.col("v"), 200, -1.0)
    return rounded(rows.select("item", F.size(whole).alias("width"), probs.total(whole).alias("total"), probs.total(mask).alias("real")))


register(
    "padded_options",
    _padded,
    "WITH wide AS (SELECT unnest(['p_brand', 'p_type', 'p_size']) AS item, unnest([p_brand, p_type, p_size::VARCHAR]) AS value FROM part), v AS (SELECT DISTINCT * FROM wide) SELECT item, 200::BIGINT AS width, (sum(length(value)) - (200 - count(*)))::DOUBLE AS total, count(*)::DOUBLE AS real FROM v GROUP BY 1",
)
register(
    "clean_item_texts",
    lambda s, d: table(s, d, "part").select(
        "p_partkey",
        text.question_of(F.concat(F.lit("[Q1] {grid} Please rate  this. [CC20_"), F.col("p_partkey").cast("string"), F.lit("] "), F.when(F.col("p_partkey") % 3 == 0, F.lit("x")).otherwise(F.col("p_name")), F.lit(" (Allows one selection) ◯ [1] "), F.col("p_type")), F.concat(F.lit("CC20_"), F.col("p_partkey").cast("string"))).alias("stem"),
        text.without_layout(F.concat(F.col("p_type"), F.when(F.col("p_partkey") % 2 == 0, F.lit("  varlabel: None width: 3")).otherwise(F.lit(" (open [CC20_x]) "))), text.LABEL_LAYOUT).alias("label"),
    ),
    "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 AND length(p_name) >= 12 THEN p_name ELSE 'Please rate this. [CC20_' || p_partkey || '] ' || CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE p_name END END AS stem, p_type AS label FROM part",
)

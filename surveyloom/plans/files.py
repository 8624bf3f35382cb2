"""Queries that write files in the shared folder and read them back: sources, sinks and caches."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom.functions import hashing, probs, text
from surveyloom.operators import baselines, costs
from surveyloom.plans.catalogue import register
from surveyloom.plans.pairs import _GRAPH, _train
from surveyloom.plans.panel import FOLD_SQL, ORDERS, _folds, _orders, sql
from surveyloom.plans.scores import _P5, FREQUENCY_SQL, PRIOR_SQL, predictions, rounded
from surveyloom.sources import io, scratch
from surveyloom.sources.tables import SEED, answers, people, responses, table

AGREE = ["Strongly agree", "Agree", "Neither", "Disagree", "Strongly disagree"]
COLOURS = ["red", "green", "blue", "black", "white"]


def _json_arrays(rows, path: str, key: str, per_file: int = 20_000) -> None:
    """A folder of files that each hold some rows as one JSON array, as the survey archives do."""
    files = max(1, -(-rows.count() // per_file))
    each = rows.select(F.pmod(F.xxhash64(key), F.lit(files)).alias("file"), F.to_json(F.struct(*rows.columns)).alias("j"))
    whole = each.groupBy("file").agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]")).alias("value"))
    whole.write.partitionBy("file").text(path)


def _flattened(s, d):
    """A domain's question and respondent files, written and flattened again."""
    root = scratch.fresh_path(s, "survey")
    asked = [(f"Q{i:02d}", f"How do you see topic {i}?", dict(zip("12345", COLOURS if i == 12 else AGREE, strict=True))) for i in range(1, 13)]
    _json_arrays(s.createDataFrame(asked, io.QUESTIONS), f"{root}/building_questions.json", "question_id")
    code = F.when(F.col("person_id") % 17 == 0, F.lit("9")).otherwise((F.col("answer_index") + 1).cast("string"))
    given = answers(s, d).groupBy("person_id").agg(F.collect_list(F.struct(F.concat(F.lit("Q"), F.lpad(F.col("q").cast("string"), 2, "0")).alias("k"), code.alias("v"))).alias("g"))
    stray = F.when(F.col("person_id") % 5 == 0, F.array(F.struct(F.lit("Q99").alias("k"), F.lit("1").alias("v"))))
    n = F.col("person_id")
    attributes = F.create_map(
        F.lit("Country Prefix ISO 3166 Code"), F.col("country"),
        F.lit("Sex of Respondent"), F.when(n % 11 == 0, F.lit("No answer")).otherwise(F.col("sex")),
        F.lit("Age of respondent"), F.concat(F.lit("about "), (n % 120).cast("string")),
        F.lit("Top-Bottom self-placement, 10 pt scale"), (n % 12).cast("string"),
        F.lit("Place of living: urban - rural"), F.col("urbanicity"),
        F.lit("Weighting factor"), F.when(n % 4 == 0, F.lit("0")).otherwise(F.concat((1 + n % 3).cast("string"), F.lit(",5"))),
    )
    who = people(s, d).where("domain = 'BUILDING'").join(given, "person_id")
    who = who.select("person_id", attributes.alias("attributes"), F.map_from_entries(F.when(stray.isNull(), F.col("g")).otherwise(F.concat("g", stray))).alias("questions_answer"))
    _json_arrays(who, f"{root}/building_respondents.json", "person_id")
    return io.flatten(*io.read_domain(s, root, "Building"), "Building")


_WHO = "who AS (SELECT p.*, q, answer_index, person_id % 120 AS a, person_id % 12 AS sc FROM people p JOIN answers USING (person_id) WHERE domain = 'BUILDING')"
_AGE = "CASE WHEN a < 14 OR a > 110 THEN 'Missing' WHEN a < 30 THEN '18-29' WHEN a < 45 THEN '30-44' WHEN a < 65 THEN '45-64' ELSE '65+' END"
_INCOME = "CASE WHEN sc BETWEEN 1 AND 10 THEN 'Q' || ceil((11 - sc) / 2.0)::INT ELSE 'Missing' END"
_SEX = "CASE WHEN person_id % 11 = 0 THEN 'Missing' ELSE sex END"
register(
    "flatten_json",
    lambda s, d: rounded(_flattened(s, d)[0].select("row_id", "question", "answer_index", "answer_text", "is_ordinal", "survey_weight", "country", "sex", "age_bin", "income_quintile", "demographic_text")),
    sql(
        "SELECT 'Building::' || person_id || '::q' || lpad(q::VARCHAR, 2, '0') AS row_id, 'How do you see topic ' || q || '?' AS question, answer_index::BIGINT AS answer_index, "
        f"({AGREE})[answer_index + 1] AS answer_text, true AS is_ordinal, CASE WHEN person_id % 4 = 0 THEN 1.0 ELSE 1.5 + person_id % 3 END::DOUBLE AS survey_weight, country, {_SEX} AS sex, {_AGE} AS age_bin, {_INCOME} AS income_quintile, "
        f"'Country: ' || country || '; Gender: ' || {_SEX} || '; Age group: ' || {_AGE} || '; Education: Missing; Income quintile (self-reported): ' || {_INCOME} || '; Employment: Missing; Marital/partnership status: Missing; Urbanicity: ' || urbanicity AS demographic_text "
        "FROM who WHERE q <> 12 AND person_id % 17 <> 0",
        _WHO,
    ),
)
register(
    "flatten_dropped",
    lambda s, d: _flattened(s, d)[1],
    sql(
        "SELECT 'Building' AS domain, reason, count(*) AS n FROM (SELECT CASE WHEN person_id % 17 = 0 THEN 'invalid answer' WHEN q = 12 THEN 'not ordinal' END AS reason FROM who UNION ALL "
        "SELECT 'unknown question' FROM (SELECT DISTINCT person_id FROM who WHERE person_id % 5 = 0)) WHERE reason IS NOT NULL GROUP BY 1, 2",
        _WHO,
    ),
)


def _processed(s, d):
    """B1, A3: responses and orders written and joined again by panel."""
    root, rows = scratch.fresh_path(s, "processed"), responses(s, d)
    io.write_tables({"responses": rows, "calibration_orders": _orders(rows)}, root)
    read = lambda name: s.read.parquet(f"{root}/{name}.parquet")
    return read("responses").join(read("calibration_orders"), "panel_id", "left").select("row_id", "split", F.element_at("ordered_question_ids", 1).alias("first_question"))


register("processed_tables", _processed, sql("SELECT row_id, split, o[1] AS first_question FROM responses LEFT JOIN ord USING (panel_id)", ORDERS))


def _prediction_files(s, d):
    """A4: three files, one of them a permuted run that must not be read, two with common keys."""
    root, rows = scratch.fresh_path(s, "predictions"), predictions(s, d).select("row_id", "domain", "p")
    marked = lambda run: rows.withColumn("run", F.lit(run))
    marked("a").write.parquet(f"{root}/a.parquet")
    marked("b").where("domain = 'BUILDING'").write.parquet(f"{root}/b.parquet")
    marked("perm").write.parquet(f"{root}/perm_c.parquet")
    return rounded(io.read_predictions(s, root, ["row_id"]).select("row_id", "run", F.col("p")[0].alias("p0")))


register("prediction_files", _prediction_files, sql("SELECT row_id, CASE WHEN domain = 'BUILDING' THEN 'b' ELSE 'a' END AS run, round(p[1], 9) AS p0 FROM preds", FREQUENCY_SQL))


def _csv(s, d, **how):
    root = scratch.fresh_path(s, "csv")
    io.write_tables({"part": table(s, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")}, root, ("csv", "parquet"))
    return io.read_csv(s, f"{root}/part.csv", **how)


_PART = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size bigint"
register("csv_pattern_columns", lambda s, d: _csv(s, d, pattern="^p_(partkey|brand|type)$"), "SELECT p_partkey::VARCHAR AS p_partkey, p_brand, p_type FROM part")
register("csv_projected_predicate", lambda s, d: _csv(s, d, schema=_PART, columns=["p_partkey", "p_size"], where=F.col("p_size") > 25), "SELECT p_partkey, p_size::BIGINT AS p_size FROM part WHERE p_size > 25")
register(
    "csv_dimension",
    lambda s, d: table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n")).join(_csv(s, d, schema=_PART, columns=["p_partkey", "p_name"]), "p_partkey", "left"),
    "SELECT l_partkey AS p_partkey, count(*) AS n, any_value(p_name) AS p_name FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1",
)


def _log(s, d):
    """A log that is appended to twice; later records replace earlier ones of their key."""
    path, rows = scratch.fresh_path(s, "log"), table(s, d, "events").select(F.col("event_id").cast("string").alias("cache_key"), "event_type", "user_id")
    io.append_jsonl(rows.withColumn("turn", F.lit(1)), path)
    io.append_jsonl(rows.where("user_id % 3 = 0").withColumn("turn", F.lit(2)), path)
    return io.read_jsonl(s, path, "cache_key", "cache_key string, event_type string, user_id bigint, turn bigint")


register("jsonl_last_record", _log, "SELECT event_id::VARCHAR AS cache_key, event_type, user_id, CASE WHEN user_id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS turn FROM events")


def _valid(s, d):
    """Valid records by item and template."""
    path = scratch.fresh_path(s, "structured")
    rows = table(s, d, "part").select(F.col("p_partkey").alias("item"), F.explode(F.array(F.lit("v1"), F.lit("v2"))).alias("template"), (F.col("p_size") % 4 != 0).alias("valid"), "p_brand")
    io.append_jsonl(rows, path)
    return io.read_jsonl(s, path, ["item", "template"], "item bigint, template string, valid boolean, p_brand string", "valid").select("item", "template", "p_brand")


register("jsonl_valid_records", _valid, "SELECT p_partkey AS item, t.template, p_brand FROM part, (VALUES ('v1'), ('v2')) t(template) WHERE p_size % 4 <> 0")


def _archive(s, d):
    path = scratch.fresh_path(s, "options")
    e = table(s, d, "embeddings")
    io.save_option_vectors(e.select(F.concat(F.lit("q"), (F.col("vec_id") / 4).cast("bigint").cast("string")).alias("question_key"), (F.col("vec_id") % 4).alias("option_index"), F.col("embedding").alias("vector")), path)
    back = io.load_option_vectors(s, path)
    return rounded(back.groupBy("question_key").agg(F.count(F.lit(1)).alias("n_options"), F.max(F.size("vector")).alias("dim"), F.sum(F.col("vector")[0].cast("double") * (F.col("option_index") + 1)).alias("s")), 6)


register("option_vector_archive", _archive, "SELECT 'q' || (vec_id // 4) AS question_key, count(*) AS n_options, max(len(embedding))::BIGINT AS dim, round(sum(embedding[1]::DOUBLE * (vec_id % 4 + 1)), 6) AS s FROM embeddings GROUP BY 1")


def _cached(s, d):
    """Two appends; the second adds only what is missing."""
    e = table(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("row_id"), F.col("label").cast("string").alias("panel_id"), F.lit(5).alias("k"), F.col("embedding").alias("vector"), F.array(F.lit(0.5).cast("float")).alias("logits"))
    settings = {"model": "none", "k": 5}
    cache = io.VectorCache(s, scratch.fresh_path(s, "cache"), settings)
    cache.append(e.where("row_id % 2 = 0"))
    again = io.VectorCache(s, cache.folder, settings)  # the same settings: reused
    again.append(again.missing(e))
    return again


register(
    "vector_cache_rows",
    lambda s, d: rounded(_cached(s, d).read().select("row_id", "panel_id", F.col("vector")[1].cast("double").alias("v1")), 6),
    "SELECT vec_id::VARCHAR AS row_id, label::VARCHAR AS panel_id, round(embedding[2]::DOUBLE, 6) AS v1 FROM embeddings",
)
register(
    "vector_cache_counts",
    lambda s, d: s.createDataFrame([tuple(_cached(s, d).validate()[k] for k in ("rows", "vectors", "logits"))], "n_rows bigint, n_vectors bigint, n_logits bigint"),
    "SELECT count(*) AS n_rows, count(embedding) AS n_vectors, count(embedding) AS n_logits FROM embeddings",
)


def _partitioned(s, d):
    folder = scratch.fresh_path(s, "representations")
    rows = responses(s, d).select("row_id", "split", F.col("answer_index").alias("k"), F.lit("B").alias("protocol"), F.lit(0).alias("option_seed"), F.lit("resp").alias("family"))
    io.write_cache(rows, folder)
    return io.read_cache(s, folder, protocol="B", split="test", k=3).select("row_id", "family")


register("cache_partition_scan", _partitioned, sql("SELECT row_id, 'resp' AS family FROM responses WHERE split = 'test' AND answer_index = 3"))


def _saved_folds(s, d):
    path = scratch.fresh_path(s, "folds") + "/item_folds.json"
    io.save_folds(_folds(responses(s, d)), path)
    return io.load_folds(s, path).withColumn("fold", F.col("fold").cast("bigint"))


register("saved_folds", _saved_folds, sql("SELECT domain, question_key, fold::BIGINT AS fold FROM folds", FOLD_SQL))


def _saved_prior(s, d):
    folder = scratch.fresh_path(s, "prior")
    io.save_prior(baselines.population_prior(baselines.only_train(responses(s, d))), folder)
    return rounded(io.load_prior(s, folder)["country"].select("question_key", "country", *[F.get("pc", F.lit(i)).alias(f"p{i}") for i in range(5)]))


register("saved_prior", _saved_prior, sql(f"SELECT question_key, country, {_P5.format('pc')} FROM pc", PRIOR_SQL))


def _graph_lookup(s, d):
    """The saved graph asked for every ordered pair of items; unknown pairs are 0."""
    folder = scratch.fresh_path(s, "graph")
    train = _train(s, d)
    io.save_prior({"graph": baselines.item_graph(train)}, folder)
    items = responses(s, d).select("domain", F.col("question_key").alias("a")).distinct()
    asked = items.join(items.withColumnRenamed("a", "b"), "domain").where("a <> b")
    return rounded(baselines.graph_lookup(asked, io.load_prior(s, folder, ("graph",))["graph"]))


register(
    "graph_lookup",
    _graph_lookup,
    sql("SELECT domain, a, b, round(coalesce(c, 0), 9) + 0 AS c FROM (SELECT x.domain, x.q AS a, y.q AS b FROM it x JOIN it y USING (domain) WHERE x.q <> y.q) LEFT JOIN (SELECT a, b, c FROM graph UNION ALL SELECT b, a, c FROM graph) USING (a, b)",
        f"{_GRAPH}, it AS (SELECT DISTINCT domain, question_key AS q FROM responses)"),
)


def _sink(s, d):
    path = scratch.fresh_path(s, "sink")
    io.save_predictions(predictions(s, d).select("row_id", "p"), path)
    back = io.load_predictions(s, path)
    return rounded(back.select("row_id", probs.argmax(F.col("p")).alias("best"), *[F.col("p")[i].alias(f"p{i}") for i in range(5)]))


register("prediction_sink", _sink, sql(f"SELECT row_id, (list_position(p, list_max(p)) - 1)::BIGINT AS best, {_P5.format('p')} FROM preds", FREQUENCY_SQL))


def _costs(s, d):
    """Cost records of runs, here from the orders of each segment, and the cost of mixed allocation."""
    runs = people(s, d).join(answers(s, d), "person_id").groupBy(F.col("domain").alias("method")).agg(F.countDistinct("person_id").alias("n_respondents"), F.count(F.lit(1)).alias("n_forward_passes"), F.sum(0.25 * (F.col("q") + 1)).alias("elapsed_seconds"))
    out = costs.cost_table(runs.unionByName(s.createDataFrame([("none", 0, 0, 1.0)], runs.schema)))
    return rounded(out.withColumn("mixed", costs.mixed_cost(F.col("gpu_hours_per_1k"), F.lit(0.1), F.lit(0.25))))


register(
    "cost_table",
    _costs,
    sql(
        "SELECT *, round(0.25::DOUBLE * gpu + 0.075::DOUBLE, 9) AS mixed FROM (SELECT method, n_respondents, n_forward_passes, round(e, 9) AS elapsed_seconds, CASE WHEN n_respondents > 0 THEN e / n_respondents * 1000 / 3600 ELSE 0 END AS gpu, "
        "round(CASE WHEN n_respondents > 0 THEN e / n_respondents * 1000 / 3600 ELSE 0 END, 9) AS gpu_hours_per_1k, round(CASE WHEN n_respondents > 0 THEN e / n_respondents * 1000 ELSE 0 END, 9) AS latency_ms_per_respondent FROM cr)".replace("SELECT *,", "SELECT * EXCLUDE (gpu),"),
        "cr AS (SELECT domain AS method, count(DISTINCT person_id) AS n_respondents, count(*) AS n_forward_passes, sum(0.25::DOUBLE * (q + 1)) AS e FROM people JOIN answers USING (person_id) GROUP BY 1 UNION ALL SELECT 'none', 0, 0, 1.0::DOUBLE)",
    ),
)
register(
    "synthetic_panel_counts",
    lambda s, d: io.synthetic_panels(s, 300, 7, seed=SEED).groupBy("domain", "question_id").agg(F.countDistinct("panel_id").alias("n_panels"), (F.min("answer_index") >= 0).alias("low"), (F.max("answer_index") <= 4).alias("high")),
    "SELECT d.domain, 'v' || i AS question_id, 300::BIGINT AS n_panels, true AS low, true AS high FROM (VALUES ('Environment'), ('Role of Government')) d(domain), (SELECT unnest(range(7)) AS i)",
)
register(
    "content_keys",
    lambda s, d: table(s, d, "part").select("p_partkey", hashing.content_key(F.col("p_brand"), text.option_text(F.col("p_name"), F.col("p_type"))).alias("key")),
    """SELECT p_partkey, sha256('{"f0":"' || p_brand || '","f1":"' || p_name || ' :: ' || p_type || '"}') AS key FROM part""",
)

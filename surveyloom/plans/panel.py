"""Queries over the response view: curation, splits, histories, protocols and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom.functions import hashing
from surveyloom.operators import protocols, ranking
from surveyloom.plans.catalogue import register
from surveyloom.sources.tables import PEOPLE_SQL, RESPONSES_SQL, SEED, hex_sql, people, responses

FOLDS, POOL_FRACTION, POOL_CAP = 3, 0.25, 3


def sql(body: str, more: str = "") -> str:
    return f"WITH {RESPONSES_SQL}{', ' + more if more else ''} {body}"


def hashed(*parts: str) -> str:
    """16 hex digits over a JSON array; parts in braces are columns."""
    text = ", ".join(p if p.isdigit() else ('"\' || ' + p[1:-1] + " || '\"" if p.startswith("{") else f'"{p}"') for p in parts)
    return hex_sql(f"'[{text}]'")


register(
    "flatten_responses",
    lambda s, d: responses(s, d).select("row_id", "panel_id", "question_key", F.col("answer_index").cast("bigint").alias("answer_index"), "split", "is_unseen_item"),
    sql("SELECT row_id, panel_id, question_key, answer_index::BIGINT AS answer_index, split, is_unseen_item FROM responses"),
)
register(
    "hash_bucket_split",
    lambda s, d: people(s, d).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("person_id").alias("first_id")),
    f"WITH {PEOPLE_SQL} SELECT split, count(*) AS n, min(person_id) AS first_id FROM people GROUP BY split",
)
register(
    "hash_bucket_big_endian",
    lambda s, d: people(s, d).select("person_id", hashing.big_endian_bucket(F.col("person_id"), SEED).cast("bigint").alias("bucket")),
    f"SELECT c_custkey AS person_id, (('0x' || substr(sha256('{SEED}|' || c_custkey), 1, 16))::UBIGINT % 10)::BIGINT AS bucket FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
register(
    "top_items_per_domain",
    lambda s, d: ranking.top_items(responses(s, d), 5),
    sql(
        "SELECT domain, question_key, n_panels FROM (SELECT domain, question_key, count(DISTINCT panel_id) AS n_panels, row_number() OVER "
        "(PARTITION BY domain ORDER BY count(DISTINCT panel_id) DESC, question_key) AS rn FROM responses GROUP BY 1, 2) WHERE rn <= 5"
    ),
)
register(
    "country_cap_hash",
    lambda s, d: ranking.hash_cap(people(s, d).select("domain", "country", "panel_id"), ["domain", "country"], 3, SEED, "cap"),
    f"WITH {PEOPLE_SQL} SELECT domain, country, panel_id FROM (SELECT *, row_number() OVER (PARTITION BY domain, country ORDER BY {hashed(str(SEED), 'cap', '{panel_id}')}) AS rn FROM people) WHERE rn <= 3",
)
register(
    "curated_rows",
    lambda s, d: ranking.curated(responses(s, d), 8, 10, 5, 3, SEED).select("row_id"),
    sql(
        "SELECT row_id FROM k2 WHERE panel_id IN (SELECT panel_id FROM k2 GROUP BY 1 HAVING count(DISTINCT question_key) >= 3)",
        "ti AS (SELECT domain, question_key, row_number() OVER (PARTITION BY domain ORDER BY count(DISTINCT panel_id) DESC, question_key) AS rn FROM responses GROUP BY 1, 2), "
        "k0 AS (SELECT * FROM responses WHERE question_key IN (SELECT question_key FROM ti WHERE rn <= 8)), "
        "tc AS (SELECT domain, country, row_number() OVER (PARTITION BY domain ORDER BY count(DISTINCT panel_id) DESC, country) AS rn FROM k0 WHERE country <> 'Missing' GROUP BY 1, 2), "
        "k1 AS (SELECT k0.* FROM k0 SEMI JOIN (SELECT * FROM tc WHERE rn <= 10) t USING (domain, country)), "
        f"cp AS (SELECT panel_id, row_number() OVER (PARTITION BY domain, country ORDER BY {hashed(str(SEED), 'cap', '{panel_id}')}) AS rn FROM (SELECT DISTINCT panel_id, domain, country FROM k1)), "
        "k2 AS (SELECT * FROM k1 WHERE panel_id IN (SELECT panel_id FROM cp WHERE rn <= 5))",
    ),
)
register(
    "item_holdout_flag",
    lambda s, d: responses(s, d).groupBy("domain", "question_key", "is_unseen_item").agg(F.count(F.lit(1)).alias("n")),
    sql("SELECT domain, question_key, is_unseen_item, count(*) AS n FROM responses GROUP BY ALL"),
)


def _ood(s, d):
    return ranking.cell_holdout(people(s, d).select("panel_id", "domain", "country", "sex", "age_bin", "education"), ["age_bin", "education"], 0.2, 20, SEED)


OOD = (
    "pc AS (SELECT panel_id, domain, country, sex, age_bin, education, concat_ws('|', age_bin, education) AS cell FROM people), "
    "cs AS (SELECT domain, cell FROM pc GROUP BY 1, 2 HAVING count(DISTINCT panel_id) >= 20), "
    f"cr AS (SELECT domain, cell, row_number() OVER (PARTITION BY domain ORDER BY {hashed(str(SEED), 'intersection_holdout', '{domain}', '{cell}')}) AS rk, count(*) OVER (PARTITION BY domain) AS n FROM cs), "
    "hc AS (SELECT domain, cell FROM cr WHERE rk <= greatest(1, round_even(n * 0.2, 0))), "
    "ood AS (SELECT pc.*, hc.cell IS NOT NULL AS is_ood_intersection FROM pc LEFT JOIN hc USING (domain, cell))"
)
register("ood_intersection_cells", lambda s, d: _ood(s, d).select("panel_id", "cell", "is_ood_intersection"), f"WITH {PEOPLE_SQL}, {OOD} SELECT panel_id, cell, is_ood_intersection FROM ood")

_L = [["domain", "country", "sex", "age_bin"], ["domain", "country", "sex"], ["domain", "country"], ["domain"]]
STRATA_SQL = "s0 AS (SELECT *, NULL::VARCHAR AS stratum FROM ood)" + "".join(
    f", s{i + 1} AS (SELECT * EXCLUDE (stratum, lab), CASE WHEN stratum IS NULL AND sum((stratum IS NULL)::INT) OVER (PARTITION BY lab) >= 5 THEN lab ELSE stratum END AS stratum "
    f"FROM (SELECT *, concat_ws('|', {', '.join(cols)}) AS lab FROM s{i}))"
    for i, cols in enumerate(_L)
)
register(
    "collapsed_strata",
    lambda s, d: protocols.collapsed_strata(_ood(s, d)).select("panel_id", "stratum"),
    f"WITH {PEOPLE_SQL}, {OOD}, {STRATA_SQL} SELECT panel_id, coalesce(stratum, domain) AS stratum FROM s4",
)
register(
    "stratified_split",
    lambda s, d: protocols.stratified_split(protocols.collapsed_strata(_ood(s, d))).select("panel_id", "split"),
    f"WITH {PEOPLE_SQL}, {OOD}, {STRATA_SQL}, z AS (SELECT panel_id, is_ood_intersection AS o, coalesce(stratum, domain) AS stratum FROM s4), "
    f"y AS (SELECT *, (row_number() OVER (PARTITION BY stratum, o ORDER BY {hashed(str(SEED), 'split', '{panel_id}')}, panel_id) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY stratum, o) AS sh FROM z) "
    "SELECT panel_id, CASE WHEN o THEN 'ood_intersection' WHEN sh <= 0.7::DOUBLE THEN 'train' WHEN sh <= (0.7::DOUBLE + 0.1::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM y",
)

ORDERS = f"ord AS (SELECT panel_id, list(question_id ORDER BY {hashed(str(SEED), '{panel_id}', '{question_id}')}) AS o FROM responses WHERE NOT is_unseen_item GROUP BY 1)"


def _orders(rows):
    return ranking.calibration_orders(rows, [SEED])


register(
    "calibration_order_list",
    lambda s, d: _orders(responses(s, d)).select("panel_id", F.array_join("ordered_question_ids", ",").alias("question_ids")),
    sql("SELECT panel_id, array_to_string(o, ',') AS question_ids FROM ord", ORDERS),
)


def _history(s, d):
    rows = responses(s, d)
    test = rows.where("split = 'test' and not is_unseen_item").join(_orders(rows), "panel_id")
    return test.select("row_id", F.array_join(ranking.history_first_k(F.col("ordered_question_ids"), F.col("question_id"), 3), ",").alias("history"))


register(
    "history_first_k",
    _history,
    sql("SELECT row_id, array_to_string(list_filter(o, lambda x: x <> question_id)[1:3], ',') AS history FROM responses JOIN ord USING (panel_id) WHERE split = 'test' AND NOT is_unseen_item", ORDERS),
)
register(
    "stable_history",
    lambda s, d: responses(s, d).groupBy("panel_id").agg(F.collect_set("question_key").alias("c")).select("panel_id", F.array_join(ranking.stable_history(F.col("panel_id"), F.col("c"), 4, SEED), ",").alias("history")),
    sql(f"SELECT panel_id, array_to_string(list(question_key ORDER BY sha256('{SEED}|' || panel_id || '|' || question_key))[1:4], ',') AS history FROM responses GROUP BY 1"),
)


def _targets(s, d):
    rows = responses(s, d)
    return protocols.target_rows(rows, _orders(rows), "test", 3).select("row_id")


register("target_rows", _targets, sql("SELECT row_id FROM responses LEFT JOIN ord USING (panel_id) WHERE split = 'test' AND NOT is_unseen_item AND NOT coalesce(list_contains(o[1:3], question_id), false)", ORDERS))

FOLD_SQL = (
    f"fr AS (SELECT domain, question_key, row_number() OVER (PARTITION BY domain ORDER BY {hashed(str(SEED), 'item_folds', '{question_key}')}) - 1 AS r, count(*) OVER (PARTITION BY domain) AS n "
    "FROM (SELECT DISTINCT domain, question_key FROM responses)), "
    f"fp AS (SELECT *, least(least({POOL_CAP}, greatest(1, round_even(n * {POOL_FRACTION}, 0)::INT)), n - {FOLDS}) AS pool FROM fr), "
    f"folds AS (SELECT domain, question_key, CASE WHEN r >= pool THEN ((r - pool) % {FOLDS})::INT END AS fold FROM fp), "
    f"roles AS (SELECT *, CASE WHEN fold IS NULL THEN 'calibration' WHEN fold = 0 THEN 'test' WHEN fold = 1 % {FOLDS} THEN 'validation' ELSE 'train' END AS role FROM folds)"
)


def _folds(rows):
    return ranking.round_robin(rows, FOLDS, SEED, POOL_FRACTION, POOL_CAP)


register(
    "fold_roles",
    lambda s, d: _folds(responses(s, d)).select("domain", "question_key", ranking.fold_role(F.col("fold"), F.lit(0), FOLDS).alias("role")),
    sql("SELECT domain, question_key, role FROM roles", FOLD_SQL),
)


def _flat(units):
    return units.select("panel_id", "question_key", "item_pool", F.array_join("eligible_source_keys", ",").alias("sources"))


def _units_sql(target: str, pool: str, item_pool: str, join: str = "") -> str:
    return (
        f"SELECT t.panel_id, t.question_key, '{item_pool}' AS item_pool, coalesce(array_to_string(list_sort(list_filter(a.keys, lambda x: x <> t.question_key)), ','), '') AS sources "
        f"FROM (SELECT * FROM responses {join} WHERE {target}) t LEFT JOIN (SELECT panel_id, list(DISTINCT question_key) AS keys FROM responses {join} WHERE {pool} GROUP BY 1) a USING (panel_id)"
    )


_SEEN = "split = 'test' AND NOT is_unseen_item"
register("protocol_a_units", lambda s, d: _flat(protocols.protocol_a(responses(s, d), "test")), sql(_units_sql(_SEEN, _SEEN, "seen")))


def _protocol_b(s, d):
    rows = responses(s, d)
    return _flat(protocols.protocol_b(rows, _folds(rows), "test", 0, FOLDS))


register("protocol_b_units", _protocol_b, sql(_units_sql("split = 'test' AND role = 'test'", "split = 'test' AND role = 'calibration'", "unseen", "JOIN roles USING (domain, question_key)"), FOLD_SQL))


def _candidates(s, d):
    rows = responses(s, d)
    return _flat(protocols.protocol_b_candidates(rows, _folds(rows), "validation"))


register(
    "protocol_b_candidates",
    _candidates,
    sql(_units_sql("split = 'validation' AND fold IS NOT NULL", "split = 'validation' AND fold IS NULL", "unseen", "JOIN folds USING (domain, question_key)"), FOLD_SQL),
)
_C = _SEEN + " AND domain = 'BUILDING'"
register("protocol_c_units", lambda s, d: _flat(protocols.protocol_c(responses(s, d), "BUILDING", "test")), sql(_units_sql(_C, _C, "seen")))


def _protocol_d(s, d):
    rows = responses(s, d).drop("split").join(_ood(s, d).select("panel_id", F.when(F.col("is_ood_intersection"), "ood_intersection").otherwise("train").alias("split")), "panel_id")
    return _flat(protocols.protocol_d(rows))


_D = "NOT is_unseen_item AND panel_id IN (SELECT panel_id FROM ood WHERE is_ood_intersection)"
register("protocol_d_units", _protocol_d, sql(_units_sql(_D, _D, "seen"), OOD))


def _respondents(s, d):
    rows = responses(s, d)
    return protocols.respondent_units(rows, _folds(rows), "test").select("panel_id", "domain", F.array_join("eligible_source_keys", ",").alias("sources"))


register(
    "respondent_units",
    _respondents,
    sql(
        "SELECT panel_id, domain, coalesce(array_to_string(list_sort(list(DISTINCT question_key) FILTER (WHERE fold IS NULL)), ','), '') AS sources FROM responses JOIN folds USING (domain, question_key) WHERE split = 'test' GROUP BY 1, 2",
        FOLD_SQL,
    ),
)


def _leaks(s, d):
    rows = responses(s, d)
    return protocols.leakage(rows, _orders(rows))


register(
    "leakage_violations",
    _leaks,
    sql(
        "SELECT 'panels in several splits' AS kind, count(*) AS n FROM (SELECT panel_id FROM responses GROUP BY 1 HAVING count(DISTINCT split) > 1) UNION ALL "
        "SELECT 'repeated rows', count(*) FROM (SELECT row_id FROM responses GROUP BY 1 HAVING count(*) > 1) UNION ALL "
        "SELECT 'unseen items in orders', count(*) FROM (SELECT domain, unnest(o) AS question_id FROM ord JOIN (SELECT DISTINCT panel_id, domain FROM responses) USING (panel_id)) x "
        "SEMI JOIN (SELECT DISTINCT domain, question_id FROM responses WHERE is_unseen_item) u USING (domain, question_id)",
        ORDERS,
    ),
)

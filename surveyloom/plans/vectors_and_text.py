"""Queries over vectors, texts, JSON and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from surveyloom.functions import probs, text
from surveyloom.operators import ranking, vectors
from surveyloom.plans.catalogue import register
from surveyloom.plans.panel import sql
from surveyloom.plans.scores import rounded
from surveyloom.sources.tables import responses, table


def _vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


_COS = "list_sum(list_transform(range(1, 65), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE)) / (greatest(sqrt(list_sum(list_transform({a}, lambda x: x::DOUBLE * x::DOUBLE))), 1e-12) * greatest(sqrt(list_sum(list_transform({b}, lambda x: x::DOUBLE * x::DOUBLE))), 1e-12))"


def _neighbours(s, d):
    v = _vectors(s, d)
    return vectors.neighbours(v.where("id % 100 = 0"), v, 5).select("id", "neighbour", "rank", F.round("similarity", 9).alias("similarity")).withColumn("rank", F.col("rank").cast("bigint"))


register(
    "knn_neighbours",
    _neighbours,
    f"SELECT id, neighbour, rank, round(s, 9) AS similarity FROM (SELECT a.vec_id AS id, b.vec_id AS neighbour, {_COS.format(a='a.embedding', b='b.embedding')} AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS.format(a='a.embedding', b='b.embedding')}, 12) DESC, b.vec_id) AS rank "
    "FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id) WHERE rank <= 5",
)
register(
    "label_centroids",
    lambda s, d: rounded(vectors.centroids(_vectors(s, d), ["label"]).select("label", *[F.get("centroid", F.lit(i)).alias(f"c{i}") for i in range(0, 64, 16)])),
    "SELECT label::BIGINT AS label, " + ", ".join(f"round(avg(embedding[{i + 1}]::DOUBLE), 9) AS c{i}" for i in range(0, 64, 16)) + " FROM embeddings GROUP BY 1",
)


def _nearest(s, d):
    v = _vectors(s, d)
    centers = [(r["label"], r["centroid"]) for r in vectors.centroids(v, ["label"]).orderBy("label").collect()]  # one row per label
    return vectors.nearest_centroid(v, centers).select("id", F.col("cluster").cast("bigint").alias("cluster"))


register(
    "nearest_centroid",
    _nearest,
    "WITH ce AS (SELECT label, [" + ", ".join(f"avg(embedding[{i}]::DOUBLE)" for i in range(1, 65)) + "] AS c FROM embeddings GROUP BY 1) "
    "SELECT vec_id AS id, arg_min(label, (dd, label))::BIGINT AS cluster FROM (SELECT vec_id, label, round(list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::DOUBLE - c[i]) ** 2)), 12) AS dd FROM (SELECT e.vec_id, e.embedding, ce.label, c FROM embeddings e, ce)) GROUP BY 1",
)


def _records(s, d):
    """Vectors as records of panels of fifty; the vectors whose id is divisible by 100 are the targets."""
    v = _vectors(s, d).select((F.col("id") / 50).cast("bigint").alias("panel_id"), F.col("id").alias("record_id"), "label", F.col("vector").cast("array<double>").alias("vector"))
    return v.where("record_id % 100 = 0").withColumnRenamed("record_id", "target_id"), v


_T100 = "t.vec_id % 100 = 0 AND h.vec_id <> t.vec_id AND h.vec_id // 50 = t.vec_id // 50"


def _weighted(s, d):
    targets, records = _records(s, d)
    history = targets.select(F.col("target_id").alias("row_id"), "panel_id").join(records.select("panel_id", "record_id", "vector"), "panel_id").where("record_id <> row_id").select("row_id", "vector")
    out = vectors.weighted_history(targets.select(F.col("target_id").alias("row_id"), "vector"), history)
    return rounded(out.select("row_id", *[F.get("z", F.lit(i)).alias(f"z{i}") for i in range(0, 64, 16)]), 8)


register(
    "weighted_history_vector",
    _weighted,
    f"WITH p AS (SELECT t.vec_id AS row_id, h.embedding AS a, {_COS.format(a='h.embedding', b='t.embedding')} / 0.5::DOUBLE AS s FROM embeddings t JOIN embeddings h ON {_T100}), "
    "e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY row_id)) AS e FROM p), z AS (SELECT row_id, " + ", ".join(f"sum(e * a[{i + 1}]) / sum(e) AS z{i}" for i in range(0, 64, 16)) + " FROM e GROUP BY 1) "
    "SELECT t.vec_id AS row_id, " + ", ".join(f"round(coalesce(z{i}, 0), 8) AS z{i}" for i in range(0, 64, 16)) + " FROM embeddings t LEFT JOIN z ON z.row_id = t.vec_id WHERE t.vec_id % 100 = 0",
)


def _evidence(s, d):
    targets, records = _records(s, d)
    t = targets.select("target_id", "panel_id", F.col("vector").alias("centroid"))
    kept = vectors.evidence_top_k(t, records.select("panel_id", F.col("record_id").alias("question_key"), "vector"), 4)
    kept = kept.where("question_key <> target_id").withColumn("rank", F.row_number().over(Window.partitionBy("target_id").orderBy("rank"))).where("rank <= 3")
    return rounded(kept.select("target_id", "question_key", "rank", "similarity"))


register(
    "query_evidence_topk",
    _evidence,
    f"SELECT target_id, question_key, rank, round(s, 9) AS similarity FROM (SELECT t.vec_id AS target_id, h.vec_id AS question_key, {_COS.format(a='h.embedding', b='t.embedding')} AS s, "
    f"row_number() OVER (PARTITION BY t.vec_id ORDER BY round({_COS.format(a='h.embedding', b='t.embedding')}, 12) DESC, h.vec_id) AS rank FROM embeddings t JOIN embeddings h ON {_T100}) WHERE rank <= 3",
)


def _assembled(s, d):
    """Own evidence: records of the target's panel and label by cosine; where it is sparse, records of that label of the panels of nearest centroid."""
    targets, records = _records(s, d)
    targets = targets.select("target_id", "panel_id", "label", F.col("vector").alias("t"))
    held = records.select(F.col("panel_id").alias("own"), "record_id", F.col("label").alias("l"), F.col("vector").alias("v"))
    scored = lambda both: both.withColumn("similarity", F.round(probs.cosine(F.col("v"), F.col("t")), 12)).drop("t", "v")
    mine = targets.join(held, (F.col("panel_id") == F.col("own")) & (F.col("label") == F.col("l")) & (F.col("record_id") != F.col("target_id")))
    own = ranking.top_n(scored(mine), ["target_id"], [F.desc("similarity"), F.col("record_id")], 4)
    full = own.groupBy("target_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 4)
    sparse = targets.join(full, "target_id", "left_anti")
    profiles = vectors.centroids(records, ["panel_id"]).select(F.col("panel_id").alias("id"), F.col("centroid").alias("vector"))
    asked = profiles.join(targets.select(F.col("panel_id").alias("id")).distinct(), "id", "left_semi")
    near = vectors.neighbours(asked, profiles, 3).select(F.col("id").alias("panel_id"), F.col("neighbour").alias("own"))
    backfill = scored(sparse.join(near, "panel_id").join(held.withColumnRenamed("l", "label"), ["own", "label"]))
    return vectors.assembled_evidence(own, backfill, 5, 4).select("target_id", "record_id", F.round("similarity", 9).alias("similarity"), "origin")


_DOT = "list_sum(list_transform(range(1, 65), lambda i: {a}[i] * {b}[i]))"
_CENTROID_COS = f"{_DOT.format(a='a.c', b='b.c')} / (greatest(sqrt({_DOT.format(a='a.c', b='a.c')}), 1e-12) * greatest(sqrt({_DOT.format(a='b.c', b='b.c')}), 1e-12))"
register(
    "assembled_evidence",
    _assembled,
    f"WITH ow AS (SELECT * FROM (SELECT t.vec_id AS target_id, h.vec_id AS record_id, round({_COS.format(a='h.embedding', b='t.embedding')}, 12) AS s, row_number() OVER (PARTITION BY t.vec_id ORDER BY round({_COS.format(a='h.embedding', b='t.embedding')}, 12) DESC, h.vec_id) AS r FROM embeddings t JOIN embeddings h ON {_T100} AND h.label = t.label) WHERE r <= 4), "
    "no AS (SELECT t.vec_id AS target_id, t.vec_id // 50 AS panel, label, embedding, count(record_id) AS n FROM embeddings t LEFT JOIN ow ON ow.target_id = t.vec_id WHERE t.vec_id % 100 = 0 GROUP BY ALL HAVING count(record_id) < 4), "
    "ce AS (SELECT vec_id // 50 AS panel, [" + ", ".join(f"avg(embedding[{i}]::DOUBLE)" for i in range(1, 65)) + "] AS c FROM embeddings GROUP BY 1), "
    f"nb AS (SELECT panel, other FROM (SELECT a.panel, b.panel AS other, row_number() OVER (PARTITION BY a.panel ORDER BY round({_CENTROID_COS}, 12) DESC, b.panel) AS r FROM ce a JOIN ce b ON a.panel <> b.panel WHERE a.panel IN (SELECT panel FROM no)) WHERE r <= 3), "
    f"bf AS (SELECT target_id, record_id, s, n, row_number() OVER (PARTITION BY target_id ORDER BY s DESC, record_id) AS r FROM (SELECT t.target_id, t.n, h.vec_id AS record_id, round({_COS.format(a='h.embedding', b='t.embedding')}, 12) AS s FROM no t JOIN nb USING (panel) JOIN embeddings h ON h.vec_id // 50 = other AND h.label = t.label)) "
    "SELECT target_id, record_id, round(s, 9) AS similarity, 'self' AS origin FROM ow UNION ALL SELECT target_id, record_id, round(s, 9), 'neighbour' FROM bf WHERE r <= 5 - n",
)
register(
    "clean_and_truncate",
    lambda s, d: table(s, d, "documents").select("doc_id", F.sha2(text.collapse_spaces(F.col("text")), 256).alias("clean"), text.truncate(F.col("text"), 60).alias("short")),
    "WITH c AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\v\\f\\r]+', ' ', 'g')) AS t FROM documents) SELECT doc_id, sha256(t) AS clean, CASE WHEN length(t) <= 60 THEN t ELSE rtrim(t[1:59]) || '…' END AS short FROM c",
)


def _bins(s, d):
    c = table(s, d, "customer")
    age = F.concat(F.lit("about "), (F.col("c_custkey") % 120).cast("string"), F.lit(" years"))
    scale = F.when(F.col("c_custkey") % 13 == 0, F.lit("refused")).otherwise((F.col("c_custkey") % 12).cast("string"))
    return c.select("c_custkey", text.age_bin(age).alias("age_bin"), text.income_quintile(text.clean_value(scale)).alias("income"), text.clean_value(F.concat(F.lit("  a "), scale)).alias("cleaned"), text.age_decade(F.lit(1900) + F.col("c_custkey") % 150).cast("bigint").alias("decade"))


register(
    "age_income_bins",
    _bins,
    "SELECT c_custkey, CASE WHEN a < 14 OR a > 110 THEN 'Missing' WHEN a < 30 THEN '18-29' WHEN a < 45 THEN '30-44' WHEN a < 65 THEN '45-64' ELSE '65+' END AS age_bin, "
    "CASE WHEN NOT r AND s BETWEEN 1 AND 10 THEN 'Q' || ceil((11 - s) / 2.0)::INT ELSE 'Missing' END AS income, CASE WHEN r THEN 'Missing' ELSE 'a ' || s END AS cleaned, greatest(least(floor((2020 - (1900 + c_custkey % 150)) / 10.0), 12), 0)::BIGINT AS decade "
    "FROM (SELECT c_custkey, c_custkey % 120 AS a, c_custkey % 12 AS s, c_custkey % 13 = 0 AS r FROM customer)",
)
register(
    "json_props",
    lambda s, d: table(s, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k")),
    "SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events",
)
register(
    "last_by_key",
    lambda s, d: ranking.keep_last(table(s, d, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id"),
    "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
)


def _prompts(s, d):
    c = table(s, d, "conversations")
    line = F.concat(F.lit("["), (F.col("turn") + 1).cast("string"), F.lit("] "), F.col("role"), F.lit(": "), text.truncate(F.col("text"), 40))
    turns = c.select("conv_id", F.struct("turn", line.alias("l")).alias("x")).groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return turns.select("conv_id", F.concat_ws("\n", F.lit("History:"), F.array_join(F.transform(F.slice("x", 1, 5), lambda t: t["l"]), "\n"), F.lit("Answer:")).alias("prompt"))


register(
    "prompt_render",
    _prompts,
    "WITH c AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '[ \\t\\n\\v\\f\\r]+', ' ', 'g')) AS t FROM conversations), l AS (SELECT conv_id, turn, '[' || (turn + 1) || '] ' || role || ': ' || CASE WHEN length(t) <= 40 THEN t ELSE rtrim(t[1:39]) || '…' END AS l FROM c) "
    "SELECT conv_id, 'History:' || chr(10) || array_to_string(list(l ORDER BY turn, l)[1:5], chr(10)) || chr(10) || 'Answer:' AS prompt FROM l GROUP BY 1",
)


def _profiles(s, d):
    rows = responses(s, d).where("split = 'test'")
    hot = rows.groupBy("panel_id").pivot("question_id", [f"q{i:02d}" for i in range(1, 13)]).agg(F.first("answer_index"))
    return hot.select("panel_id", *[F.coalesce(F.col(f"q{i:02d}"), F.lit(-1)).cast("bigint").alias(f"q{i:02d}") for i in range(1, 13)])


register(
    "respondent_profile",
    _profiles,
    sql("SELECT panel_id, " + ", ".join(f"coalesce(max(answer_index) FILTER (WHERE question_id = 'q{i:02d}'), -1)::BIGINT AS q{i:02d}" for i in range(1, 13)) + " FROM responses WHERE split = 'test' GROUP BY 1"),
)


def _unpermuted(s, d):
    from surveyloom.functions import hashing

    rows = responses(s, d).where("split = 'test'").select("row_id", "answer_index")
    order = hashing.hash_order(7, F.col("row_id"), F.lit(5))
    shown = F.transform(order, lambda o: (o == F.col("answer_index")).cast("double"))
    back = probs.unpermute(shown, order)
    return rows.select("row_id", F.array_join(F.transform(order, lambda o: o.cast("string")), "").alias("order"), (F.array_position(back, 1.0) - 1).cast("bigint").alias("answer"))


register(
    "option_permutation",
    _unpermuted,
    sql("SELECT row_id, (SELECT string_agg(i::VARCHAR, '' ORDER BY sha256('7|' || row_id || '|' || i)) FROM (SELECT unnest(range(5)) AS i)) AS order, answer_index::BIGINT AS answer FROM responses WHERE split = 'test'".replace("AS order", 'AS "order"')),
)

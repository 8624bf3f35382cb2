"""Readers, writers and the vector cache."""

import json

import pytest
from pyspark.sql import functions as F

from surveyloom.sources import io
from surveyloom.streaming.resume import incremental


def test_nested_files(spark, tmp_path):
    questions = [{"question_id": "V0", "question": "How often?", "answer": {"10": "Never", "2": "Always"}}, {"question_id": "V1", "question": "Colour", "answer": {"1": "red"}}]
    people = [{"person_id": 1, "attributes": {"Sex": "F", "Age of respondent": "37"}, "questions_answer": {"v0": "10", "v1": "1", "v9": "1"}}, {"person_id": 2, "attributes": {}, "questions_answer": {"v0": "7"}}]
    (tmp_path / "mydomain_questions.json").write_text(json.dumps(questions))
    (tmp_path / "mydomain_respondents.json").write_text(json.dumps(people))
    rows, dropped = io.flatten(*io.read_domain(spark, f"file://{tmp_path}", "My Domain"), "My Domain")
    got = rows.collect()
    assert [(r.row_id, r.answer_index, r.answer_text, r.age_bin, r.n_options) for r in got] == [("My Domain::1::v0", 1, "Never", "30-44", 2)]
    assert {r.reason: r.n for r in dropped.collect()} == {"unknown question": 1, "invalid answer": 1, "not ordinal": 1}


def test_predictions_keep_last(spark, tmp_path):
    df = lambda *rows: spark.createDataFrame(list(rows), "k int, x int").coalesce(1)
    for name, d in (("a", df((1, 1), (2, 2))), ("b", df((1, 3),)), ("perm_c", df((1, 9),))):
        d.toPandas().to_parquet(tmp_path / f"{name}.parquet")
    assert sorted(map(tuple, io.read_predictions(spark, f"file://{tmp_path}", ["k"]).collect())) == [(1, 3), (2, 2)]


def test_csv_and_jsonl(spark, tmp_path):
    (tmp_path / "w.csv").write_text("caseid,starttime_post,CC20_1,other\n1,x,2,3\n2,,4,5\n")
    df = io.read_csv(spark, f"file://{tmp_path}/w.csv", pattern="^(caseid|starttime|CC20_)").where(F.col("starttime_post").isNotNull())
    assert df.columns == ["caseid", "starttime_post", "CC20_1"] and df.count() == 1
    (tmp_path / "r.jsonl").write_text('{"k": "a", "v": 1, "valid": true}\n\n{"k": "a", "v": 2, "valid": true}\n{"k": "b", "v": 3, "valid": false}\n')
    rows = io.read_jsonl(spark, f"file://{tmp_path}/r.jsonl", "k", "k string, v int, valid boolean", "valid").collect()
    assert [(r.k, r.v) for r in rows] == [("a", 2)]


def test_cache(spark, tmp_path):
    cache = io.VectorCache(spark, f"file://{tmp_path}/c", {"k": 5})
    rows = spark.createDataFrame([("r1", "p", 5, [1.0], [0.5]), ("r2", "p", 5, [2.0], None)], io.VectorCache.schema)
    cache.append(rows)
    assert cache.validate() == {"rows": 2, "vectors": 2, "logits": 1} and cache.missing(rows).count() == 0
    with pytest.raises(ValueError):
        cache.append(rows.limit(1))
    with pytest.raises(ValueError):
        io.VectorCache(spark, f"file://{tmp_path}/c", {"k": 3})
    assert io.VectorCache(spark, f"file://{tmp_path}/c", {"k": 5}).read().count() == 2


def test_incremental_stream(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/in/a")
    run = lambda: incremental(spark, f"{tmp_path}/in/*", "id bigint", lambda d: d.withColumn("x", F.col("id") * 2), f"{tmp_path}/out", f"{tmp_path}/mark").awaitTermination()
    run()
    spark.range(3, 5).write.parquet(f"{tmp_path}/in/b")
    run()
    assert sorted(r.x for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 2, 4, 6, 8]

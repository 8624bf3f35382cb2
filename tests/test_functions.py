"""Hand cases of scalar and array functions."""

import hashlib
import json
import math

from pyspark.sql import functions as F

from surveyloom.functions import hashing, probs, text


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def arr(*x):
    return F.array(*[F.lit(float(v)) for v in x])


def test_rps_cases(spark):
    a, b, near, far = one(spark, probs.rps(arr(0, 1, 0), F.lit(1)), probs.rps(arr(0.5, 0.5, 0), F.lit(2)), probs.rps(arr(0, 1, 0), F.lit(0)), probs.rps(arr(0, 0, 1), F.lit(0)))
    assert a == 0 and abs(b - 0.625) < 1e-12 and near < far


def test_scores_and_argmax(spark):
    r = one(spark, probs.nll(arr(0.8, 0.2), F.lit(0)), probs.brier(arr(0.8, 0.2), F.lit(0)), probs.argmax(arr(0.4, 0.4, 0.2)), probs.expected_score(arr(0, 0, 1)), probs.nll(arr(1, 0), F.lit(1)))
    assert abs(r[0] + math.log(0.8)) < 1e-12 and abs(r[1] - 0.08) < 1e-12 and r[2] == 0 and r[3] == 1 and abs(r[4] + math.log(1e-12)) < 1e-9


def test_distances(spark):
    r = one(spark, probs.jensen_shannon(arr(1, 0), arr(0, 1)), probs.wasserstein(arr(1, 0, 0), arr(0, 0, 1)), probs.cosine(arr(1, 0), arr(1, 0)), probs.squared_distance(arr(0, 3), arr(4, 0)))
    assert abs(r[0] - 1) < 1e-9 and r[1] == 1 and abs(r[2] - 1) < 1e-12 and r[3] == 25


def test_pool_and_temperature(spark):
    r = one(spark, probs.log_pool(arr(0.9, 0.1), arr(0.5, 0.5), F.lit(0.0)), probs.temper(arr(0.9, 0.1), F.lit(1.0)), probs.smooth(arr(4, 3, 1, 0, 0), 0.5))
    assert all(abs(x - y) < 1e-9 for x, y in zip(r[0], [0.9, 0.1], strict=True))
    assert all(abs(x - y) < 1e-9 for x, y in zip(r[1], [0.9, 0.1], strict=True))
    assert all(abs(x - y) < 1e-9 for x, y in zip(r[2], [v / 10.5 for v in (4.5, 3.5, 1.5, 0.5, 0.5)], strict=True))


def test_hashes_match_python(spark):
    rows = spark.range(30).select("id", hashing.little_endian_bucket(F.col("id"), 1701).alias("l"), hashing.big_endian_bucket(F.col("id"), 1701).alias("b"), hashing.stable_hex(1701, "tag", F.concat(F.lit('q"\\'), F.col("id").cast("string"))).alias("h")).collect()
    for r in rows:
        d = hashlib.sha256(f"1701|{r.id}".encode()).digest()
        assert r.l == int.from_bytes(d[:8], "little") % 10 and r.b == int.from_bytes(d[:8], "big") % 10
        assert r.h == hashlib.sha256(json.dumps([1701, "tag", f'q"\\{r.id}']).encode()).hexdigest()[:16]


def test_permutation_round_trip(spark):
    order = hashing.hash_order(1, F.lit("row"), F.lit(5))
    p = arr(0.1, 0.2, 0.3, 0.25, 0.15)
    r = one(spark, order, probs.unpermute(F.transform(order, lambda o: F.get(p, o)), order))
    assert sorted(r[0]) == [0, 1, 2, 3, 4] and r[1] == [0.1, 0.2, 0.3, 0.25, 0.15]


def test_text(spark):
    r = one(
        spark, text.clean_value(F.lit("  a \n b ")), text.clean_value(F.lit("Refused to say")), text.clean_value(F.lit(None)), text.age_bin(F.lit("37")), text.age_bin(F.lit("x")), text.income_quintile(F.lit("2")),
        text.income_quintile(F.lit("11")), text.slug(F.lit("Role of Government")), text.truncate(F.lit("abc  def"), 5), text.strip_seed(F.lit("m_seed12")), text.family(F.lit("CC20_331a")), text.is_ordinal(F.lit("How OFTEN?"), F.array(F.lit("x"))),
        text.option_order(F.array(F.lit("10"), F.lit("2"), F.lit("a"), F.lit("1.5"))),
    )
    assert list(r)[:12] == ["a b", "Missing", "Missing", "30-44", "Missing", "Q5", "Missing", "roleofgovernment", "abc…", "m", "CC20_331", True]
    assert r[12] == ["1.5", "2", "10", "a"]


def test_attributes(spark):
    m = F.create_map(*[F.lit(x) for kv in {"Sex of respondent": "No answer", "sex": "Female", "Age of respondent": "37", "Weighting factor": "1,5"}.items() for x in kv])
    got = text.canonical_attributes(m)
    r = one(spark, got["sex"], got["age_bin"], got["country"], text.survey_weight(m))
    assert list(r) == ["Female", "30-44", "Missing", 1.5]

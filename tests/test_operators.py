"""Hand cases and invariants of ranking, joins, protocols and inference."""

import pytest
from pyspark.sql import functions as F

from surveyloom.operators import baselines, inference, joins, metrics, protocols, ranking, vectors
from surveyloom.sources import io


def test_holm(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.20])], "i int, p_value double")
    assert [r.reject_null for r in ranking.holm(df).orderBy("i").collect()] == [True, False, False, False]


def test_average_ranks(spark):
    df = spark.createDataFrame([("g", 1), ("g", 2), ("g", 2), ("g", 3)], "g string, x int")
    assert sorted(r[0] for r in df.select(ranking.average_rank("x", ["g"])).collect()) == [1.0, 2.5, 2.5, 4.0]


def test_greedy_cover(spark):
    rows = [("a", "x", 1.0), ("a", "y", 0.0), ("b", "x", 0.0), ("b", "y", 1.0), ("c", "x", 0.6), ("c", "y", 0.3)]
    assert {i for i, _ in ranking.greedy_cover(spark.createDataFrame(rows, "item string, target string, score double"), 2)} == {"a", "b"}


def _rows(spark):
    rows = io.synthetic_panels(spark, 40, 10)
    return ranking.item_holdout(rows.withColumn("row_id", F.concat_ws("::", "panel_id", "question_id")).withColumn("country", F.lit("A")), 0.2, 1)


def test_protocols_hold_no_target(spark):
    rows = _rows(spark).cache()
    folds = ranking.round_robin(rows, 3, 1, 0.3, 4)
    for units in (protocols.protocol_a(rows, "test"), protocols.protocol_b(rows, folds, "test", 0, 3)):
        assert units.count() > 0 and protocols.unit_faults(units).count() == 0
    assert all(r.n == 0 for r in protocols.leakage(rows, ranking.calibration_orders(rows, [1])).collect())
    with pytest.raises(ValueError):
        protocols.protocol_d(rows, "test")


def test_holdout_bounds(spark):
    n = _rows(spark).groupBy("domain").agg(F.countDistinct(F.when(F.col("is_unseen_item"), F.col("question_key"))).alias("n")).collect()
    assert [r.n for r in n] == [2, 2]


def test_prior_unseen_and_backoff(spark):
    rows = spark.createDataFrame([("q", "A", 0, 3)] * 30 + [("q", "B", 2, 3)] * 2, "question_key string, country string, answer_index int, n_options int")
    prior = baselines.population_prior(rows)
    ask = spark.createDataFrame([("q", "B", 3), ("q", "C", 3), ("new", "A", 3), ("new", "A", 4)], "question_key string, country string, n_options int")
    got = {(r.question_key, r.country, r.n_options): r.prior for r in baselines.prior_predict(ask, prior, F.col("question_key") == "q").collect()}
    assert got[("q", "B", 3)][0] > 0.5 and got[("q", "C", 3)][0] > 0.9 and got[("new", "A", 4)] == [0.25] * 4
    assert got[("new", "A", 3)] == pytest.approx([30.5 / 33.5, 0.5 / 33.5, 2.5 / 33.5])


def test_no_history_keeps_prior(spark):
    targets = spark.createDataFrame([("r", "d", "q", [0.2, 0.8])], "row_id string, domain string, question_key string, prior array<double>")
    history = spark.createDataFrame([], "row_id string, h string, h_value int")
    tables = spark.createDataFrame([], "t string, h string, h_value int, n bigint, conditional array<double>")
    graph = spark.createDataFrame([], "domain string, a string, b string, n bigint, c double")
    assert baselines.conditional_predict(targets, history, tables, graph).first().p == pytest.approx([0.2, 0.8])


def test_alignment(spark):
    a = spark.createDataFrame([("r1", "p", "q", 0, 2, 1.0)], "row_id string, panel_id string, question_key string, answer_index int, n_options int, x double")
    assert joins.strict_align(a, a).first().x_right == 1.0
    with pytest.raises(ValueError):
        joins.strict_align(a, a.withColumn("answer_index", F.lit(1)))
    with pytest.raises(Exception, match="repeated key"):
        joins.require_unique(a.unionAll(a), ["row_id"]).collect()


def test_matched_pairs(spark):
    rows = [(f"p{i}", "d", *v) for i, v in enumerate([("a", "x"), ("a", "x"), ("a", "y"), ("b", "y"), ("c", "z")])]
    df = spark.createDataFrame(rows, "panel_id string, domain string, u string, v string")
    got = {(r.panel_id_a, r.panel_id_b): r.distance for r in joins.matched_pairs(df, ["u", "v"]).collect()}
    assert got == {("p0", "p1"): 0, ("p0", "p2"): 1, ("p1", "p2"): 1, ("p2", "p3"): 1}
    with pytest.raises(ValueError):
        joins.matched_pairs(df, ["u", "v"], 2)


def test_stratum_shuffle_keeps_multiset(spark):
    df = spark.range(50).select("id", (F.col("id") % 3).alias("s"), (F.col("id") * 7).alias("x"))
    out = joins.stratum_shuffle(df, ["s"], "id", ["x"], 1)
    assert out.groupBy("s").agg(F.sum("x") - F.sum("shuffled_x")).collect() and all(r[1] == 0 for r in out.groupBy("s").agg(F.sum("x") - F.sum("shuffled_x")).collect())


def _methods(spark, gain):
    rows = [(m, "d", f"p{p}", f"q{q}", 1.0 + 0.05 * ((p * 7 + q * 3) % 5) - (gain if m == "a" else 0)) for m in "ab" for p in range(30) for q in range(8)]
    return spark.createDataFrame(rows, "method string, domain string, panel_id string, question_key string, nll double")


def test_bootstraps(spark):
    rows = _methods(spark, 0.10)
    crossed = inference.crossed_bootstrap(rows, "a", "b", "nll", 100).first()
    joined = inference.crossed_bootstrap(rows, "a", "b", "nll", 100, most_items=0).first()
    assert all(abs(x - y) < 1e-9 if isinstance(x, float) else x == y for x, y in zip(crossed, joined))
    assert crossed.difference == pytest.approx(-0.10) and crossed.ci_high < 0 and crossed.favors_candidate
    paired = inference.paired_bootstrap(rows, "a", "b", "nll", 100).first()
    assert paired.difference == pytest.approx(-0.10) and paired.n_units == 30
    assert not inference.primary_family(_methods(spark, 0.005), "a", ["b"], replicates=50).first().practical_effect
    with pytest.raises(ValueError):
        inference.paired_bootstrap(rows, "a", "none", "nll", 10)
    exact = inference.exact_bootstrap(joins.paired(rows, "a", "b", "nll", ["domain", "panel_id"]), "difference", "panel_id", ["domain"], [], 50).first()
    assert exact.difference == pytest.approx(-0.10)


def test_weighted_history(spark):
    t = spark.createDataFrame([("r", [1.0, 0.0]), ("none", [1.0, 1.0])], "row_id string, vector array<double>")
    h = spark.createDataFrame([("r", [1.0, 1.0]), ("r", [1.0, -1.0])], "row_id string, vector array<double>")
    got = {r.row_id: r.z for r in vectors.weighted_history(t, h).collect()}
    assert got["r"] == pytest.approx([1.0, 0.0]) and got["none"] == [0.0, 0.0]


def test_permutation_consistency(spark):
    df = spark.createDataFrame([("m", "r1", 0, 1), ("m", "r1", 1, 1), ("m", "r2", 0, 1), ("m", "r2", 1, 2), ("m", "r3", 0, 0)], "method string, row_id string, option_seed int, predicted_index int")
    r = metrics.permutation_consistency(df, ["method"]).first()
    assert r.consistency == 0.5 and r.n_rows == 2


def test_frequency_ties_go_to_the_first(spark):
    # 0.1 + 0.2 + 0.3 and 0.3 + 0.2 + 0.1 differ in doubles: the order of rows must not choose among equal weights
    weights = [(1, 0.3), (1, 0.2), (1, 0.1), (3, 0.1), (3, 0.2), (3, 0.3), (0, 0.2), (0, 0.3), (0, 0.1)]
    rows = [("q", "A", "F", "x", option, 4, w) for option, w in weights] * 40
    train = spark.createDataFrame(rows, "question_key string, country string, sex string, age_bin string, answer_index int, n_options int, survey_weight double").coalesce(1)
    asked = spark.createDataFrame([("q", "B", "F", "x", 4), ("q", "A", "F", "x", 4)], "question_key string, country string, sex string, age_bin string, n_options int")
    for row in baselines.frequency_predict(asked, baselines.frequency_tables(train)).collect():
        assert row.p[0] == row.p[1] == row.p[3] > row.p[2]


def test_expected_score_at_an_exact_half(spark):
    from surveyloom.plans.scores import expected

    below = 0.493554687499999944  # the double below an exact half of the ninth digit
    got = spark.createDataFrame([([1 - below, below],)], "p array<double>").select(F.round(expected("p"), 9)).first()[0]
    assert got == 0.493554688

"""Units, calibration, item catalogues, readers and files: hand cases."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyloom.operators import calibration, costs, joins, latent, materialise, questionnaires, readers
from surveyloom.sources import io


def test_bounded_minimum(spark):
    rows = spark.range(3)
    assert calibration.bounded_minimum(lambda x: F.pow(x - 1.3, F.lit(2.0)), rows, -3.0, 5.0) == pytest.approx(1.3, abs=1e-3)


def test_temperature_sharpens(spark):
    rows = spark.createDataFrame([([0.6, 0.4], 0)] * 9 + [([0.6, 0.4], 1)], "p array<double>, answer_index int")
    t = calibration.fit_temperature(rows)
    assert t < 1 and 0.6 ** (1 / t) / (0.6 ** (1 / t) + 0.4 ** (1 / t)) == pytest.approx(0.9, abs=5e-3)


def test_clusters_and_whole_cluster_choice():
    points = np.array([[1, 0], [0.99, 0.01], [0, 1], [0.02, 1], [-1, 0.1]], float)
    assert materialise.linked_clusters(points, 3) == [[0, 1], [2, 3], [4]]
    assert materialise.whole_clusters([4, 3, 2, 2], 5, 3) == (1, 2)
    assert materialise.whole_clusters([4, 4], 3, 3) == (0,)
    r = random.Random(1)
    for _ in range(60):
        sizes, wanted, folds = [r.randint(1, 6) for _ in range(r.randint(2, 7))], r.randint(1, 15), r.randint(1, 2)
        every = [c for n in range(1, len(sizes) + 1) for c in itertools.combinations(range(len(sizes)), n) if sum(sizes) - sum(sizes[i] for i in c) >= folds]
        if every:
            size = lambda c: sum(sizes[i] for i in c)
            assert materialise.whole_clusters(sizes, wanted, folds) == min(every, key=lambda c: (abs(size(c) - wanted), size(c) > wanted, len(c), c))


def test_prompt_and_history(spark):
    rows = spark.createDataFrame([("r1", "p", "q1", "One?", ["a", "b"], 1, "Sex: f"), ("r2", "p", "q2", "Two?", ["a", "b"], 0, "Sex: f")], "row_id string, panel_id string, question_key string, question string, options array<string>, answer_index int, demographic_text string")
    units = spark.createDataFrame([("p", "q1", ["q2"])], "panel_id string, question_key string, eligible_source_keys array<string>")
    r = materialise.prompts(units, rows, 3).first()
    assert "1. Two? -> a" in r.prompt and r.prompt.endswith("Options:\nA. a\nB. b\n\nAnswer:") and r.correct_label == 1
    assert materialise.NO_HISTORY in materialise.prompts(units, rows, 0).first().prompt
    with pytest.raises(Exception, match="unit without a response"):
        materialise.prompts(spark.createDataFrame([("p", "q9", [])], units.schema), rows, 1).collect()


def test_option_labels_and_first_json():
    assert questionnaires._first_object('x {bad {"a": {"b": 1}} {"c": 2}') == '{"a":{"b":1}}'
    assert questionnaires._first_object("none {") is None and questionnaires._first_object(None) is None


def test_reply_shares(spark):
    good = '{"choices":[{"logprobs":{"content":[{"top_logprobs":[{"token":" A","logprob":-1.0},{"token":"B","logprob":-1.0}]}]}}]}'
    df = spark.createDataFrame([(good,), ("{}",), ("no json",), (None,)], "x string").select(readers.label_shares(F.col("x"), ["A", "B"]).alias("p"))
    got = [r.p for r in df.collect()]
    assert got[0] == pytest.approx([0.5, 0.5]) and got[1:] == [None, None, None]


def test_encoder_width(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "t string")
    got = readers.encoded(df, "t", 3).collect()
    assert len(got) == 3 and sorted(r.vector is None for r in got) == [False, False, True]
    with pytest.raises(Exception, match="the encoder gave"):
        readers.encoded(df, "t", 3, lambda texts, width: np.zeros((len(texts), 2))).collect()


def test_trait_update(spark):
    loadings = spark.createDataFrame([("q", [0.0, 1.0])], "question_key string, loading array<double>")
    starts = spark.createDataFrame([("a", [0.0]), ("b", [0.5])], "panel_id string, theta array<double>")
    got = {r.panel_id: r.theta[0] for r in latent.trait_update(spark.createDataFrame([("a", "q", 1.0)], "panel_id string, question_key string, y double"), starts, loadings, 1).collect()}
    assert got == pytest.approx({"a": 0.5, "b": 0.5})


def test_donor_ring(spark):
    rows = spark.createDataFrame([("a", "q", 0, "x"), ("b", "q", 1, "x"), ("c", "q", 2, "y"), ("d", "z", 3, "y")], "panel_id string, question_key string, answer_index int, cell string")
    got = {r.panel_id: (r.donor, r.answer_index) for r in joins.donor_shuffle(rows, rows, ["cell"]).collect()}
    assert got["a"] == ("b", 1) and got["b"] == ("a", 0) and got["c"][0] in "ab" and got["d"] == ("d", 3)


def test_uncapped_pairs(spark):
    panels = spark.createDataFrame([("d", f"p{i}", "a") for i in range(6)], "domain string, panel_id string, sex string")
    assert joins.matched_pairs(panels, ["sex"], 0, cap=3).count() == 3 and joins.matched_pairs(panels, ["sex"], 0, cap=None).count() == 15


def test_time_budget_and_cost():
    now = [0.0]
    budget = costs.TimeBudget(10, lambda: now[0])
    assert not budget.spent() and budget.left() == 10
    now[0] = 11
    assert budget.spent() and budget.left() == 0
    out, record = costs.timed("m", 5, 3, 7, lambda: "done", lambda: now[0])
    assert out == "done" and record["n_forward_passes"] == 7


def test_manifest_and_config(spark, tmp_path):
    path = f"file://{tmp_path}/m.json"
    io.save_manifest(spark, path, {"b": 1, "a": [1, 2]})
    assert io.load_manifest(spark, path) == {"b": 1, "a": [1, 2]}
    held = (tmp_path / "m.json").read_text()
    (tmp_path / "m.json").write_text(held.replace('"b": 1', '"b": 2'))
    (tmp_path / ".m.json.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="was changed"):
        io.load_manifest(spark, path)
    io.write_json(f"{tmp_path}/c.json", {"paths": {"out": "runs", "far": "s3a://x/y"}})
    got = io.load_config(f"{tmp_path}/c.json")
    assert got["paths"] == {"out": f"{tmp_path}/runs", "far": "s3a://x/y"} and (tmp_path / "runs").is_dir()


def test_pretest_needs_enough(spark):
    wide = spark.createDataFrame([(1, 0, 1), (2, None, 1), (3, 1, None)], "id int, t int, s int")
    assert [r.id for r in questionnaires.pretest_respondents(wide, "id", ["t"], ["s"], 1, 1).collect()] == [1]
    with pytest.raises(ValueError):
        questionnaires.pretest_respondents(wide, "id", ["t"], ["s"], 1, 2)


def test_rank_correlation_of_counts(spark):
    from surveyloom.operators.baselines import rank_correlation

    cells = spark.createDataFrame([("k", 0, 0, 2), ("k", 1, 1, 1), ("k", 2, 1, 1), ("c", 0, 0, 3)], "g string, x int, y int, n int")
    got = {r.g: r.rho for r in rank_correlation(cells, ["g"], "x", "y").collect()}
    x, y = [1.5, 1.5, 3, 4], [1.5, 1.5, 3.5, 3.5]
    assert got["k"] == pytest.approx(float(np.corrcoef(x, y)[0, 1])) and got["c"] is None and not math.isnan(got["k"])

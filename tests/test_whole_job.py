"""Queries do the whole job: caps, grids, replicates and candidates as the survey protocol has them."""

import duckdb
import numpy as np
import pytest

from surveyloom.plans import catalogue

SF = "/root/testdata/sf0.01"


def oracle(sql, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.execute(sql)
    return [c[0] for c in found.description], found.fetchall()


@pytest.mark.parametrize("name", ["matched_pairs", "pair_divergence"])
def test_buckets_up_to_200_are_whole(spark, name):
    """Query and SQL have the protocol's cap, which no bucket of these tables reaches; four exceed 20."""
    text = catalogue.ORACLES[name]
    assert text.count("rn <= 200)") == 1
    names, want = oracle(text.replace("rn <= 200)", "true)"), ["customer", "nation", "orders"])
    keys = ["domain", "panel_id_a", "panel_id_b"]
    got = catalogue.QUERIES[name](spark, SF).select(*keys).collect()
    assert sorted(map(tuple, got)) == sorted(tuple(r[names.index(k)] for k in keys) for r in want)


def test_evidence_comes_from_all_records_of_the_panels(spark, tmp_path):
    """Targets are the ids divisible by 100, against all other records: the panel's own of their label, then those of its neighbours."""
    rng = np.random.default_rng(1)
    vector, label = rng.normal(size=(600, 64)), [int(x) for x in rng.integers(0, 14, 600)]
    rows = [(i, vector[i].tolist(), label[i]) for i in range(600)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    profile = {k: vector[50 * k : 50 * k + 50].mean(axis=0) for k in range(12)}
    want, top = set(), set()
    for t in range(0, 600, 100):
        order = lambda ids: sorted(ids, key=lambda i: (-cos(vector[t], vector[i]), i))  # noqa: B023, E731
        mine = [i for i in range(t, t + 50) if i != t]
        top |= {(t, i) for i in order(mine)[:3]}
        own = order([i for i in mine if label[i] == label[t]])[:4]
        near = sorted(set(profile) - {t // 50}, key=lambda k: -cos(profile[t // 50], profile[k]))[:3]
        more = order([i for i in range(600) if i // 50 in near and label[i] == label[t]])[: 5 - len(own)] if len(own) < 4 else []
        want |= {(t, i, "self") for i in own} | {(t, i, "neighbour") for i in more}
    assert {x[2] for x in want} == {"self", "neighbour"}
    got = catalogue.QUERIES["assembled_evidence"](spark, str(tmp_path)).collect()
    assert {(r.target_id, r.record_id, r.origin) for r in got} == want
    assert {(r.target_id, r.question_key) for r in catalogue.QUERIES["query_evidence_topk"](spark, str(tmp_path)).collect()} == top


def test_searches_use_the_whole_grid(spark):
    """Query and SQL have the protocol's grids."""
    text = catalogue.ORACLES["temperature_grid"]
    grid = [float(x) for x in text.split("unnest([")[1].split("]")[0].split(",")]
    assert grid == pytest.approx(np.geomspace(0.25, 4.0, 25).tolist())
    names, want = oracle(text, ["customer", "nation", "orders"])
    got = {r.domain: (r.temperature, r.nll) for r in catalogue.QUERIES["temperature_grid"](spark, SF).collect()}
    assert got == {r[names.index("domain")]: (pytest.approx(r[names.index("temperature")]), pytest.approx(r[names.index("nll")])) for r in want}
    text = catalogue.ORACLES["lambda_grid"]
    assert text.count("unnest(range(101)) / 100.0") == 1
    names, want = oracle(text, ["customer", "nation", "orders"])
    got = catalogue.QUERIES["lambda_grid"](spark, SF).first()
    assert (got.share, got.nll) == (pytest.approx(want[0][names.index("share")]), pytest.approx(want[0][names.index("nll")]))


def test_cover_has_the_items_of_every_domain(spark):
    rows = catalogue.QUERIES["greedy_cover"](spark, SF).collect()
    assert len({r["item"].split("::")[0] for r in rows}) == 5 and len(rows) == 20


def test_bootstraps_draw_2000_times(spark, monkeypatch):
    from surveyloom.operators import inference

    seen = []
    for name, at in (("bootstrap", 5), ("crossed_bootstrap", 4)):
        real = getattr(inference, name)
        monkeypatch.setattr(inference, name, lambda *a, real=real, at=at, **k: seen.append(a[at] if len(a) > at else k.get("replicates", 2000)) or real(*a, **k))
    for name in ("bootstrap_ci", "crossed_bootstrap", "primary_family"):
        catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert seen == [2000] * 4


def test_optima_between_the_coarse_points_are_found(spark, monkeypatch):
    from surveyloom.plans import scores

    rows = [("d", "seen", [0.9, 0.025, 0.025, 0.025, 0.025], 0 if i < 7 else 1 + i % 4) for i in range(10)]
    monkeypatch.setattr(scores, "predictions", lambda s, d: s.createDataFrame(rows, "domain string, item_pool string, p array<double>, answer_index int"))
    loss = lambda q: -0.7 * np.log(q[0] / q.sum()) - 0.3 * np.log(q[1] / q.sum())
    p = np.array(rows[0][2])
    best = min(np.geomspace(0.25, 4.0, 25), key=lambda t: loss(p ** (1 / t)))
    assert catalogue.QUERIES["temperature_grid"](spark, "").first().temperature == pytest.approx(best)
    best = min(np.linspace(0.0, 1.0, 101), key=lambda x: loss(p ** (1 - x) * 0.2**x))
    assert catalogue.QUERIES["lambda_grid"](spark, "").first().share == pytest.approx(best)

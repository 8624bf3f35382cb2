"""The ceiling has the protocol's whole grid of dimensions, both histories' scores, and intervals."""

import numpy as np
import pytest

from surveyloom.operators import inference, subspace, trees
from surveyloom.plans import catalogue


def test_drawn_means_equal_plain_sums(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(450, 3))
    rows = spark.createDataFrame([(f"d::{i}", v.tolist()) for i, v in enumerate(x)], "u string, x array<double>").repartition(3)
    n, mean, draws = inference.drawn_means(rows, "u", "x", 3, 60, 7)
    w = inference._draws_of(7, 60, [f"d::{i}" for i in range(450)]).astype(float)
    assert n == 450 and np.allclose(mean, x.mean(axis=0)) and np.allclose(draws, (x.T @ w) / w.sum(axis=0))
    n, _, draws = inference.drawn_means(rows.limit(0), "u", "x", 3, 60, 7)
    assert n == 0 and draws.shape == (3, 60) and np.isnan(draws).all()


def test_the_ceiling_has_every_dimension_and_interval(spark, monkeypatch):
    used, fitted, told = [], [], {}
    grow, fit, means = trees.grow_forest, subspace.fit_svd, inference.drawn_means

    def small(rows, columns, outputs, classes):
        used.append([c for c in columns if c[0] == "f"])
        return grow(rows, columns, outputs, classes, trees.ForestRule(trees=2, depth=2))

    def drawn(rows, *a):
        found = rows.collect()
        told["x"] = np.array([r.x for r in found])
        told["w"] = inference._draws_of(1701, 5000, [r.panel_id for r in found]).astype(float)
        return means(spark.createDataFrame(found, rows.schema), *a)

    monkeypatch.setattr(trees, "grow_forest", small)
    monkeypatch.setattr(inference, "drawn_means", drawn)
    monkeypatch.setattr(subspace, "fit_svd", lambda *a: fitted.append(fit(*a)) or fitted[-1])
    got = {r.dimension: r for r in catalogue.QUERIES["latent_dimension_ceiling"](spark, "/root/testdata/sf0.01").collect()}
    assert list(got) == [0, 1, 2, 4, 8, 16, 24] == [len(u) for u in used]
    near = lambda v: pytest.approx(v, abs=2e-6)
    x = told["x"].reshape(len(told["x"]), 7, 7)
    ratio = lambda v, n: (v @ told["w"][:, :n]) / told["w"][:, :n].sum(axis=0)
    for i, (k, r) in enumerate(got.items()):
        own, hit, wrong, wrong_hit = x[:, i, :4].T
        assert (r.n, r.explained) == (len(x), near(fitted[0].explained[:k].sum()))
        assert (r.nll, r.accuracy, r.matched_wrong_nll, r.matched_wrong_accuracy, r.identity_gap) == tuple(near(v.mean()) for v in (own, hit, wrong, wrong_hit, wrong - own))
        low, high = np.quantile(ratio(wrong - own, 2000), [0.025, 0.975])
        assert (r.gap_low, r.gap_high, r.true_history_better) == (near(low), near(high), bool(low > 0))
        nll, accuracy = own - x[:, 1, 0], hit - x[:, 1, 1]
        more = [v for z in (nll, accuracy) for v in (z.mean(), *np.quantile(ratio(z, 5000), [0.025, 0.975]))]
        assert list(r)[11:17] == ([near(v) for v in more] if k > 1 else [None] * 6)
    assert got[0].identity_gap == got[0].gap_high == 0 and got[24].n_categories > 24

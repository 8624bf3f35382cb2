"""Trait models and personas: likelihoods from plain loops, which no small change of the fit raises."""

import numpy as np
import pytest

from surveyloom.operators import factorise as fz

ROWS = "panel_id string, question_key string, answer_index int, n_options int, group_code int"


def softmax(s):
    e = np.exp(s - s.max())
    return e / e.sum()


def answers(spark, n=120, items=6, seed=0):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(items, 3, 2)) * 1.5
    out = []
    for p in range(n):
        group = p % 3
        theta = rng.normal(size=2) * 0.7 + [(1, 0), (0, 1), (-1, -1)][group]
        for i in range(items):
            if rng.random() < 0.8:
                k = 2 + i % 2
                out.append((f"p{p}", f"q{i}", int(rng.choice(k, p=softmax(a[i, :k] @ theta))), k, group if p % 7 else -1))
    return out, spark.createDataFrame(out, ROWS)


def plain_likelihood(rows, model, theta, rule):
    total, groups = 0.0, {}
    for p, q, y, k, g in rows:
        a = model.loadings[model.items[q], :k]
        total += np.log(softmax(a[:, 0] + a[:, 1:] @ theta[p])[y])
        groups[p] = g
    for p, t in theta.items():
        mean = model.weights[groups[p]] if groups[p] >= 0 and len(model.weights) else 0.0
        total -= 0.5 * rule.precision * ((t - mean) ** 2).sum()
    return total - 0.5 * rule.ridge * ((model.loadings**2).sum() + (model.weights**2).sum())


@pytest.mark.parametrize("codes,features", [(["group_code"], 3), ([], 0)])
def test_fit_is_a_maximum_and_never_falls(spark, codes, features):
    rows, df = answers(spark)
    rule = fz.TraitRule(rounds=20, inner=6, settle=1e-7)
    model, held = fz.fit_traits(df.repartition(5), rule, codes, features)
    assert all(b >= a - 1e-9 for a, b in zip(model.history, model.history[1:])) and model.history[-1] > model.history[0] + 20
    theta = {r.panel_id: np.array(r.theta) for r in held.collect()}
    free = rows if codes else [(*r[:4], -1) for r in rows]
    best = plain_likelihood(free, model, theta, rule)
    assert abs(best - model.history[-1]) < 1e-3 * abs(best)
    rng = np.random.default_rng(1)
    for _ in range(8):
        step = 0.2 * rng.normal(size=model.loadings.shape) * (np.arange(3) < model.sizes[:, None])[..., None]
        near = fz.TraitModel(model.items, model.sizes, model.loadings + step, model.weights, rule)
        assert plain_likelihood(free, near, theta, rule) < best
        some = {p: t + 0.3 * rng.normal(size=2) for p, t in theta.items()}
        assert plain_likelihood(free, model, some, rule) < best
    again, _ = fz.fit_traits(df.repartition(2), rule, codes, features)
    assert np.allclose(again.loadings, model.loadings, atol=1e-6)


def test_known_answers_move_a_trait_from_its_expectation(spark):
    rows, df = answers(spark)
    model, _ = fz.fit_traits(df, fz.TraitRule(rounds=10), ["group_code"], 3)
    new = [("n1", "q1", 0, 3, 2), ("n1", "q3", 2, 3, 2), ("n2", "q1", 1, 3, -1)]
    known = fz.by_respondent(spark.createDataFrame(new, ROWS), model.items, ["group_code"])
    start = {r.panel_id: r.theta for r in fz.with_traits(known, model, 0, start=True).collect()}
    assert np.allclose(start["n1"], model.weights[2]) and start["n2"] == [0.0, 0.0]
    moved = fz.with_traits(known, model, 30, start=True)
    theta = {r.panel_id: np.array(r.theta) for r in moved.collect()}

    def loss(p, t):
        mean = model.weights[2] if p == "n1" else 0.0
        return sum(np.log(softmax((a := model.loadings[model.items[q], :k])[:, 0] + a[:, 1:] @ t)[y]) for o, q, y, k, _ in new if o == p) - 0.5 * ((t - mean) ** 2).sum()

    for p, t in theta.items():
        assert all(loss(p, t) >= loss(p, t + e) for e in 0.01 * np.array([(1, 0), (-1, 0), (0, 1), (0, -1)]))
    asked = spark.createDataFrame([("n1", "q0"), ("n2", "q5")], "panel_id string, question_key string")
    got = {r.panel_id: r.p for r in fz.trait_shares(asked, moved, model).collect()}
    a = model.loadings[0, :2]
    assert np.allclose(got["n1"], softmax(a[:, 0] + a[:, 1:] @ theta["n1"])) and len(got["n2"]) == 3
    for bad in (("n1", "q9"), ("nobody", "q0")):
        with pytest.raises(Exception, match="no (parameters|trait) for"):
            fz.trait_shares(spark.createDataFrame([bad], asked.schema), moved, model).collect()


def test_repeated_answers_fail_and_no_rows_give_an_empty_model(spark):
    with pytest.raises(Exception, match="repeated key"):
        fz.fit_traits(spark.createDataFrame([("p", "q", 0, 2, 0)] * 2, ROWS))
    model, held = fz.fit_traits(spark.createDataFrame([], ROWS))
    assert model.items == {} and held.count() == 0 and model.history == []


def test_personas_rise_and_stop_at_the_best(spark):
    rng = np.random.default_rng(5)
    vectors = {f"q{i}": rng.normal(size=(3, 4)) for i in range(8)}
    theta = rng.normal(size=(2, 4)) * 2
    rows = [(f"p{p}", q, int(rng.choice(3, p=softmax(v @ theta[p % 2]))), 3, 0) for p in range(160) for q, v in vectors.items()]
    df = spark.createDataFrame(rows, ROWS)
    options = spark.createDataFrame([(q, v.tolist()) for q, v in vectors.items()], "question_key string, options array<array<double>>")
    rule = fz.PersonaRule(personas=2, rounds=12)
    train, held = df.where("int(substr(panel_id, 2)) < 120"), df.where("int(substr(panel_id, 2)) >= 120")
    known, asked = held.where("question_key < 'q5'"), held.where("question_key >= 'q5'")
    head = fz.fit_personas(train, options, rule, (known, asked))
    rise, losses = zip(*head.history)
    assert all(b >= a - 1e-9 for a, b in zip(rise, rise[1:])) and min(losses) < np.log(3) - 0.2
    logs = head.conditionals()
    plain = 0.0
    for p in range(120):
        mine = [(q, y) for o, q, y, _, _ in rows if o == f"p{p}"]
        plain += np.log(sum(head.mixture[m] * np.exp(sum(logs[head.items[q], m, y] for q, y in mine)) for m in range(2)))
    at = int(np.argmin(losses))
    assert abs(plain + np.log(head.mixture).sum() - 0.5 * ((head.theta**2).sum() + (head.bias**2).sum()) - rise[at]) < 1e-6
    got = fz.mixed_shares(head, known, asked).collect()
    who = {o: np.array([head.mixture[m] * np.exp(sum(logs[head.items[q], m, y] for p, q, y, _, _ in rows if p == o and q < "q5")) for m in range(2)]) for o in {r.panel_id for r in got}}
    for r in got:
        w = who[r.panel_id] / who[r.panel_id].sum()
        assert np.allclose(r.p, sum(w[m] * np.exp(logs[head.items[r.question_key], m]) for m in range(2)))
    none = fz.mixed_shares(head, known.limit(0), asked.limit(1)).first()
    assert np.allclose(none.p, head.mixture @ np.exp(logs[head.items[none.question_key]]))
    priors = spark.createDataFrame([("p121", [1.0])], "panel_id string, prior array<double>")
    routed = {(r.panel_id, r.question_key): r.p for r in fz.mixed_shares(head, known.limit(0), asked, priors=priors).collect()}
    assert np.allclose(routed["p121", "q6"], np.exp(logs[head.items["q6"], 0]), atol=1e-5)
    assert np.allclose(routed["p122", "q6"], head.mixture @ np.exp(logs[head.items["q6"]]))
    found = {r.panel_id: r.posterior for r in fz.persona_posteriors(head, known).collect()}
    assert all(np.allclose(found[p], who[p] / who[p].sum()) for p in who)

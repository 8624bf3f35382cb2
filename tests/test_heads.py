"""Heads: gradients against differences, distributed descent against a plain run."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyloom.operators import heads


def block(n=7, c=4, dz=3, do=5, seed=0):
    rng = np.random.default_rng(seed)
    size = rng.integers(2, c + 1, n)
    mask = np.arange(c) < size[:, None]
    options = rng.normal(size=(n, c, do)) * mask[:, :, None]
    direct = rng.random((n, c)) * mask
    target = np.array([rng.integers(0, k) for k in size])
    question = [f"q{i % 2}" for i in range(n)]
    return heads.Rows(n, mask, options, target, rng.normal(size=(n, dz)), rng.normal(size=(n, c)) * mask, direct, rng.integers(0, 3, (n, 2)), question)


def moved(p, seed=1):
    rng = np.random.default_rng(seed)
    return {k: np.array(v + 0.3 * rng.normal(size=v.shape)) for k, v in p.items()}


KINDS = {
    "decoder": heads.OptionDecoder(max_options=4, z_dim=3, o_dim=5, width=2, learn_prior_weight=True),
    "ranked": heads.OptionDecoder(max_options=4, z_dim=3, o_dim=5, width=2, rank_weight=0.7),
    "calibrator": heads.DirectCalibrator(max_options=4, o_dim=5, width=2),
    "base": heads.DemographicBase(max_options=4, dim=5, cards=(3, 3)),
    "aligner": heads.Aligner(max_options=4, z_dim=3, o_dim=5, width=3, hidden=4),
    "aligner_within": heads.Aligner(max_options=4, z_dim=3, o_dim=5, width=3, hidden=4, across=False),
}


@pytest.mark.parametrize("kind", KINDS)
def test_gradients_equal_differences(kind):
    head, rows = KINDS[kind], block()
    p = moved(head.start())
    extra = None
    if kind == "aligner":
        chosen = sorted({(q, int(t)) for q, t in zip(rows.question, rows.target)})
        extra = {k: i for i, k in enumerate(chosen)}, np.random.default_rng(4).normal(size=(len(chosen), 5)), np.array([sum((q, t) == k for q, t in zip(rows.question, rows.target)) for k in chosen])
    gradient = head.loss_and_gradient(p, rows, extra)[1]
    for k, v in p.items():
        for at in list(np.ndindex(v.shape))[:12]:
            if kind == "base" and k.startswith("table") and at[0] == 0 or k == "prior" and not getattr(head, "learn_prior_weight", True):
                assert gradient[k][at] == 0
                continue
            up, down = ({n: x.copy() for n, x in p.items()} for _ in range(2))
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            want = (head.loss_and_gradient(up, rows, extra)[0] - head.loss_and_gradient(down, rows, extra)[0]) / 2e-5
            assert abs(gradient[k][at] - want) < 1e-4, (k, at)


def test_comparisons_across_rows_equal_all_pairs():
    head, rows = KINDS["aligner"], block(9)
    rows.options = np.random.default_rng(8).normal(size=(2, 4, 5))[[int(q[1]) for q in rows.question]] * rows.mask[:, :, None]
    rows.mask[:] = True
    rows.options = np.random.default_rng(8).normal(size=(2, 4, 5))[[int(q[1]) for q in rows.question]]
    chosen = sorted({(q, int(t)) for q, t in zip(rows.question, rows.target)})
    first = {k: rows.options[[i for i in range(9) if (rows.question[i], rows.target[i]) == k][0], k[1]] for k in chosen}
    extra = {k: i for i, k in enumerate(chosen)}, np.array([first[k] for k in chosen]), np.array([sum((q, t) == k for q, t in zip(rows.question, rows.target)) for k in chosen])
    p = moved(head.start())
    u = heads._unit(head.project(p, rows.z))[0]
    v = heads._unit(rows.options @ p["o"])[0]
    t = heads.softplus(p["temperature"]) + 1e-4
    for i, loss in enumerate(head.losses(p, rows, extra)):
        logits = [u[i] @ v[i, c] / t for c in range(4)] + [u[i] @ v[j, rows.target[j]] / t for j in range(9) if j != i]
        assert abs(loss - (np.log(np.exp(logits).sum()) - u[i] @ v[i, rows.target[i]] / t)) < 1e-9


def made(spark, n=240, seed=2):
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(6, 3, 4))
    out = []
    for i in range(n):
        z, q = rng.normal(size=4), i % 6
        s = vectors[q] @ z * 2
        out.append((f"r{i}", f"q{q}", int(rng.choice(3, p=np.exp(s) / np.exp(s).sum())), z.tolist(), vectors[q].tolist(), [0.0] * 3))
    return spark.createDataFrame(out, "row_id string, question_key string, answer_index int, z array<double>, options array<array<double>>, log_prior array<double>")


def test_descent_equals_plain_run_and_learns(spark):
    rows = made(spark)
    head, rule = heads.OptionDecoder(max_options=3, z_dim=4, o_dim=4, width=4), heads.Descent(epochs=5, rate=0.05, patience=9)
    train, held = rows.where("substr(row_id, -1) < '8'"), rows.where("substr(row_id, -1) >= '8'")
    fitted = heads.descend(head, train.repartition(5), held, "row_id", rule)
    dealt = train.withColumn("batch", heads.batch_of(F.col("row_id"), rule.batches, 1701)).toArrow()
    p, memory, losses = head.start(), {}, []
    for _ in range(rule.epochs):
        total = 0
        for b in range(rule.batches):
            part = dealt.filter(dealt.column("batch").to_numpy() == b).combine_chunks().to_batches()[0]
            loss, gradient = head.loss_and_gradient(p, heads.rows_of(part, 3))
            total += loss
            p = heads.adam(p, {k: v / len(part) for k, v in gradient.items()}, memory, rule)
        losses.append(total / len(dealt))
    assert all(np.allclose(p[k], fitted.parameters[k], atol=1e-9) for k in p)
    assert np.allclose(losses, [x for x, _ in fitted.history]) and all(a > b for a, b in zip(losses, losses[1:]))
    got = heads.predict(head, fitted.parameters, held).collect()
    assert len(got) == 48 and all(abs(sum(r.p) - 1) < 1e-9 for r in got)
    assert np.mean([-np.log(r.p[r.answer_index]) for r in got]) < np.log(3) - 0.1


def test_patience_returns_the_best(spark):
    rows = made(spark, 60)
    wrong = rows.withColumn("answer_index", 2 - F.col("answer_index"))
    fitted = heads.descend(heads.OptionDecoder(max_options=3, z_dim=4, o_dim=4), rows, wrong, "row_id", heads.Descent(epochs=30, rate=0.3, patience=2))
    scores = [v for _, v in fitted.history]
    assert len(scores) < 30 and len(scores) - 1 - int(np.argmin(scores)) == 2


def test_aligner_descends_and_empty_rows_give_the_start(spark):
    rows, head = made(spark, 120), heads.Aligner(z_dim=4, o_dim=4, width=4, max_options=3, temperature=0.5)
    fitted = heads.descend(head, rows, None, "row_id", heads.Descent(epochs=4, batches=2, rate=0.05))
    losses = [x for x, _ in fitted.history]
    assert losses[-1] < losses[0]
    assert len(heads.aligned(head, fitted.parameters, rows).first()["aligned"]) == 4
    none = heads.descend(head, rows.limit(0), None, "row_id", heads.Descent(epochs=2))
    assert none.history == [] and np.array_equal(none.parameters["line"], head.start()["line"])


def test_arrays_are_of_few_rows_at_a_time(monkeypatch):
    """Sums over a batch are those over its slices, which bound the memory of a task."""
    import pyarrow as pa

    rng, seen, plain = np.random.default_rng(1), [], heads.rows_of
    batch = pa.RecordBatch.from_pydict({"options": rng.normal(size=(1700, 3, 4)).tolist(), "answer_index": rng.integers(0, 3, 1700).tolist(), "codes": rng.integers(0, 3, (1700, 2)).tolist()})
    head = heads.DemographicBase(max_options=3, dim=4, cards=(3, 3))
    monkeypatch.setattr(heads, "rows_of", lambda b, n: seen.append(len(b)) or plain(b, n))
    monkeypatch.setattr(heads, "gathered", lambda rows, fold: fold(None, rows))
    got = heads._sum_losses(batch, head, head.start())
    assert abs(got - head.losses(head.start(), plain(batch, 3)).mean()) < 1e-12
    assert max(seen) <= 500 and sum(seen) == 1700

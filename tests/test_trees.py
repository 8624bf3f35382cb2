"""Trees against plain loops over the rows."""

import heapq

import numpy as np
import pytest

from surveyloom.operators import trees


def data(spark, n=900, seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        a, b, c = int(rng.integers(0, 4)), float(rng.normal()), float(rng.choice([0.5, 1.5]))
        y = int(a >= 2) if rng.random() < 0.9 else int(rng.integers(0, 3))
        out.append((None if rng.random() < 0.1 else a, float("nan") if rng.random() < 0.05 else b, c, y, int(b > 0), int(rng.random() < 1 / (1 + np.exp(-(2 * b + a - 1.5))))))
    return spark.createDataFrame(out, "a int, b double, c double, y int, w int, chosen int")


def test_bins_have_modes_and_quantiles(spark):
    df = data(spark)
    bins = trees.fit_bins(df, ["a", "b", "c"], 8)
    rows = df.toPandas()
    assert bins.modes["a"] == rows["a"].mode().min() and [len(c) for c in bins.cuts] == [3, 7, 1]
    got = np.array([r.bins for r in bins.applied(df).collect()])
    filled = rows[["a", "b", "c"]].fillna(bins.modes).to_numpy()
    assert all((got[:, j] == (bins.cuts[j][None] < filled[:, j : j + 1]).sum(axis=1)).all() for j in range(3))
    assert np.bincount(got[:, 1]).min() > 60


def test_forest_counts_its_rows_and_does_not_depend_on_dealing(spark):
    df, rule = data(spark), trees.ForestRule(trees=6, depth=5, least=15, most_cells=400)
    grown = trees.grow_forest(df.repartition(7), ["a", "b", "c"], ["y", "w"], [3, 2], rule, 8)
    again = trees.grow_forest(df.coalesce(1), ["a", "b", "c"], ["y", "w"], [3, 2], trees.ForestRule(trees=6, depth=5, least=15), 8)
    assert [(t.feature, t.cut) for t in grown.trees] == [(t.feature, t.cut) for t in again.trees]
    rows = grown.bins.applied(df).toPandas()
    bins, y = np.array(rows["bins"].to_list()), rows[["y", "w"]].to_numpy()
    assert len({tuple(t.feature) for t in grown.trees}) > 1
    for t in grown.trees:
        at = t.leaves(bins)
        assert max(t.depth) <= 5 and len(t.feature) > 3
        for leaf in range(len(t.feature)):
            if t.feature[leaf] < 0:
                mine = y[at == leaf]
                assert len(mine) >= 15
                assert (t.value[leaf] == [np.bincount(mine[:, 0], minlength=3), np.append(np.bincount(mine[:, 1], minlength=2), 0)]).all()
    got = trees.forest_shares(grown, df).collect()
    p = np.array([r.shares[0] for r in got])
    assert all([len(s) for s in r.shares] == [3, 2] and abs(sum(r.shares[1]) - 1) < 1e-9 for r in got)
    assert np.mean(p.argmax(axis=1) == [r.y for r in got]) > 0.8
    plain = np.mean([np.array([t.value[n][0] / t.value[n][0].sum() for n in t.leaves(np.array(rows["bins"].to_list()))]) for t in grown.trees], axis=0)
    by = {(tuple(b), a, c): s for b, a, c, s in zip(bins.tolist(), rows["chosen"], rows["y"], plain)}
    assert {tuple(np.round(x, 9)) for x in by.values()} >= {tuple(np.round(x, 9)) for x in p}


def test_a_forest_does_not_gather_in_the_driver(spark, monkeypatch):
    """Few trees grow at a time, tasks get no counts and the driver one merged state; the trees are those of one group."""
    df, sent, plain = data(spark), [], trees.gathered

    def gathered(rows, fold, merge, large=False):
        bare = fold.__closure__[fold.__code__.co_freevars.index("trees")].cell_contents
        sent.append((large, len(bare), sum(len(t.value) for t in bare.values())))
        return plain(rows, fold, merge, large)

    monkeypatch.setattr(trees, "gathered", gathered)
    columns, outputs = ["a", "b", "c"], (["y", "w"], [3, 2])
    whole = trees.grow_forest(df, columns, *outputs, trees.ForestRule(trees=6, depth=5, least=15), 8)
    few = trees.grow_forest(df.repartition(20), columns, *outputs, trees.ForestRule(trees=6, depth=5, least=15, most_nodes=130), 8)
    assert (len(whole.files), len(few.files)) == (1, 3)
    assert all(large and n <= 6 and not values for large, n, values in sent) and max(n for _, n, _ in sent[-10:]) == 2
    assert [(t.feature, t.cut, t.value.counts.tolist()) for t in few.trees] == [(t.feature, t.cut, t.value.counts.tolist()) for t in whole.trees]
    shares = lambda forest: sorted(map(str, trees.forest_shares(forest, df.select("a", "b", "c")).collect()))
    assert shares(few) == shares(whole)


def plain_tree(bins, g, h, width, rule):
    """Best-first growth by loops, one node after another."""
    unit = trees.UNIT

    def worth(a, b):
        return (a / unit) ** 2 / (b / unit + rule.ridge)

    def best(rows):
        found = (1e-9, None)
        for f in range(bins.shape[1]):
            for cut in range(width - 1):
                left = rows[bins[rows, f] <= cut]
                if min(len(left), len(rows) - len(left)) < rule.least:
                    continue
                gl, hl = g[left].sum(), h[left].sum()
                gain = worth(gl, hl) + worth(g[rows].sum() - gl, h[rows].sum() - hl) - worth(g[rows].sum(), h[rows].sum())
                if gain > found[0]:
                    found = (gain, (f, cut))
        return found

    rows = np.arange(len(g))
    gain, split = best(rows)
    heap, leaves, number = [(-gain, 0, rows, split)], [], 1
    while heap:
        gain, _, rows, split = heapq.heappop(heap)
        if split is None or len(leaves) + len(heap) + 1 >= rule.leaves:
            leaves.append(rows)
            continue
        left = bins[rows, split[0]] <= split[1]
        for part in (rows[left], rows[~left]):
            gain, found = best(part)
            heapq.heappush(heap, (-gain if found else 0.0, number, part, found))
            number += 1
    return leaves


def test_boosting_equals_loops(spark):
    df, rule = data(spark, 500), trees.BoostRule(rounds=3, rate=0.3, leaves=6, least=10, most_cells=60)
    model = trees.grow_boosted(df.repartition(5), ["a", "b", "c"], "chosen", rule, 8)
    assert all(b < a for a, b in zip(model.history, model.history[1:])) and len(model.trees) == 3
    rows = model.bins.applied(df).toPandas()
    bins, y = np.array(rows["bins"].to_list()), rows["chosen"].to_numpy()
    logit = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for tree, loss in zip(model.trees, model.history):
        assert abs(loss - np.mean(np.logaddexp(0, logit) - y * logit)) < 1e-6
        p = 1 / (1 + np.exp(-logit))
        g, h = np.rint((p - y) * trees.UNIT), np.rint(p * (1 - p) * trees.UNIT)
        leaves = plain_tree(bins, g, h, model.bins.width, rule)
        at = tree.leaves(bins)
        assert {tuple(x) for x in leaves} == {tuple(np.flatnonzero(at == n)) for n in set(at)}
        for rows_ in leaves:
            value = tree.value[at[rows_[0]]]
            assert abs(value + rule.rate * (g[rows_].sum() / trees.UNIT) / (h[rows_].sum() / trees.UNIT + rule.ridge)) < 1e-12
        logit += np.array(tree.value)[at]
    got = trees.boosted_shares(model, df.selectExpr("*", "a is null as row_id")).collect()
    assert abs(sum(r.p for r in got if r.row_id) - 1) < 1e-9


def test_nothing_to_learn(spark):
    df = data(spark, 50)
    with pytest.raises(ValueError, match="other candidates"):
        trees.grow_boosted(df.where("chosen = 1"), ["a"], "chosen")
    empty = trees.grow_forest(df.limit(0), ["a", "b"], ["y"], [3], trees.ForestRule(trees=2))
    assert [t.feature for t in empty.trees] == [[-1], [-1]]
    assert trees.forest_shares(empty, df).first().shares == [[0.0, 0.0, 0.0]]


def test_small_nodes_are_split_where_their_rows_meet(spark, monkeypatch):
    """Histograms are summed for nodes of many rows only; other nodes do not reach the driver before they are split, and trees do not depend on blocks."""
    df, sent, plain = data(spark), [], trees.gathered

    def gathered(rows, fold, merge, large=False):
        sent.append(len(fold.__closure__[fold.__code__.co_freevars.index("open_nodes")].cell_contents))
        return plain(rows, fold, merge, large)

    monkeypatch.setattr(trees, "gathered", gathered)
    rule = trees.ForestRule(trees=4, depth=8, least=2)
    grown = [trees.grow_forest(df, ["a", "b", "c"], ["y", "w"], [3, 2], rule, 8)]
    size = lambda t, n: t.value[n][0].sum() if t.feature[n] < 0 else size(t, t.left[n]) + size(t, t.right[n])
    sizes = [size(t, n) for t in grown[0].trees for n in range(len(t.feature))]
    assert sum(sent) <= sum(x >= 8 * 2 * 3 for x in sizes) < len(sizes) - 20
    monkeypatch.setattr(trees, "BLOCK", 20)
    grown.append(trees.grow_forest(df.repartition(5), ["a", "b", "c"], ["y", "w"], [3, 2], rule, 8))
    assert len({str([(t.feature, t.cut, t.value.counts.tolist()) for t in x.trees]) for x in grown}) == 1


def test_boosting_walks_a_tree_once_for_each_row(spark, monkeypatch):
    """Tasks have the logits so far as a column, so a step reads no finished tree."""
    sent, plain = [], trees.gathered
    monkeypatch.setattr(trees, "gathered", lambda rows, fold, merge: sent.append((rows.columns, set(fold.__code__.co_freevars))) or plain(rows, fold, merge))
    trees.grow_boosted(data(spark, 300), ["a", "b"], "chosen", trees.BoostRule(rounds=2, leaves=3), 8)
    assert all("logit" in columns and "model" not in free for columns, free in sent)

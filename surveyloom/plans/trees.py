"""Queries over trees; tests compare them with plain versions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from surveyloom.functions import probs
from surveyloom.operators import inference, joins, questionnaires, subspace, trees
from surveyloom.plans.catalogue import register
from surveyloom.plans.heads import DEMOGRAPHICS, N, head_rows, parts
from surveyloom.plans.scores import rounded
from surveyloom.sources.scratch import written
from surveyloom.sources.tables import people, responses

SOURCES, TARGETS = [f"q{i:02d}" for i in range(1, 11)], ["q11", "q12"]
CODES = [f"{c}_code" for c in DEMOGRAPHICS]


def coded(rows):
    """Demographic codes fitted on training rows; unknown values are null, so the mode stands in for them."""
    fitted = questionnaires.fitted_vocabulary(rows.where("split = 'train'"), DEMOGRAPHICS)
    out = questionnaires.encoded_columns(rows, fitted, DEMOGRAPHICS)
    return out.withColumns({c: F.when(F.col(c) > 0, F.col(c)) for c in CODES})


def profiles(s, d):
    """A row a respondent who answered the targets: demographics, answers to the sources (null where there is none) and targets."""
    wide = responses(s, d).groupBy("panel_id").pivot("question_id", [*SOURCES, *TARGETS]).agg(F.first("answer_index"))
    rows = people(s, d).select("panel_id", "split", *DEMOGRAPHICS).join(wide, "panel_id")
    return written(coded(rows.dropna(subset=TARGETS)), "profiles")


def forest(s, d):
    rows = profiles(s, d)
    grown = trees.grow_forest(rows.where("split = 'train'"), [*CODES, *SOURCES], TARGETS, [N] * len(TARGETS))
    return grown, rows


def _forest_shares(s, d):
    grown, rows = forest(s, d)
    out = trees.forest_shares(grown, rows.where("split = 'test'").select("panel_id", *CODES, *SOURCES))
    return rounded(out.select("panel_id", *[F.col("shares")[t][c].alias(f"{q}_{c}") for t, q in enumerate(TARGETS) for c in range(N)]))


register("forest_shares", _forest_shares)


def candidates(rows):
    """A row an option: whether it was chosen, its prior and place, and how it lies to the respondent."""
    each = rows.select("row_id", "answer_index", "z", "log_prior", *CODES, F.posexplode("options").alias("option_index", "vector"))
    z = F.col("z").cast("array<double>")
    return each.select(
        "row_id", "option_index", *CODES, (F.col("option_index") == F.col("answer_index")).cast("int").alias("chosen"), F.col("log_prior")[F.col("option_index")].alias("log_prior"),
        (F.col("option_index") / (N - 1)).alias("place"), F.round(probs.dot(z, F.col("vector")), 12).alias("dot"), F.round(F.sqrt(probs.squared_distance(z, F.col("vector"))), 12).alias("distance"),
    )


FEATURES = ["log_prior", "place", "dot", "distance", *CODES]
#: A job for each depth of each tree: fewer and longer steps than the operator's own 300 of 0.05.
BOOST = trees.BoostRule(rounds=20, rate=0.2)


def boosted(s, d):
    train, _, test = (candidates(part) for part in parts(coded(head_rows(s, d))))
    return trees.grow_boosted(train, FEATURES, "chosen", BOOST), test


def _boosted_shares(s, d):
    model, test = boosted(s, d)
    return rounded(trees.boosted_shares(model, test).select("row_id", "option_index", "p"))


register("boosted_choice_shares", _boosted_shares)


def _boosted_history(s, d):
    model, _ = boosted(s, d)
    return rounded(s.createDataFrame(list(enumerate(model.history)), "round int, train_loss double"))


register("boosted_choice_history", _boosted_history)


def _svd(s, d, rule=subspace.SvdRule()):
    rows = profiles(s, d)
    return subspace.fit_svd(rows.where("split = 'train'"), SOURCES, rule), rows


def _svd_factors(s, d):
    model, rows = _svd(s, d)
    out = subspace.svd_factors(model, rows.select("panel_id", *SOURCES))
    return rounded(out.select("panel_id", *[F.get("factors", F.lit(i)).alias(f"f{i}") for i in range(len(model.values))]), 6)


register("sparse_svd_factors", _svd_factors)


#: Numbers of factors, and the replicates of the gaps to another respondent's history and of the differences from one factor.
DIMENSIONS, GAP_DRAWS, DRAWS = (0, 1, 2, 4, 8, 16, 24), 2000, 5000


def _interval(draws):
    known = draws[~np.isnan(draws)]
    return [float(x) for x in np.quantile(known, [0.025, 0.975])] if len(known) else [None, None]


def _ceiling(s, d):
    """Losses on test respondents by number of factors, with their own factors and with those of another respondent of the same sex, age and education; gaps and differences from one factor with intervals."""
    model, rows = _svd(s, d, subspace.SvdRule(k=max(DIMENSIONS)))
    sizes = {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}
    # one less than the rows and the categories at most; greater dimensions have all of these
    most = min(len(model.values), len(model.categories) - 1, sizes["train"] - 1)
    names = [f"f{i}" for i in range(most)]
    spread = lambda df: df.withColumns({c: F.get("factors", F.lit(i)) for i, c in enumerate(names)}).drop("factors")
    train = spread(subspace.svd_factors(model, rows.where("split = 'train'")))
    test = written(joins.stratum_shuffle(spread(subspace.svd_factors(model, rows.where("split = 'test'"))), ["sex", "age_bin", "education"], "panel_id", names, 1701), "ceiling")
    train, each = written(train, "ceiling"), None
    loss = sum(-F.log(F.greatest(F.col("shares")[t][F.col(q)], F.lit(probs.FLOOR))) for t, q in enumerate(TARGETS)) / len(TARGETS)
    hit = sum((probs.argmax(F.col("shares")[t]) == F.col(q)).cast("double") for t, q in enumerate(TARGETS)) / len(TARGETS)
    for k in DIMENSIONS:
        grown = trees.grow_forest(train, [*CODES, *names[:k]], TARGETS, [N] * len(TARGETS))
        side = lambda wrong, start: test.select("panel_id", F.lit(wrong).alias("wrong"), *CODES, *TARGETS, *[F.col(f"{start}{c}").alias(c) for c in names[:k]])  # noqa: B023, E731
        both = trees.forest_shares(grown, side(False, "").unionByName(side(True, "shuffled_")))
        scored = both.select("panel_id", "wrong", F.lit(k).alias("k"), loss.alias("nll"), hit.alias("hit"))
        each = scored if each is None else each.unionByName(scored)
    of = lambda c, k, wrong=False: F.max(F.when((F.col("k") == k) & (F.col("wrong") == wrong), F.col(c)))
    values = [v for k in DIMENSIONS for v in (of("nll", k), of("hit", k), of("nll", k, True), of("hit", k, True), of("nll", k, True) - of("nll", k), of("nll", k) - of("nll", 1), of("hit", k) - of("hit", 1))]
    n, means, draws = inference.drawn_means(each.groupBy("panel_id").agg(F.array(*values).alias("x")), "panel_id", "x", len(values), DRAWS, 1701)
    out = []
    for k, mean, drawn in zip(DIMENSIONS, means.reshape(len(DIMENSIONS), -1), draws.reshape(len(DIMENSIONS), -1, DRAWS), strict=True):
        nll, accuracy, wrong_nll, wrong_accuracy, gap, nll_more, accuracy_more = (float(x) if n else None for x in mean)
        low, high = _interval(drawn[4, :GAP_DRAWS])
        more = [nll_more, *_interval(drawn[5]), accuracy_more, *_interval(drawn[6])] if k > 1 else [None] * 6
        explained = float(model.explained[: min(k, most)].sum())
        out.append((k, nll, accuracy, wrong_nll, gap, explained, n, wrong_accuracy, low, high, low is not None and low > 0, *more, sizes["train"], sizes.get("validation", 0), len(model.categories)))
    return rounded(s.createDataFrame(out, CEILING), 6)


CEILING = (
    "dimension int, nll double, accuracy double, matched_wrong_nll double, identity_gap double, explained double, n bigint, matched_wrong_accuracy double, gap_low double, gap_high double, true_history_better boolean, "
    "nll_from_one double, nll_from_one_low double, nll_from_one_high double, accuracy_from_one double, accuracy_from_one_low double, accuracy_from_one_high double, n_train bigint, n_validation bigint, n_categories bigint"
)


register("latent_dimension_ceiling", _ceiling)

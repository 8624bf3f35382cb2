"""Queries over fitted trait models and personas; tests compare them with plain versions, since no SQL iterates."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom.functions import probs
from surveyloom.operators import factorise, models, questionnaires
from surveyloom.plans.catalogue import register
from surveyloom.plans.heads import DEMOGRAPHICS, N, head_rows, option_vectors
from surveyloom.plans.panel import SEED
from surveyloom.plans.scores import rounded
from surveyloom.sources.scratch import written
from surveyloom.sources.tables import people, responses

HISTORY = 3


def _features(rows):
    """Feature numbers of demographics, fitted on training respondents, and how many there are; unknown values have none."""
    fitted = questionnaires.fitted_vocabulary(rows.where("split = 'train'"), DEMOGRAPHICS)
    sizes = {r["column"]: r["n"] for r in fitted.groupBy("column").agg(F.max("code").alias("n")).collect()}  # a row for each demographic
    out, first = questionnaires.encoded_columns(rows, fitted, DEMOGRAPHICS), 0
    for c in DEMOGRAPHICS:
        out = out.withColumn(f"{c}_code", F.when(F.col(f"{c}_code") > 0, F.col(f"{c}_code") - 1 + first).otherwise(-1).cast("int"))
        first += sizes.get(c, 0)
    return out, first


CODES = [f"{c}_code" for c in DEMOGRAPHICS]


def _item_response(s, d):
    rows, n = _features(responses(s, d).where("not is_unseen_item"))
    rows = written(rows, "answers")
    model, _ = factorise.fit_traits(rows.where("split = 'train'"), factorise.TraitRule(), CODES, n)
    return model, factorise.held_out(rows.where("split = 'test'"), SEED)


def _shown(rows):
    return rounded(rows.select("row_id", *[F.get("p", F.lit(i)).alias(f"p{i}") for i in range(N)]), 7)


def _item_response_shares(s, d):
    """Test respondents start where their demographics are, move by their first answers, and are asked the others."""
    model, placed = _item_response(s, d)
    targets = placed.where(F.col("place") > HISTORY)
    known = factorise.by_respondent(placed.where(F.col("place") <= HISTORY), model.items, CODES)
    traits = factorise.with_traits(known, model, 20, start=True)
    return _shown(factorise.trait_shares(targets, traits, model))


register("item_response_shares", _item_response_shares)


def _item_response_history(s, d):
    model, _ = _item_response(s, d)
    return rounded(s.createDataFrame(list(enumerate(model.history)), "round int, penalised_likelihood double"), 4)


register("item_response_history", _item_response_history)


def _factor_shares(s, d):
    """Known respondents and items: each respondent's last answer by hash is held out."""
    placed = written(factorise.held_out(responses(s, d), SEED), "placed")
    model, traits = factorise.fit_traits(placed.where("place > 1"), factorise.TraitRule(dims=8, precision=2.0))
    both = placed.where("place = 1").join(traits.select("panel_id"), "panel_id", "left_semi")  # a respondent of one answer has no factor
    return _shown(factorise.trait_shares(both, traits, model))


register("factor_shares", _factor_shares)


def _persona(s, d):
    vectors = option_vectors(base := head_rows(s, d))
    rows = base.join(responses(s, d).select("row_id", "panel_id", "n_options"), "row_id").where("not is_unseen_item")
    placed = written(factorise.held_out(rows, SEED).drop("z", "log_prior", "direct", "options"), "placed")
    known, asked = placed.where(F.col("place") <= HISTORY), placed.where(F.col("place") > HISTORY)
    of = lambda df, split: df.where(F.col("split") == split)
    head = factorise.fit_personas(of(placed, "train"), vectors, factorise.PersonaRule(), (of(known, "validation"), of(asked, "validation")))
    return head, of(known, "test"), of(asked, "test"), of(placed, "train")


def _persona_shares(s, d):
    head, known, asked, _ = _persona(s, d)
    return _shown(factorise.mixed_shares(head, known, asked))


register("persona_head_shares", _persona_shares)


def _persona_history(s, d):
    head, *_ = _persona(s, d)
    return rounded(s.createDataFrame([(i, a, b) for i, (a, b) in enumerate(head.history)], "round int, penalised_likelihood double, validation_nll double"), 4)


register("persona_head_history", _persona_history)


def _router_arms(s, d):
    """Test losses when personas come from the mixture, from demographics, from first answers, or from both.

    The router learns the likeliest persona of training respondents from their demographics.
    """
    head, known, asked, train = _persona(s, d)
    who = people(s, d).select("panel_id", *DEMOGRAPHICS)
    labels = factorise.persona_posteriors(head, train).select("panel_id", probs.argmax(F.col("posterior")).cast("double").alias("cluster"))
    labels = written(labels.join(who, "panel_id"), "personas")
    test = written(asked.select("panel_id").distinct().join(who, "panel_id"), "asked")
    routed = models.demographic_router(labels, test, DEMOGRAPHICS).select("panel_id", "prior")
    out = None
    for arm, answers, priors in (("mixture", known.limit(0), None), ("demographics", known.limit(0), routed), ("history", known, None), ("both", known, routed)):
        scored = factorise.mixed_shares(head, answers, asked, priors=priors)
        hit = (probs.argmax(F.col("p")) == F.col("answer_index")).cast("double")
        row = scored.select("panel_id", probs.nll(F.col("p"), F.col("answer_index")).alias("nll"), hit.alias("correct")).groupBy("panel_id").agg(F.avg("nll").alias("nll"), F.avg("correct").alias("correct"))
        row = row.agg(F.lit(arm).alias("arm"), F.avg("nll").alias("nll"), F.avg("correct").alias("accuracy"), F.count(F.lit(1)).alias("n_panels"))
        out = row if out is None else out.unionByName(row)
    return rounded(out, 6)


register("persona_router_arms", _router_arms)

"""Queries over heads fitted by descent; tests compare them with plain runs, since no SQL iterates."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom.operators import heads, questionnaires
from surveyloom.operators.vectors import centroids
from surveyloom.plans.catalogue import register
from surveyloom.plans.scores import rounded, with_prior
from surveyloom.sources.scratch import written
from surveyloom.sources.tables import table

DEMOGRAPHICS = ["country", "sex", "age_bin", "education", "income_quintile"]
N, DIM = 5, 64


def option_vectors(rows):
    """question_key, options: of each option the mean vector of the training respondents who chose it; options and items that none did take the mean of their position."""
    seen = rows.where("split = 'train' and not is_unseen_item")
    own = centroids(seen, ["question_key", "answer_index"], "z").withColumnRenamed("centroid", "own")
    place = centroids(seen, ["answer_index"], "z").withColumnRenamed("centroid", "place")
    every = rows.select("question_key").distinct().withColumn("answer_index", F.explode(F.sequence(F.lit(0), F.lit(N - 1))))
    both = every.join(own, ["question_key", "answer_index"], "left").join(F.broadcast(place), "answer_index", "left")  # a row for each of five positions
    vector = F.coalesce("own", "place", F.array_repeat(F.lit(0.0), DIM))
    listed = both.groupBy("question_key").agg(F.array_sort(F.collect_list(F.struct("answer_index", vector.alias("v")))).alias("o"))
    return listed.select("question_key", F.col("o.v").alias("options"))


def head_rows(s, d):
    """Rows of respondents with a vector: z, options, log_prior, direct (shares of the back-off prior) and demographics."""
    rows = with_prior(s, d).join(table(s, d, "embeddings").select(F.col("vec_id").alias("person_id"), F.col("embedding").alias("z")), "person_id")
    log_prior = F.transform("prior", lambda x: F.log(F.greatest(x, F.lit(1e-12))))
    rows = rows.withColumn("log_prior", log_prior).withColumnRenamed("prior", "direct")
    rows = written(rows, "respondents")  # read for the options as well
    both = rows.join(option_vectors(rows), "question_key")
    return written(both.select("row_id", "question_key", "answer_index", "split", "is_unseen_item", "z", "options", "log_prior", "direct", *DEMOGRAPHICS), "head-rows")


def parts(rows):
    """Training rows of seen items, validation rows, test rows."""
    return rows.where("split = 'train' and not is_unseen_item"), rows.where("split = 'validation'"), rows.where("split = 'test'")


def _fit(s, d, head, rows=None):
    train, validation, test = parts(head_rows(s, d) if rows is None else rows)
    return heads.descend(head, train, validation, "row_id"), test


def _shares(s, d, head, rows=None):
    fitted, test = _fit(s, d, head, rows)
    return rounded(heads.predict(head, fitted.parameters, test).select("row_id", *[F.get("p", F.lit(i)).alias(f"p{i}") for i in range(N)]))


DECODER = heads.OptionDecoder(max_options=N, z_dim=DIM, o_dim=DIM)
register("decoder_shares", lambda s, d: _shares(s, d, DECODER))


def _history(s, d):
    fitted, _ = _fit(s, d, heads.OptionDecoder(max_options=N, z_dim=DIM, o_dim=DIM, rank_weight=0.5, learn_prior_weight=True))
    return rounded(s.createDataFrame([(i, *map(float, x)) for i, x in enumerate(fitted.history)], "epoch int, train_loss double, validation_nll double"))


register("decoder_history", _history)
register("calibrated_shares", lambda s, d: _shares(s, d, heads.DirectCalibrator(max_options=N, o_dim=DIM)))


def _aligned(s, d):
    head = heads.Aligner(z_dim=DIM, o_dim=DIM, max_options=N)
    fitted, test = _fit(s, d, head)
    return rounded(heads.aligned(head, fitted.parameters, test).select("row_id", *[F.get("aligned", F.lit(i)).alias(f"a{i}") for i in range(head.width)]))


register("aligned_vectors", _aligned)


def _base(s, d):
    rows = head_rows(s, d)
    vocabulary = questionnaires.fitted_vocabulary(rows.where("split = 'train'"), DEMOGRAPHICS).cache()
    sizes = {r["column"]: r["n"] for r in vocabulary.groupBy("column").agg(F.max("code").alias("n")).collect()}  # a row for each demographic
    coded = questionnaires.encoded_columns(rows, vocabulary, DEMOGRAPHICS).withColumn("codes", F.array(*[F.col(f"{c}_code").cast("int") for c in DEMOGRAPHICS]))
    head = heads.DemographicBase(max_options=N, dim=DIM, cards=tuple(sizes.get(c, 0) + 1 for c in DEMOGRAPHICS))
    return _shares(s, d, head, coded.drop(*[f"{c}_code" for c in DEMOGRAPHICS]))


register("demographic_base_shares", _base)

"""Latent traits: linear item response with demographic starting points, and shrunk option coefficients."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.functions import probs


def _solved(sums: DataFrame, keys: list[str], d: int, ridge: list[float], out: str) -> DataFrame:
    """Solutions of (h + ridge) x = g for each row of keys, g (d) and h (d * d)."""
    penal = np.diag(ridge)

    def solve(batches):
        for pdf in batches:
            x = [np.linalg.solve(np.reshape(h, (d, d)) + penal, np.asarray(g)).tolist() for g, h in zip(pdf["g"], pdf["h"], strict=True)]
            yield pdf[keys].assign(**{out: x})

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sums.select(*keys).schema)
    return sums.select(*keys, "g", "h").mapInPandas(solve, f"{fields}, {out} array<double>")


def item_loadings(rows: DataFrame, dims: int, ridge: float = 1.0) -> DataFrame:
    """Per item the intercept and loadings of normalised answers on starting traits (question_key, theta, y); training rows only.

    Sums of fixed width per item are all that is shuffled.
    """
    f = [F.lit(1.0), *[F.col("theta")[i] for i in range(dims)]]
    d = dims + 1
    sums = rows.groupBy("question_key").agg(F.array(*[F.sum(x * F.col("y")) for x in f]).alias("g"), F.array(*[F.sum(a * b) for a in f for b in f]).alias("h"))
    return _solved(sums, ["question_key"], d, [0.0] + [ridge] * dims, "loading")


def trait_update(history: DataFrame, starts: DataFrame, loadings: DataFrame, dims: int, precision: float = 1.0) -> DataFrame:
    """Each panel's trait after its history (panel_id, question_key, y): the most likely one with a normal prior around its start (panel_id, theta).

    Panels without a history keep their start.
    """
    known = history.join(loadings, "question_key").join(starts, "panel_id")
    a = [F.col("loading")[i + 1] for i in range(dims)]
    left = F.col("y") - F.col("loading")[0] - sum((a[i] * F.col("theta")[i] for i in range(dims)), F.lit(0.0))
    sums = known.groupBy("panel_id").agg(F.array(*[F.sum(x * left) for x in a]).alias("g"), F.array(*[F.sum(x * y) for x in a for y in a]).alias("h"))
    step = _solved(sums, ["panel_id"], dims, [precision] * dims, "step")
    return starts.join(step, "panel_id", "left").select("panel_id", F.when(F.col("step").isNull(), F.col("theta")).otherwise(F.zip_with("theta", "step", lambda t, s: t + s)).alias("theta"))


def trait_scores(targets: DataFrame, traits: DataFrame, loadings: DataFrame) -> DataFrame:
    """The expected normalised answer of each target, from 0 to 1; unknown items have none."""
    rows = targets.join(traits, "panel_id").join(loadings, "question_key", "left")
    dot = F.col("loading")[0] + probs.dot(F.slice("loading", F.lit(2), F.size("theta")), F.col("theta"))
    return rows.withColumn("expected", F.least(F.greatest(dot, F.lit(0.0)), F.lit(1.0))).drop("theta", "loading")


def left_out_priors(coefficients: DataFrame) -> DataFrame:
    """For each option the mean coefficients of other families' options of its scale length and position, or of all their options.

    ``coefficients``: item, family, n_options, option_position, coefficients.
    A family's own sums are taken off the totals, so no family is looped over.
    """
    d = 3
    sums = lambda *keys: coefficients.groupBy(*keys).agg(*[F.sum(F.col("coefficients")[i]).alias(f"s{i}") for i in range(d)], F.count(F.lit(1)).alias("n"))
    place, whole = ["n_options", "option_position"], Window.partitionBy()
    mine = sums("family", *place)
    at = Window.partitionBy(*place)
    own = Window.partitionBy("family")
    rest = lambda c, w, part: F.sum(c).over(w) - F.sum(c).over(part) if part is not None else F.sum(c).over(w) - F.col(c)
    cells = mine.select("family", *place, *[rest(f"s{i}", at, None).alias(f"p{i}") for i in range(d)], rest("n", at, None).alias("pn"), *[rest(f"s{i}", whole, own).alias(f"a{i}") for i in range(d)], rest("n", whole, own).alias("an"))
    mean = lambda k: F.array(*[F.col(f"{k}{i}") / F.col(f"{k}n") for i in range(d)])
    prior = F.when(F.col("pn") > 0, mean("p")).when(F.col("an") > 0, mean("a")).otherwise(F.array(*[F.lit(0.0)] * d))
    return coefficients.join(cells.select("family", *place, prior.alias("prior")), ["family", *place])


def select_kappa(options: DataFrame, evaluation: DataFrame, candidates: tuple[float, ...] = (0.5, 1.0, 2.0, 5.0, 20.0, 50.0, 200.0)) -> DataFrame:
    """The mean loss of each shrinkage constant and whether it is the best (the least on ties).

    ``options``: item, option_position, m, coefficients (own fit of the pilot),
    prior; a fit of m rows weighs m / (m + kappa). ``evaluation``: item, z1, z2,
    answer (an option_position); answers without an option do not count.
    """
    each = options.withColumn("kappa", F.explode(F.array(*[F.lit(float(k)) for k in candidates])))
    w = F.col("m") / (F.col("m") + F.col("kappa"))
    each = each.select("item", "option_position", "kappa", F.zip_with("coefficients", "prior", lambda a, b: w * a + (1 - w) * b).alias("b"))
    # equal rows have equal losses: they are one row with a count, so no number of a row is needed
    row = ["item", "z1", "z2", "answer"]
    rows = evaluation.groupBy(*row).agg(F.count(F.lit(1)).alias("_n")).join(each, "item")
    score = F.col("b")[0] + F.col("b")[1] * F.col("z1") + F.col("b")[2] * F.col("z2")
    sums = rows.select(*row, "_n", "kappa", score.alias("s"), (F.col("option_position") == F.col("answer")).alias("hit")).groupBy(*row, "_n", "kappa").agg(
        F.max("s").alias("top"), F.collect_list("s").alias("all"), F.max(F.when(F.col("hit"), F.col("s"))).alias("mine")
    )
    total = F.aggregate("all", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("top")))
    loss = -F.log(F.greatest(F.exp(F.col("mine") - F.col("top")) / total, F.lit(probs.FLOOR)))
    out = sums.where(F.col("mine").isNotNull()).groupBy("kappa").agg(F.round(F.sum(loss * F.col("_n")) / F.sum("_n"), 9).alias("loss"))
    return out.withColumn("chosen", F.row_number().over(Window.orderBy("loss", "kappa")) == 1)  # one row for each candidate

"""Calibration of predicted shares: scalar searches, hybrids and shrunk priors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.functions import hashing, probs
from surveyloom.operators.joins import strict_align
from surveyloom.sources.scratch import written


def alike(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows that are equal in ``columns``, once, with their number ``_n``: a loss that reads no more is the same for all of them."""
    context = rows.sparkSession.sparkContext
    # a grid is evaluated for each, so few rows are dealt to all tasks again
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).repartition(2 * context.defaultParallelism)


def _mean(rows: DataFrame, loss: str, digits: int) -> Column:
    """The rounded mean, by number if ``rows`` have one."""
    mean = F.sum(F.col(loss) * F.col("_n")) / F.sum(F.when(F.col(loss).isNotNull(), F.col("_n"))) if "_n" in rows.columns else F.avg(loss)
    return F.round(mean, digits).alias(loss)


def mean_losses(rows: DataFrame, loss_of: Callable[[Column], Column], grid: list[float]) -> list[float]:
    """The mean loss at each point of a grid, in one aggregate; only these numbers reach the driver. ``rows`` may be those of ``alike``."""
    points = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(x)).alias("x")) for i, x in enumerate(grid)]))
    number = [c for c in rows.columns if c == "_n"]
    each = rows.withColumn("_g", points).select(F.col("_g.i").alias("i"), loss_of(F.col("_g.x")).alias("loss"), *number)
    each = each.groupBy("i").agg(_mean(each, "loss", 12))
    found = {r["i"]: r["loss"] for r in each.collect()}
    return [found[i] for i in range(len(grid))]


def bounded_minimum(loss_of: Callable[[Column], Column], rows: DataFrame, low: float, high: float, rounds: int = 4, points: int = 17) -> float:
    """L2: where the mean of ``loss_of(x)`` over ``rows`` is least between bounds.

    Each round evaluates evenly spaced points in one aggregate and goes on
    between the neighbours of the best (the least on ties), so the rows are read
    ``rounds`` times.
    """
    best = (low + high) / 2
    rows = rows.persist()
    for _ in range(rounds):
        step = (high - low) / (points - 1)
        grid = [low + i * step for i in range(points)]
        losses = mean_losses(rows, loss_of, grid)
        at = min(range(points), key=lambda i: (losses[i], i))
        best = grid[at]
        low, high = grid[max(at - 1, 0)], grid[min(at + 1, points - 1)]
    rows.unpersist()
    return best


def fit_temperature(rows: DataFrame, p: str = "p", answer: str = "answer_index", bounds: tuple[float, float] = (-3.0, 5.0)) -> float:
    """L2: the temperature of least mean loss; the search is over its logarithm."""
    import math

    return math.exp(bounded_minimum(lambda t: probs.nll(probs.temper(F.col(p), F.exp(t)), F.col(answer)), alike(rows, p, answer), *bounds))


def fit_share(rows: DataFrame, p: str, q: str, answer: str = "answer_index") -> float:
    """L3: the share of ``q`` in steps of 0.01 whose log-opinion pool with ``p`` loses least."""
    losses = mean_losses(alike(rows, p, q, answer), lambda w: probs.nll(probs.log_pool(F.col(p), F.col(q), w), F.col(answer)), [i / 100 for i in range(101)])
    return min(range(101), key=lambda i: (losses[i], i)) / 100


def hybrid(validation: tuple[DataFrame, DataFrame], test: tuple[DataFrame, DataFrame], seed: int = 1701) -> tuple[DataFrame, dict]:
    """L4: (statistical, reader) predictions of both splits; test rows of the scaled reader and of the pool, and the fitted values.

    Validation panels are halved by hash: the temperature is fitted on one half,
    the share on the other.
    """
    both = strict_align(*validation)
    side = hashing.little_endian_bucket(F.col("panel_id"), seed, 2)
    halves = written(both.withColumn("_side", side), "halves")
    if halves.select("_side").distinct().count() < 2:
        raise ValueError("a half of the validation panels is empty")
    temperature = fit_temperature(halves.where("_side = 0"), "p_right")
    scaled = probs.temper(F.col("p_right"), F.lit(temperature))
    share = fit_share(halves.where("_side = 1").withColumn("_q", scaled), "p", "_q")
    rows = strict_align(*test).withColumn("_q", scaled)
    one = rows.withColumn("method", F.lit("scaled_reader")).withColumn("p", F.col("_q"))
    two = rows.withColumn("method", F.lit("hybrid")).withColumn("p", probs.log_pool(F.col("p"), F.col("_q"), F.lit(share)))
    return one.unionByName(two).drop("_q", "p_right"), {"temperature": temperature, "share": share}


def pooled_prior(coefficients: DataFrame, held_out: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mean coefficient vector by scale length and position over items that are not held out, and over all their options (one row)."""
    rows = coefficients.join(held_out.select("item").distinct(), "item", "left_anti")
    means = [F.avg(F.col("coefficients")[i]).alias(f"c{i}") for i in range(3)]
    table = rows.groupBy("n_options", "option_position").agg(*means)
    pack = F.array("c0", "c1", "c2")
    return table.select("n_options", "option_position", pack.alias("prior")), rows.agg(*means).select(pack.alias("mean"))


def prior_of_options(options: DataFrame, table: DataFrame, mean: DataFrame) -> DataFrame:
    """``prior`` of each option (n_options, option_position), the overall mean where no item has that place."""
    return options.join(table, ["n_options", "option_position"], "left").crossJoin(F.broadcast(mean)).withColumn("prior", F.coalesce("prior", "mean")).drop("mean")  # the mean is one row


def multi_output_prior(train: DataFrame, test: DataFrame, alpha: float = 0.5) -> DataFrame:
    """Loss and accuracy of each target's training shares (+ ``alpha`` on seen labels) on test answers; one row.

    Both sides: unit, target, label. Labels without a training row have the floor.
    """
    cells = train.groupBy("target", "label").agg((F.count(F.lit(1)) + F.lit(alpha)).alias("c"))
    totals = cells.groupBy("target").agg(F.sum("c").alias("t"), F.min_by("label", F.struct(-F.col("c"), F.col("label"))).alias("mode"))
    rows = test.join(totals, "target").join(cells, ["target", "label"], "left")
    loss = -F.log(F.greatest(F.coalesce(F.col("c") / F.col("t"), F.lit(0.0)), F.lit(probs.FLOOR)))
    return rows.agg(
        F.avg(loss).alias("nll"), F.avg((F.col("mode") == F.col("label")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct("unit").alias("n_units"), F.countDistinct("target").alias("n_targets")
    )


def sweep(rows: DataFrame, grid: list[tuple[float, float]], loss_of: Callable[[Column, Column], Column], n: int = 5) -> DataFrame:
    """The ``n`` settings of a grid with the least mean loss, in one pass over the rows, which may be those of ``alike``."""
    points = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in grid]))
    number = [c for c in rows.columns if c == "_n"]
    each = rows.withColumn("_g", points).select("_g.a", "_g.b", loss_of(F.col("_g.a"), F.col("_g.b")).alias("loss"), *number)
    return each.groupBy("a", "b").agg(_mean(each, "loss", 9)).orderBy("loss", "a", "b").limit(n)

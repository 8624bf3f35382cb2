"""Scores of prediction rows and their aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.functions import probs, text
from surveyloom.sources.scratch import written

RUN = ["method", "k", "split", "item_pool"]


def scored(rows: DataFrame) -> DataFrame:
    """Row scores of ``p`` against ``answer_index``."""
    p, a = F.col("p"), F.col("answer_index")
    best = probs.argmax(p)
    return rows.select(
        "*",
        best.alias("predicted_index"),
        probs.nll(p, a).alias("nll"),
        probs.brier(p, a).alias("brier"),
        probs.rps(p, a).alias("rps"),
        (F.abs(best - a) / F.greatest(F.size(p) - 1, F.lit(1))).alias("mae"),
        (best == a).cast("int").alias("correct"),
    )


def respondent_macro(rows: DataFrame, metrics: list[str], keys: list[str] = RUN) -> DataFrame:
    """Mean by panel, then by domain, and the mean of the domains as ``macro`` (not a rollup: each level weighs its parts alike)."""
    panel = rows.groupBy(*keys, "domain", "panel_id").agg(*[F.avg(m).alias(m) for m in metrics])
    domain = panel.groupBy(*keys, "domain").agg(*[F.avg(m).alias(m) for m in metrics], F.count(F.lit(1)).alias("n_panels"))
    macro = domain.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics], F.sum("n_panels").alias("n_panels")).withColumn("domain", F.lit("macro"))
    return domain.unionByName(macro)


def average_probabilities(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of ``p`` by position over rows of equal keys (nulls are equal)."""
    each = rows.select(*keys, F.posexplode("p").alias("_i", "_x")).groupBy(*keys, "_i").agg(F.avg("_x").alias("_x"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias("p"))


def average_decoder_seeds(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The same over methods that differ by seed, with the number of seeds."""
    based = rows.withColumn("base_method", text.strip_seed(F.col("method")))
    seeds = based.groupBy("base_method", *keys).agg(F.countDistinct("method").alias("n_decoder_seeds"))
    return average_probabilities(based, ["base_method", *keys]).join(seeds, ["base_method", *keys]).withColumnRenamed("base_method", "method")


def aggregate_seeds(macro: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean, deviation and number of seeds by method without seed; one pass instead of three joined ones."""
    keys = [c for c in ("k", "split", "item_pool", "domain") if c in macro.columns]
    based = macro.withColumn("method_", text.strip_seed(F.col("method")))
    out = based.groupBy("method_", *keys).agg(
        *[F.avg(m).alias(m) for m in metrics], *[F.stddev_samp(m).alias(f"{m}_std") for m in metrics], F.countDistinct("method").alias("n_seeds")
    )
    return out.withColumnRenamed("method_", "method")


def group_js(rows: DataFrame, groups: list[str], keys: list[str] = RUN) -> DataFrame:
    """Divergence of weighted answer and predicted shares by question and group, averaged to domains and ``macro``."""
    cell = [*keys, "domain", "question_key", *groups]
    each = rows.select(*cell, "survey_weight", "answer_index", F.posexplode("p").alias("i", "x"))
    sums = each.groupBy(*cell, "i").agg(
        F.sum(F.when(F.col("answer_index") == F.col("i"), F.col("survey_weight")).otherwise(0.0)).alias("h"), F.sum(F.col("survey_weight") * F.col("x")).alias("q")
    )
    pair = sums.groupBy(*cell).agg(F.array_sort(F.collect_list(F.struct("i", "h", "q"))).alias("s"))
    js = pair.select(*cell, probs.jensen_shannon(probs.normalise(F.transform("s", lambda s: s["h"])), probs.normalise(F.transform("s", lambda s: s["q"]))).alias("js"))
    domain = js.groupBy(*keys, "domain").agg(F.avg("js").alias("js"))
    return domain.unionByName(domain.groupBy(*keys).agg(F.avg("js").alias("js")).withColumn("domain", F.lit("macro")))


def pearson(x: str, y: str) -> Column:
    """Correlation, null where a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def value_ranks(counts: DataFrame, value: str, n: str) -> DataFrame:
    """(value, rank): mean ranks, from 1, of the values of a table with a row and a number ``n`` for each; nulls come first.

    Values are cut into ranges; ranks within a range go by its own order, and the
    sums of the ranges before it are added, so no task sees all values.
    """
    ranged = counts.select(value, n).repartitionByRange(value).withColumn("_part", F.spark_partition_id())
    ranged = written(ranged, "ranges")  # bounds of ranges are drawn anew whenever they are computed
    sums = ranged.groupBy("_part").agg(F.sum(n).alias("_n"))  # a row a partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.coalesce(F.sum(n).over(Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.join(F.broadcast(sums.select("_part", before.alias("_before"))), "_part")
    return placed.select(value, (F.col("_before") + own + (F.col(n) + 1) / 2).alias("rank"))


def rank_correlation(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row (n, rho): Spearman's correlation over all rows with ties at their mean; null where a side is constant.

    Works on the counts of equal pairs of values; ranks come from counts of values.
    """
    joint = written(rows.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("w")), "joint")
    rank = lambda c: value_ranks(joint.groupBy(c).agg(F.sum("w").alias("n")), c, "n").select(F.col(c).alias(f"_{c}"), F.col("rank").alias(f"r{c}"))
    ranked = joint.join(rank("x"), F.col("x").eqNullSafe(F.col("_x"))).join(rank("y"), F.col("y").eqNullSafe(F.col("_y")))
    middle = joint.agg(((F.sum("w") + 1) / 2).alias("m"))  # the mean of all ranks; one row
    a, b, w = F.col("rx") - F.col("m"), F.col("ry") - F.col("m"), F.col("w")
    sums = ranked.crossJoin(F.broadcast(middle)).agg(F.coalesce(F.sum("w"), F.lit(0)).alias("n"), F.sum(w * a * b).alias("xy"), F.sum(w * a * a).alias("xx"), F.sum(w * b * b).alias("yy"))
    return sums.select("n", F.try_divide("xy", F.sqrt(F.col("xx")) * F.sqrt(F.col("yy"))).alias("rho"))


def correlation_structure(rows: DataFrame, least: int = 20, keys: list[str] = RUN) -> DataFrame:
    """Error and correlation of human and predicted item correlations, by domain and as ``macro``."""
    keys_d = [*keys, "domain"]
    s = rows.select(*keys_d, "panel_id", "question_key", probs.expected_score(F.col("p")).alias("e"), (F.col("answer_index") / F.greatest(F.col("n_options") - 1, F.lit(1))).alias("h"))
    a = s.select(*keys_d, "panel_id", F.col("question_key").alias("qa"), F.col("e").alias("ea"), F.col("h").alias("ha"))
    b = s.select(*keys_d, "panel_id", F.col("question_key").alias("qb"), F.col("e").alias("eb"), F.col("h").alias("hb"))
    pairs = a.join(b, [*keys_d, "panel_id"]).where(F.col("qa") < F.col("qb"))
    corr = pairs.groupBy(*keys_d, "qa", "qb").agg(F.count(F.lit(1)).alias("n"), pearson("ha", "hb").alias("x"), pearson("ea", "eb").alias("y"))
    corr = corr.where((F.col("n") >= least) & F.col("x").isNotNull() & F.col("y").isNotNull())
    domain = corr.groupBy(*keys_d).agg(F.sqrt(F.avg(F.pow(F.col("x") - F.col("y"), F.lit(2.0)))).alias("corr_err"), pearson("x", "y").alias("corr_sim"))
    macro = domain.groupBy(*keys).agg(F.avg("corr_err").alias("corr_err"), F.avg("corr_sim").alias("corr_sim")).withColumn("domain", F.lit("macro"))
    return domain.unionByName(macro)


def worst_group_accuracy(rows: DataFrame, groups: list[str], least: int = 30, keys: list[str] = RUN) -> DataFrame:
    """E14"""
    panel = rows.groupBy(*keys, "panel_id", *groups).agg(F.avg("correct").alias("a"))
    cell = panel.groupBy(*keys, *groups).agg(F.avg("a").alias("a"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return cell.groupBy(*keys).agg(F.min("a").alias("worst_group_accuracy"), F.avg("a").alias("mean_group_accuracy"), F.count(F.lit(1)).alias("n_groups"))


def permutation_consistency(rows: DataFrame, keys: list[str], row: str = "row_id", seed: str = "option_seed", predicted: str = "predicted_index") -> DataFrame:
    """Share of rows with one prediction over all their seeds (two or more)."""
    each = rows.groupBy(*keys, row).agg(F.countDistinct(seed).alias("s"), F.countDistinct(predicted).alias("d")).where(F.col("s") >= 2)
    return each.groupBy(*keys).agg(F.avg((F.col("d") == 1).cast("double")).alias("consistency"), F.count(F.lit(1)).alias("n_rows"))


def delta_k(macro: DataFrame, metric: str) -> DataFrame:
    """Difference from K = 0 of the same method and domain; groups without K = 0 go."""
    w = Window.partitionBy(*[c for c in ("method", "split", "item_pool", "domain") if c in macro.columns])
    base = F.max(F.when(F.col("k") == 0, F.col(metric))).over(w)
    return macro.withColumn("_base", base).where(F.col("_base").isNotNull()).withColumn(f"delta_{metric}", F.col(metric) - F.col("_base") + F.lit(0.0)).drop("_base")


def auac(macro: DataFrame, metric: str, grid: tuple[int, ...] = (0, 1, 3, 5, 8)) -> DataFrame:
    """Mean over the grid of K."""
    keys = [c for c in ("method", "split", "item_pool", "domain") if c in macro.columns]
    return macro.where(F.col("k").isin(*grid)).groupBy(*keys).agg(F.avg(metric).alias(f"auac_{metric}"))


def main_table(macro: DataFrame, metric: str = "nll", grid: tuple[int, ...] = (0, 1, 3, 5, 8), reference: int = 5) -> DataFrame:
    """The macro rows of a metric by K, its mean, and MAE and RPS at the reference K."""
    rows = macro.where(F.col("domain") == "macro")
    at = lambda m: F.max(F.when(F.col("k") == reference, F.col(m)))
    wide = rows.groupBy("method").pivot("k", list(grid)).agg(F.first(metric))
    wide = wide.select("method", *[F.col(str(k)).alias(f"{metric}_k{k}") for k in grid])
    rest = rows.groupBy("method").agg(F.avg(F.when(F.col("k").isin(*grid), F.col(metric))).alias("auac"), at("mae").alias("mae"), at("rps").alias("rps"))
    return wide.join(rest, "method")


def population_wasserstein(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distance of answer and predicted shares by question, averaged by its weight."""
    each = rows.select(*keys, "question_key", "survey_weight", "answer_index", F.posexplode("p").alias("i", "x"))
    sums = each.groupBy(*keys, "question_key", "i").agg(
        F.sum(F.when(F.col("answer_index") == F.col("i"), F.col("survey_weight")).otherwise(0.0)).alias("h"),
        F.sum(F.col("survey_weight") * F.col("x")).alias("q"),
        F.sum("survey_weight").alias("w"),
    )
    pair = sums.groupBy(*keys, "question_key").agg(F.array_sort(F.collect_list(F.struct("i", "h", "q"))).alias("s"), F.max("w").alias("w"))
    d = pair.select(*keys, "w", probs.wasserstein(probs.normalise(F.transform("s", lambda s: s["h"])), probs.normalise(F.transform("s", lambda s: s["q"]))).alias("d"))
    return d.groupBy(*keys).agg((F.sum(F.col("w") * F.col("d")) / F.sum("w")).alias("wasserstein"))


def headroom(summary: DataFrame, metric: str, floor: str, ceiling: str) -> DataFrame:
    """Share of the way from the method ``floor`` to the method ``ceiling``, in percent."""
    ends = summary.agg(F.max(F.when(F.col("method") == floor, F.col(metric))).alias("_f"), F.max(F.when(F.col("method") == ceiling, F.col(metric))).alias("_c"))
    # one row
    return summary.crossJoin(F.broadcast(ends)).withColumn("headroom_pct", 100 * F.try_divide(F.col("_f") - F.col(metric), F.col("_f") - F.col("_c"))).drop("_f", "_c")


def quantiles(df: DataFrame, column: str, at: list[float], keys: list[str]) -> DataFrame:
    """Exact linear quantiles by group."""
    return df.groupBy(*keys).agg(F.percentile(column, F.array(*[F.lit(x) for x in at])).alias("q"))


def entropy(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Shannon entropy in nats of a column's values by group; nulls are left out."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    return counts.withColumn("_p", share).groupBy(*keys).agg((-F.sum(F.col("_p") * F.log("_p"))).alias("entropy"), F.count(F.lit(1)).alias("n_values"))


def running_stats(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Count, mean and population variance."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("variance"))

"""Histograms, priors and predictors fitted on training rows (arrays of option probabilities)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.functions import probs

#: Back-off levels of the frequency predictor, finest first.
LEVELS = (("question_key", "country", "sex", "age_bin"), ("question_key", "country", "sex"), ("question_key", "country"), ("question_key",))


def only_train(rows: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Training respondents, and seen items or the given items."""
    rows = rows.where(F.col("split") == "train")
    return rows.where(~F.col("is_unseen_item")) if items is None else rows.join(items.select("question_key").distinct(), "question_key", "left_semi")


def require_train(rows: DataFrame) -> DataFrame:
    """Fails at run time on a row of another split."""
    wrong = F.when(F.col("split") != "train", F.raise_error(F.lit("only training rows may be fitted"))).otherwise(F.lit(True))
    return rows.where(wrong)


def histogram(rows: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """For each key: ``counts`` array over options (weighted, if asked) and ``n`` rows.

    One pass: counts are summed per option before the shuffle, so a hot key
    moves as many rows as it has options.
    """
    w = F.lit(1.0) if weight is None else weight
    cells = rows.groupBy(*keys, "answer_index").agg(F.sum(w).alias("w"), F.count(F.lit(1)).alias("c"), F.max("n_options").alias("n_options"))
    found = cells.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("answer_index", "w"))).alias("m"), F.sum("c").alias("n"), F.max("n_options").alias("n_options")
    )
    return found.select(*keys, F.transform(F.sequence(F.lit(0), F.col("n_options") - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("counts"), "n")


def frequency_tables(train: DataFrame, levels=LEVELS) -> dict[tuple[str, ...], DataFrame]:
    """Weighted histograms of each level; coarser ones are summed from the finest."""
    finest = train.groupBy(*levels[0], "answer_index").agg(F.sum("survey_weight").alias("w"), F.count(F.lit(1)).alias("c"), F.max("n_options").alias("n_options"))
    out = {}
    for level in levels:
        cells = finest.groupBy(*level, "answer_index").agg(F.sum("w").alias("w"), F.sum("c").alias("c"), F.max("n_options").alias("n_options"))
        # sums of doubles depend on their order: without it, equal weights are equal and ties go to the first option
        w = F.round("w", 9).alias("w")
        found = cells.groupBy(*level).agg(F.map_from_entries(F.collect_list(F.struct("answer_index", w))).alias("m"), F.sum("c").alias("n"), F.max("n_options").alias("o"))
        out[level] = found.select(*level, F.transform(F.sequence(F.lit(0), F.col("o") - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("counts"), "n")
    return out


def frequency_predict(rows: DataFrame, tables: dict[tuple[str, ...], DataFrame], alpha: float = 1.0, least: int = 25) -> DataFrame:
    """Adds ``p`` from the finest level of enough rows, then the question, then uniform."""
    found = []
    for i, (level, t) in enumerate(tables.items()):
        rows = rows.join(t.select(*level, F.col("counts").alias(f"_c{i}"), F.col("n").alias(f"_n{i}")), list(level), "left")
        cut = F.slice(F.col(f"_c{i}"), F.lit(1), F.col("n_options"))
        enough = F.col(f"_n{i}").isNotNull() if len(level) == 1 else F.col(f"_n{i}") >= least
        found.append(F.when(enough, probs.smooth(cut, alpha)))
    rows = rows.withColumn("p", F.coalesce(*found, probs.uniform(F.col("n_options"))))
    return rows.drop(*[f"_{x}{i}" for x in "cn" for i in range(len(tables))])


def population_prior(train: DataFrame, laplace: float = 0.5, shrinkage: float = 20.0) -> dict[str, DataFrame]:
    """Option shares by question, by question and country (shrunk by n / (n + shrinkage)), and by scale length."""
    question = histogram(train, ["question_key"]).select("question_key", probs.smooth(F.col("counts"), laplace).alias("pq"))
    country = histogram(train, ["question_key", "country"]).join(question, "question_key")
    weight = F.col("n") / (F.col("n") + shrinkage)
    own = F.transform(F.col("pq"), lambda _, i: F.coalesce(F.get(F.col("counts"), i), F.lit(0.0)))
    blended = F.zip_with(probs.smooth(own, laplace), F.col("pq"), lambda a, b: weight * a + (1 - weight) * b)
    country = country.select("question_key", "country", probs.normalise(blended).alias("pc"))
    position = histogram(train.withColumn("scale", F.col("n_options")), ["scale"]).select(F.col("scale").alias("n_options"), probs.smooth(F.col("counts"), laplace).alias("pp"))
    return {"question": question, "country": country, "position": position}


def prior_predict(rows: DataFrame, prior: dict[str, DataFrame], seen: Column) -> DataFrame:
    """Adds ``prior``: country, question, scale length, uniform; unseen items start at the scale length."""
    rows = rows.join(prior["country"], ["question_key", "country"], "left").join(prior["question"], "question_key", "left").join(prior["position"], "n_options", "left")
    cut = lambda p: probs.normalise(F.slice(p, F.lit(1), F.col("n_options")))
    own = F.when(seen, F.coalesce("pc", "pq"))
    return rows.withColumn("prior", F.coalesce(F.when(own.isNotNull(), cut(own)), F.when(F.col("pp").isNotNull(), cut(F.col("pp"))), probs.uniform(F.col("n_options")))).drop("pc", "pq", "pp")


def majority(train: DataFrame, key: str = "question_key") -> DataFrame:
    """The most frequent option of each key, the lowest on ties."""
    counts = train.groupBy(key, "answer_index").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.max_by("answer_index", F.struct("n", -F.col("answer_index"))).alias("majority"), F.sum("n").alias("n"))


def question_statistics(train: DataFrame) -> DataFrame:
    """E5: mean and deviation (0.25 for one row, at least 0.05) of normalised answers."""
    x = F.col("answer_index") / F.greatest(F.col("n_options") - 1, F.lit(1))
    return train.groupBy("question_key").agg(F.avg(x).alias("question_mean"), F.greatest(F.coalesce(F.stddev_samp(x), F.lit(0.25)), F.lit(0.05)).alias("question_std"))


def with_statistics(rows: DataFrame, train: DataFrame) -> DataFrame:
    """Joined statistics; items without any get 0.5 and 0.25."""
    out = rows.drop("question_mean", "question_std").join(question_statistics(train), "question_key", "left")
    return out.withColumn("question_mean", F.coalesce("question_mean", F.lit(0.5))).withColumn("question_std", F.coalesce("question_std", F.lit(0.25)))


def co_answers(rows: DataFrame, value: str = "answer_index") -> DataFrame:
    """Pairs of different items that a panel answered (t, h and both values).

    The join expands each panel by the items that it answered, so it grows with
    the panels, not with their square.
    """
    a = rows.select("domain", "panel_id", F.col("question_key").alias("t"), F.col(value).alias("t_value"))
    b = rows.select("domain", "panel_id", F.col("question_key").alias("h"), F.col(value).alias("h_value"))
    return a.join(b, ["domain", "panel_id"]).where(F.col("t") != F.col("h"))


def rank_correlation(cells: DataFrame, keys: list[str], x: str, y: str, n: str = "n") -> DataFrame:
    """rank correlation with ties at their mean, from counts ``n`` of value pairs: (keys, n, rho), null where a side is constant.

    Ranks follow from the counts of each value, so no window holds more rows
    than a key has value pairs.
    """
    def ranked(v: str, r: str) -> DataFrame:
        sums = cells.groupBy(*keys, v).agg(F.sum(n).alias("_c"))
        below = F.sum("_c").over(Window.partitionBy(*keys).orderBy(v).rowsBetween(Window.unboundedPreceding, -1))
        return sums.select(*keys, v, (F.coalesce(below, F.lit(0)) + (F.col("_c") + 1) / 2).alias(r))

    both = cells.join(ranked(x, "_rx"), [*keys, x]).join(ranked(y, "_ry"), [*keys, y])
    w = F.col(n)
    sums = both.groupBy(*keys).agg(
        F.sum(w).alias("n"), F.sum(w * F.col("_rx") * F.col("_ry")).alias("sxy"), F.sum(w * F.col("_rx") * F.col("_rx")).alias("sxx"), F.sum(w * F.col("_ry") * F.col("_ry")).alias("syy")
    )
    mean = (F.col("n") + 1) / 2  # of ranks, whatever the ties
    spread = lambda c: F.col(c) - F.col("n") * mean * mean
    return sums.select(*keys, "n", F.try_divide(spread("sxy"), F.sqrt(spread("sxx") * spread("syy"))).alias("rho"))


def item_graph(rows: DataFrame, shrinkage: float = 20.0, least: int = 10, value: str = "normalized_answer") -> DataFrame:
    """Rank correlation of item pairs over common panels, times n / (n + shrinkage); 0 below ``least`` panels."""
    cells = co_answers(rows, value).where(F.col("t") < F.col("h")).groupBy("domain", "t", "h", "t_value", "h_value").agg(F.count(F.lit(1)).alias("n"))
    found = rank_correlation(cells, ["domain", "t", "h"], "t_value", "h_value")
    c = F.when(F.col("n") >= least, F.coalesce(F.col("n") / (F.col("n") + shrinkage) * F.col("rho"), F.lit(0.0))).otherwise(0.0)
    return found.select("domain", F.col("t").alias("a"), F.col("h").alias("b"), "n", c.alias("c"))


def graph_lookup(asked: DataFrame, graph: DataFrame) -> DataFrame:
    """The edge of each pair (domain, a, b) in either order; pairs without an edge have 0."""
    both = graph.select("domain", "a", "b", "c").unionByName(graph.select("domain", F.col("b").alias("a"), F.col("a").alias("b"), "c"))
    return asked.join(both, ["domain", "a", "b"], "left").withColumn("c", F.coalesce("c", F.lit(0.0)))


def conditional_tables(train: DataFrame, shrinkage: float = 5.0, least: int = 20) -> DataFrame:
    """For each target, history item and history answer the option shares, shrunk to the target's own."""
    own = histogram(train, ["question_key"]).select(F.col("question_key").alias("t"), probs.smooth(F.col("counts"), 0.5).alias("marginal"))
    pairs = co_answers(train).groupBy("t", "h", "h_value", "t_value").agg(F.count(F.lit(1)).alias("c"))
    sizes = pairs.groupBy("t", "h").agg(F.sum("c").alias("n")).where(F.col("n") >= least)
    cells = pairs.groupBy("t", "h", "h_value").agg(F.map_from_entries(F.collect_list(F.struct("t_value", "c"))).alias("m"))
    scales = train.groupBy(F.col("question_key").alias("h")).agg(F.max("n_options").alias("n_hist"))
    full = sizes.join(scales, "h").select("t", "h", "n", F.explode(F.sequence(F.lit(0), F.col("n_hist") - 1)).alias("h_value"))
    full = full.join(cells, ["t", "h", "h_value"], "left").join(own, "t")
    shrunk = F.transform(F.col("marginal"), lambda x, i: F.coalesce(F.try_element_at("m", i), F.lit(0)) + F.lit(shrinkage) * x)
    return full.select("t", "h", "h_value", "n", probs.normalise(shrunk).alias("conditional"))


def conditional_predict(targets: DataFrame, history: DataFrame, tables: DataFrame, graph: DataFrame, scale: float = 1.0) -> DataFrame:
    """Tilts each target's ``prior`` by weighted log ratios of the conditionals of its history (row_id, h, h_value).

    Without history the prior stays.
    """
    both = graph.select("domain", F.col("a").alias("question_key"), F.col("b").alias("h"), "c").unionByName(graph.select("domain", F.col("b").alias("question_key"), F.col("a").alias("h"), "c"))
    known = targets.select("row_id", "domain", "question_key", "prior").join(history, "row_id")
    known = known.join(both, ["domain", "question_key", "h"]).join(tables.withColumnRenamed("t", "question_key"), ["question_key", "h", "h_value"])
    clip = lambda x: F.log(F.greatest(x, F.lit(probs.FLOOR)))
    step = F.zip_with("conditional", "prior", lambda c, p: F.lit(scale) * F.abs(F.col("c")) * (clip(c) - clip(p)))
    tilt = known.select("row_id", F.posexplode(step).alias("i", "x")).groupBy("row_id", "i").agg(F.sum("x").alias("x"))
    tilt = tilt.groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("tilt"))
    base = F.transform("prior", clip)
    return targets.join(tilt, "row_id", "left").withColumn("p", probs.softmax(F.when(F.col("tilt").isNull(), base).otherwise(F.zip_with(base, "tilt", lambda a, b: a + b)))).drop("tilt")


def position_prior(rows: DataFrame, demographics: list[str], alpha: float = 0.5, least: int = 25) -> tuple[DataFrame, DataFrame]:
    """Option shares by scale length, and by scale length and demographics where enough rows are."""
    own = histogram(rows.withColumn("scale", F.col("n_options")), ["scale", *demographics]).where(F.col("n") >= least)
    plain = histogram(rows.withColumn("scale", F.col("n_options")), ["scale"])
    return own.select("scale", *demographics, probs.smooth(F.col("counts"), alpha).alias("pd")), plain.select("scale", probs.smooth(F.col("counts"), alpha).alias("ps"))


def mutual_information(pairs: DataFrame, source: str = "s", target: str = "t", x: str = "x", y: str = "y") -> DataFrame:
    """Information of each source about each target over the target's entropy; nulls are a value of their own."""
    cells = pairs.select(source, target, F.coalesce(x, F.lit(-999)).alias("x"), F.coalesce(y, F.lit(-999)).alias("y")).groupBy(source, target, "x", "y").agg(F.count(F.lit(1)).alias("n"))
    w = lambda *c: Window.partitionBy(source, target, *c)
    n, nx, ny = (F.sum("n").over(w(*c)) for c in ((), ("x",), ("y",)))
    cells = cells.select(source, target, "n", n.alias("all"), nx.alias("nx"), ny.alias("ny"), "y")
    share = F.col("n") / F.col("all")
    info = F.sum(share * F.log(F.col("n") * F.col("all") / (F.col("nx") * F.col("ny"))))
    entropy = -F.sum(share * F.log(F.col("ny") / F.col("all")))
    return cells.groupBy(source, target).agg(F.coalesce(F.try_divide(info, entropy), F.lit(0.0)).alias("score"))


def persona_tables(rows: DataFrame, alpha: float = 0.5, cluster: str = "cluster") -> DataFrame:
    """Smoothed option shares by cluster and question."""
    return histogram(rows, [cluster, "question_key"]).select(cluster, "question_key", probs.smooth(F.col("counts"), alpha).alias("p"))


def persona_posterior(prior: DataFrame, history: DataFrame, tables: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Each panel's share of every cluster after its history (panel_id, question_key, answer_index)."""
    seen = history.join(tables, "question_key").select("panel_id", cluster, F.log(F.greatest(probs.at(F.col("p"), F.col("answer_index")), F.lit(probs.FLOOR))).alias("x"))
    seen = seen.groupBy("panel_id", cluster).agg(F.sum("x").alias("x"))
    scored = prior.join(seen, ["panel_id", cluster], "left").withColumn("z", F.log(F.greatest("prior", F.lit(probs.FLOOR))) + F.coalesce("x", F.lit(0.0)))
    w = Window.partitionBy("panel_id")
    scored = scored.withColumn("e", F.exp(F.col("z") - F.max("z").over(w)))
    return scored.select("panel_id", cluster, (F.col("e") / F.sum("e").over(w)).alias("posterior"))

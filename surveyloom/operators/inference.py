"""Resampling: paired and crossed bootstraps, by replicate in parallel."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.operators.gather import added, gathered
from surveyloom.operators.joins import paired
from surveyloom.operators.ranking import holm
from surveyloom.sources.scratch import written


#: Cumulative Poisson(1) probabilities of 0 to 8 draws.
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253, 0.999998874797402]


def _poisson(seed: int, *parts: Column) -> Column:
    """A Poisson(1) number from the digest of ``seed|part|part...``: the multiplicity of a unit in a replicate."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") + 0.5) / float(1 << 52)
    out = F.lit(0)
    for c in POISSON:
        out = out + (u > c).cast("int")
    return out


def _all_draws(seed: int, replicates: int, *parts: Column) -> Column:
    """The multiplicities of a unit in all replicates, one byte each."""
    digest = lambda r: F.md5(F.concat_ws("|", F.lit(str(seed)), r.cast("string"), *[p.cast("string") for p in parts]))
    u = F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), lambda r: (F.conv(F.substring(digest(r), 1, 13), 16, 10).cast("bigint").cast("double") + 0.5) / float(1 << 52))
    # the first bound above u, counted from 0; a second transform, so that u is computed once
    return F.transform(u, lambda x: F.size(F.filter(F.array(*[F.lit(c) for c in POISSON]), lambda c: c < x)).cast("tinyint"))


def _draws_of(seed: int, replicates: int, units: list[str]) -> np.ndarray:
    """The same for a block of units (their parts joined by bars), units x replicates: the first 52 bits of each digest against the bounds."""
    starts = [f"{seed}|{r}|".encode() for r in range(replicates)]
    out = np.empty((len(units), replicates), np.int8)
    for i, unit in enumerate(units):
        end = unit.encode()
        digests = np.frombuffer(b"".join([hashlib.md5(x + end, usedforsecurity=False).digest() for x in starts]), ">u8")[::2]
        out[i] = np.searchsorted(POISSON, ((digests >> np.uint64(12)).astype(float) + 0.5) / float(1 << 52), "left")
    return out


def bootstrap(cells: DataFrame, value: str, unit: str, strata: list[str], keys: list[str], replicates: int = 2000, seed: int = 1701, pooled: bool = False) -> DataFrame:
    """Observed mean, 95 % interval and p of a value, resampling units within strata.

    Units are drawn by Poisson multiplicities, the form of the bootstrap that
    needs no count of units and is summed in one pass. ``pooled`` weighs all
    units alike; otherwise the mean of the strata's means is taken.
    """
    per_unit = cells.groupBy(*keys, *strata, unit).agg(F.avg(value).alias("x"))
    draws = per_unit.select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    w = _poisson(seed, F.col("rep"), F.col(unit), *[F.col(s) for s in strata])
    sums = draws.groupBy(*keys, *strata, "rep").agg(F.sum(w * F.col("x")).alias("sx"), F.sum(w).alias("sw"))
    if pooled:
        stat = sums.groupBy(*keys, "rep").agg(F.try_divide(F.sum("sx"), F.sum("sw")).alias("d"))
        seen = per_unit.groupBy(*keys).agg(F.avg("x").alias("difference"), F.count(F.lit(1)).alias("n_units"))
    else:
        stat = sums.groupBy(*keys, "rep").agg(F.avg(F.try_divide(F.col("sx"), F.col("sw"))).alias("d"))
        seen = per_unit.groupBy(*keys, *strata).agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.avg("x").alias("difference"), F.sum("n").alias("n_units"))
    return _summary(stat, seen, keys)


def drawn_means(rows: DataFrame, unit: str, values: str, entries: int, replicates: int = 2000, seed: int = 1701) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of units, the means of the entries of the array ``values`` (a row a unit), and those means in each replicate (entries x replicates).

    All entries are under the same Poisson draws, so they may be compared within
    a replicate. A task draws for 200 units at a time and returns a sum for each
    entry and replicate; a replicate without units is NaN.
    """
    spark = rows.sparkSession

    def fold(state, batch):
        units = batch.column(0).to_pylist()
        x = pc.list_flatten(batch.column(1)).to_numpy(zero_copy_only=False).reshape(len(batch), entries)
        for at in range(0, len(batch), 200):
            part, w = x[at : at + 200], _draws_of(seed, replicates, units[at : at + 200]).astype(float)
            state = added(state, (len(part), part.sum(axis=0), part.T @ w, w.sum(axis=0)))
        return state

    each = rows.select(F.col(unit).cast("string").alias("unit"), F.col(values).cast("array<double>").alias("x"))
    found = gathered(each.repartition(2 * spark.sparkContext.defaultParallelism), fold)
    n, total, sums, weights = found or (0, np.zeros(entries), np.zeros((entries, replicates)), np.zeros(replicates))
    return n, total / max(n, 1), np.divide(sums, weights, out=np.full(sums.shape, np.nan), where=weights > 0)


def cluster_bootstrap(rows: DataFrame, value: str, cluster: str, keys: list[str], replicates: int = 2000, seed: int = 1701) -> DataFrame:
    """Observed mean of all rows, interval and p, drawing whole clusters; a cluster weighs as many rows as it has.

    Clusters are summed before they are drawn, so a replicate costs one number for each cluster.
    """
    per = rows.groupBy(*keys, cluster).agg(F.sum(value).alias("x"), F.count(value).alias("size"))
    draws = per.select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    w = _poisson(seed, F.col("rep"), F.col(cluster))
    stat = draws.groupBy(*keys, "rep").agg(F.try_divide(F.sum(w * F.col("x")), F.sum(w * F.col("size"))).alias("d"))
    seen = per.groupBy(*keys).agg((F.sum("x") / F.sum("size")).alias("difference"), F.count(F.lit(1)).alias("n_units"))
    return _summary(stat, seen, keys)


def _summary(stat: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Interval and two-sided p with the plus-one correction."""
    n = F.count("d")
    side = lambda c: (F.sum(c.cast("int")) + 1) / (n + 1)
    out = stat.groupBy(*keys).agg(
        F.percentile("d", F.array(F.lit(0.025), F.lit(0.975))).alias("ci"),
        F.least(F.lit(1.0), 2 * F.least(side(F.col("d") <= 0), side(F.col("d") >= 0))).alias("p_two_sided"),
    )
    joined = seen.join(out, keys) if keys else seen.crossJoin(out)  # without keys both have one row
    return joined.withColumn("ci_low", F.col("ci")[0]).withColumn("ci_high", F.col("ci")[1]).drop("ci")


def paired_bootstrap(rows: DataFrame, method: str, reference: str, metric: str, replicates: int = 2000, seed: int = 1701) -> DataFrame:
    """Both methods on common (domain, panel) cells; fails on rows of several item pools."""
    if "item_pool" in rows.columns and rows.select("item_pool").distinct().limit(2).count() > 1:
        raise ValueError("rows span several item pools")
    cells = paired(rows, method, reference, metric, ["domain", "panel_id"])
    if not cells.limit(1).count():
        raise ValueError("the methods have no panel in common")
    return bootstrap(cells, "difference", "panel_id", ["domain"], [], replicates, seed).select(F.lit(method).alias("method"), F.lit(reference).alias("reference"), F.lit(metric).alias("metric"), "*")


def _crossed_by_products(cells: DataFrame, replicates: int, seed: int, items: list) -> DataFrame:
    """Replicates of a crossed bootstrap (rep, d): one product of a block of respondents' cells with the items' draws (``items``: domain, question_key, by_item)."""
    spark = cells.sparkSession
    place = {(r["domain"], r["question_key"]): i for i, r in enumerate(items)}
    draws = np.array([r["by_item"] for r in items], np.float64)
    numbers = spark.createDataFrame([(*k, i) for k, i in place.items()], "domain string, question_key string, item int")
    panels = cells.join(numbers, ["domain", "question_key"]).groupBy("domain", "panel_id").agg(F.collect_list(F.struct("item", "difference")).alias("c"))
    unit = F.concat_ws("|", F.col("panel_id").cast("string"), F.col("domain").cast("string"))
    rows = panels.select("domain", F.col("c.item").alias("item"), F.col("c.difference").alias("x"), unit.alias("unit"))

    def fold(state, batch):
        state = {} if state is None else state
        domains, units = batch.column(0).to_pylist(), batch.column(3).to_pylist()
        for at in range(0, len(batch), 200):
            part = batch.slice(at, 200)
            item, x = (pc.list_flatten(part.column(k)).to_numpy() for k in (1, 2))
            who = pc.list_parent_indices(part.column(1)).to_numpy()
            weights = _draws_of(seed, replicates, units[at : at + 200])
            mine = np.array(domains[at : at + 200], object)
            for domain in sorted(set(mine)):
                panel = np.flatnonzero(mine == domain)
                cell = np.flatnonzero(np.isin(who, panel))
                used, column = np.unique(item[cell], return_inverse=True)
                both = np.zeros((2, len(panel), len(used)))
                place = np.searchsorted(panel, who[cell]), column
                np.add.at(both[0], place, x[cell])
                np.add.at(both[1], place, 1.0)
                sums = np.einsum("kpr,pr->kr", both @ draws[used], weights[panel].astype(float))
                state[domain] = state[domain] + sums if domain in state else sums
        return state

    found = gathered(rows, fold) or {}
    each = np.array([np.divide(x, n, out=np.full(len(x), np.nan), where=n > 0) for x, n in found.values()]).reshape(-1, replicates)
    known = ~np.isnan(each)
    mean = np.where(known, each, 0.0).sum(axis=0) / np.maximum(known.sum(axis=0), 1)
    return spark.createDataFrame([(r, float(m) if k else None) for r, (m, k) in enumerate(zip(mean, known.any(axis=0), strict=True))], "rep int, d double")


def _crossed_by_joins(cells: DataFrame, replicates: int, seed: int) -> DataFrame:
    """The same for more items than a task should hold: a row a cell and replicate."""
    panels = cells.groupBy("domain", "panel_id").agg(F.collect_list(F.struct("question_key", "difference")).alias("cells"))
    panels = panels.withColumn("by_panel", _all_draws(seed, replicates, F.col("panel_id"), F.col("domain")))
    items = cells.select("domain", "question_key").distinct().withColumn("by_item", _all_draws(seed + 1, replicates, F.col("question_key"), F.col("domain")))
    both = panels.select("domain", "by_panel", F.inline("cells")).join(items, ["domain", "question_key"])
    draws = both.select("domain", "difference", "by_item", F.posexplode("by_panel").alias("rep", "n"))
    w = F.col("n").cast("bigint") * F.get("by_item", F.col("rep"))
    sums = draws.groupBy("domain", "rep").agg(F.try_divide(F.sum(w * F.col("difference")), F.sum(w)).alias("d"))
    return sums.groupBy("rep").agg(F.avg("d").alias("d"))


def crossed_bootstrap(rows: DataFrame, method: str, reference: str, metric: str = "nll", replicates: int = 2000, seed: int = 1701, most_items: int = 20_000) -> DataFrame:
    """Respondents and items drawn at once, both with multiplicity; missing cells have no weight.

    Multiplicities are drawn once for each respondent and item. Up to
    ``most_items`` items, their draws (a byte a replicate) travel with the
    function, and a task returns two sums a domain and replicate. A
    respondent's cells are gathered (at most as many as there are items).
    """
    cells = written(paired(rows, method, reference, metric, ["domain", "panel_id", "question_key"]), "cells")
    items = cells.select("domain", "question_key").distinct().withColumn("by_item", _all_draws(seed + 1, replicates, F.col("question_key"), F.col("domain")))
    found = items.limit(most_items + 1).collect()
    stat = _crossed_by_products(cells, replicates, seed, found) if len(found) <= most_items else _crossed_by_joins(cells, replicates, seed)
    seen = cells.groupBy("domain").agg(F.avg("difference").alias("x")).agg(F.avg("x").alias("difference"))
    sizes = cells.agg(F.countDistinct("panel_id").alias("n_panels"), F.countDistinct("question_key").alias("n_items"))
    out = _summary(stat, seen.crossJoin(sizes), [])  # one row each
    favors = F.col("difference") > 0 if metric == "correct" else F.col("difference") < 0
    return out.select(F.lit(method).alias("method"), F.lit(reference).alias("reference"), F.lit(metric).alias("metric"), "*", favors.alias("favors_candidate"))


def primary_family(rows: DataFrame, method: str, comparators: list[str], metric: str = "nll", effect: float = 0.02, replicates: int = 2000, seed: int = 1701) -> DataFrame:
    """Crossed bootstrap against each comparator, step-down correction, practical effect and claim."""
    out = None
    for c in comparators:
        one = crossed_bootstrap(rows, method, c, metric, replicates, seed)
        out = one if out is None else out.unionByName(one)
    out = holm(out.withColumnRenamed("p_two_sided", "p_value"))
    practical = F.col("difference") <= -effect
    return out.withColumn("practical_effect", practical).withColumn("primary_claim_supported", F.col("reject_null") & practical & (F.col("ci_high") < 0))


def exact_bootstrap(cells: DataFrame, value: str, unit: str, strata: list[str], keys: list[str], replicates: int = 2000, seed: int = 1701) -> DataFrame:
    """J1, J6 with numpy's generator, for panels that fit one task: units in order, each stratum drawn with replacement."""
    per_unit = cells.groupBy(*keys, *strata, unit).agg(F.avg(value).alias("x"), F.count(F.lit(1)).cast("double").alias("size"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed)
        pdf = pdf.sort_values([*strata, unit])
        groups = [g["x"].to_numpy() for _, g in pdf.groupby(strata)] if strata else [pdf["x"].to_numpy()]
        draws = np.array([np.mean([rng.choice(v, size=len(v), replace=True).mean() for v in groups]) for _ in range(replicates)])
        low, high = np.quantile(draws, [0.025, 0.975])
        p = min(1.0, 2 * min((np.sum(draws <= 0) + 1) / (replicates + 1), (np.sum(draws >= 0) + 1) / (replicates + 1)))
        row = {k: pdf[k].iloc[0] for k in keys} | {"difference": float(np.mean([v.mean() for v in groups])), "ci_low": low, "ci_high": high, "p_two_sided": p, "n_units": len(pdf)}
        return pd.DataFrame([row])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in per_unit.schema if f.name in keys)
    return per_unit.groupBy(*keys).applyInPandas(run, f"{fields}{', ' if fields else ''}difference double, ci_low double, ci_high double, p_two_sided double, n_units bigint")


def gates(comparisons: DataFrame, required: Column) -> DataFrame:
    """Whether all required comparisons are supported, and how many are."""
    return comparisons.where(required).agg(F.min(F.col("primary_claim_supported").cast("int")).alias("all_"), F.sum(F.col("primary_claim_supported").cast("int")).alias("n_supported"), F.count(F.lit(1)).alias("n_required")).select(
        (F.col("all_") == 1).alias("gate_supported"), "n_supported", "n_required"
    )


def position_means(rows: DataFrame, keys: list[str], values: str) -> DataFrame:
    """Mean of an array by position."""
    each = rows.select(*keys, F.posexplode(values).alias("position", "x"))
    return each.groupBy(*keys, "position").agg(F.avg("x").alias("mean"), F.count(F.lit(1)).alias("n"))



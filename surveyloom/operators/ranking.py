"""Ranking, caps, histories and other ordered operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.functions import hashing


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """the first ``n`` rows of each group; the order must be total."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def top_items(rows: DataFrame, n: int, group: str = "domain", item: str = "question_key", unit: str = "panel_id", ignore: str | None = None) -> DataFrame:
    """the items of most units in each group, ties by name."""
    rows = rows if ignore is None else rows.where(F.col(item) != ignore)
    sizes = rows.groupBy(group, item).agg(F.countDistinct(unit).alias("n_panels"))
    return top_n(sizes, [group], [F.desc("n_panels"), F.asc(item)], n)


def hash_cap(units: DataFrame, by: list[str], n: int, seed: int, tag: str, unit: str = "panel_id") -> DataFrame:
    """the first ``n`` units of each group by hash."""
    return top_n(units, by, [hashing.stable_hex(seed, tag, F.col(unit))], n)


def curated(rows: DataFrame, items: int, countries: int, cap: int, least: int, seed: int) -> DataFrame:
    """C4: rows of top items and countries, capped panels, panels with enough answers left."""
    rows = rows.join(top_items(rows, items).select("question_key"), "question_key", "left_semi")
    rows = rows.join(top_items(rows, countries, item="country", ignore="Missing").select("domain", "country"), ["domain", "country"], "left_semi")
    panels = hash_cap(rows.select("panel_id", "domain", "country").distinct(), ["domain", "country"], cap, seed, "cap")
    rows = rows.join(panels.select("panel_id"), "panel_id", "left_semi")
    enough = rows.groupBy("panel_id").agg(F.countDistinct("question_key").alias("n")).where(F.col("n") >= least)
    return rows.join(enough.select("panel_id"), "panel_id", "left_semi")


def item_holdout(rows: DataFrame, fraction: float, seed: int, group: str = "domain", item: str = "question_key") -> DataFrame:
    """marks the first round(fraction n) items of each group by hash as unseen, at least 1, at most n - 1."""
    if not 0 <= fraction < 1:
        raise ValueError("fraction must be in [0, 1)")
    if fraction == 0:
        return rows.withColumn("is_unseen_item", F.lit(False))
    items = rows.select(group, item).distinct()
    w = Window.partitionBy(group)
    rank = F.row_number().over(w.orderBy(hashing.stable_hex(seed, "item_holdout", F.col(item))))
    n = F.count(F.lit(1)).over(w)
    marked = items.select(item, group, (rank <= F.least(n - 1, F.greatest(F.lit(1.0), F.rint(n * F.lit(fraction))))).alias("is_unseen_item"))
    # as many rows as items; the size is known only at run time, so the join is left to the optimiser
    return rows.join(marked, [group, item]).select(*rows.columns, "is_unseen_item")


def cell_holdout(panels: DataFrame, attributes: list[str], fraction: float, least: int, seed: int) -> DataFrame:
    """panels of held-out demographic cells get ``is_ood_intersection``."""
    panels = panels.withColumn("cell", F.concat_ws("|", *attributes))
    cells = panels.groupBy("domain", "cell").agg(F.countDistinct("panel_id").alias("size")).where(F.col("size") >= least)
    w = Window.partitionBy("domain")
    rank = F.row_number().over(w.orderBy(hashing.stable_hex(seed, "intersection_holdout", F.col("domain"), F.col("cell"))))
    n = F.count(F.lit(1)).over(w)
    held = cells.select("domain", "cell", rank.alias("rank"), n.alias("n")).where(F.col("rank") <= F.greatest(F.lit(1.0), F.rint(F.col("n") * fraction)))
    held = held.select("domain", "cell", F.lit(True).alias("is_ood_intersection"))
    return panels.join(held, ["domain", "cell"], "left").withColumn("is_ood_intersection", F.coalesce("is_ood_intersection", F.lit(False)))


def calibration_orders(rows: DataFrame, seeds: list[int]) -> DataFrame:
    """for each panel and seed, its seen questions in hash order."""
    seen = rows.where(~F.col("is_unseen_item"))
    each = seen.select("panel_id", "question_id", F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"))
    payload = F.concat(F.lit("["), F.col("seed").cast("string"), F.lit(', "'), F.col("panel_id"), F.lit('", "'), F.col("question_id"), F.lit('"]'))
    hashed = each.select("panel_id", "seed", F.struct(F.substring(F.sha2(payload, 256), 1, 16).alias("h"), F.col("question_id").alias("q")).alias("x"))
    return hashed.groupBy("panel_id", "seed").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["q"]).alias("ordered_question_ids"))


def history_first_k(order: Column, target: Column, k: int) -> Column:
    """The first ``k`` of an order without the target."""
    return F.slice(F.filter(order, lambda q: q != target), 1, k)


def stable_history(panel: Column, calibration: Column, k: int, seed: int) -> Column:
    """F8: calibration items by the digest of ``seed|panel|item``, cut to ``k`` before answers are joined."""
    keyed = F.transform(calibration, lambda q: F.struct(F.sha2(F.concat_ws("|", F.lit(str(seed)), panel, q), 256).alias("h"), q.alias("q")))
    return F.slice(F.transform(F.array_sort(keyed), lambda x: x["q"]), 1, k)


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in the given order."""
    return top_n(df, keys, [c.desc() for c in order], 1)


def holm(tests: DataFrame, alpha: float = 0.05, p: str = "p_value", by: list[str] | None = None) -> DataFrame:
    """step-down thresholds; rejected only while all smaller p-values are."""
    by = by or []
    keys = [F.col(c) for c in by] or [F.lit(1)]
    w = Window.partitionBy(*keys)
    ordered = w.orderBy(p, *[c for c in tests.columns if c != p])
    out = tests.withColumn("_rank", F.row_number().over(ordered) - 1).withColumn("_m", F.count(F.lit(1)).over(w))
    out = out.withColumn("holm_threshold", F.lit(alpha) / (F.col("_m") - F.col("_rank")))
    ok = (F.col(p) <= F.col("holm_threshold")).cast("int")
    return out.withColumn("reject_null", F.min(ok).over(ordered.rowsBetween(Window.unboundedPreceding, 0)) == 1).drop("_rank", "_m")


def round_robin(items: DataFrame, n_folds: int, seed: int, pool_fraction: float, pool_cap: int, group: str = "domain", item: str = "question_key") -> DataFrame:
    """F16, K3: a calibration pool (fold null) and ``n_folds`` target folds per group, in hash order."""
    if n_folds < 3:
        raise ValueError("at least three folds are needed for train, validation and test")
    w = Window.partitionBy(group)
    rank = F.row_number().over(w.orderBy(hashing.stable_hex(seed, "item_folds", F.col(item)))) - 1
    n = F.count(F.lit(1)).over(w)
    ranked = items.select(group, item).distinct().select(group, item, rank.alias("r"), n.alias("n"))
    pool = F.least(F.lit(pool_cap), F.greatest(F.lit(1), F.rint(F.col("n") * F.lit(pool_fraction)).cast("int")))
    pool = F.least(pool, F.col("n") - n_folds)
    return ranked.select(group, item, F.when(F.col("r") >= pool, F.pmod(F.col("r") - pool, F.lit(n_folds)).cast("int")).alias("fold"))


def fold_role(fold: Column, outer: Column, n_folds: int) -> Column:
    """test, validation (the next fold) or train; the pool is calibration."""
    return (
        F.when(fold.isNull(), "calibration").when(fold == outer, "test").when(fold == F.pmod(outer + 1, F.lit(n_folds)), "validation").otherwise("train")
    )


def average_rank(column: str, by: list[str]) -> Column:
    """ranks with ties at their mean."""
    return F.rank().over(Window.partitionBy(*by).orderBy(column)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, column)) - 1) / 2


def one_per_family(items: DataFrame, family: str, order: list[Column], n: int) -> DataFrame:
    """the best item of each family, then the best ``n`` of all."""
    return top_n(items, [family], order, 1).orderBy(*order).limit(n)


def family_balanced(items: DataFrame, k: int, seed: int, family: str = "family", item: str = "item") -> DataFrame:
    """``k`` items in hash order, one of each family before any second."""
    h = hashing.seeded_digest(seed, F.col(item))
    turn = F.row_number().over(Window.partitionBy(family).orderBy(h, item))
    return items.withColumn("_turn", turn).withColumn("_h", h).orderBy("_turn", "_h", item).limit(k).drop("_turn", "_h")


def exact_sample(df: DataFrame, by: list[str], n: int, seed: int, unit: str) -> DataFrame:
    """Exactly ``n`` rows of each group (all, if fewer), by hash."""
    return top_n(df, by, [hashing.seeded_digest(seed, F.col(unit)), F.col(unit)], n)


def greedy_cover(scores: DataFrame, k: int) -> list[tuple[str, float]]:
    """``k`` items (item, target, score) that raise the sum over targets of the best score most, ties by name.

    One aggregate per step; only the chosen item of a step reaches the driver.
    """
    chosen: list[tuple[str, float]] = []
    left, best = scores, scores.select("target").distinct().withColumn("best", F.lit(0.0))
    for _ in range(k):
        gains = left.join(best, "target").groupBy("item").agg(F.sum(F.greatest(F.col("score") - F.col("best"), F.lit(0.0))).alias("gain"))
        top = gains.orderBy(F.desc(F.round("gain", 12)), "item").limit(1).collect()
        if not top:
            break
        item = top[0]["item"]
        chosen.append((item, float(top[0]["gain"])))
        mine = scores.where(F.col("item") == item).select("target", "score")
        best = best.join(mine, "target", "left").select("target", F.greatest("best", F.coalesce("score", F.lit(0.0))).alias("best"))
        left = left.where(F.col("item") != item)
    return chosen

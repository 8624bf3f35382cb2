"""Splits, folds, evaluation units and leakage checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.functions import hashing
from surveyloom.operators.ranking import fold_role

STRATA = (["domain", "country", "sex", "age_bin"], ["domain", "country", "sex"], ["domain", "country"], ["domain"])


def collapsed_strata(panels: DataFrame, least: int = 5, strata=STRATA) -> DataFrame:
    """K1: each panel's finest stratum with ``least`` members among panels that no finer one holds; the domain at last."""
    out = panels.withColumn("stratum", F.lit(None).cast("string"))
    for columns in strata:
        label = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("Missing")) for c in columns])
        out = out.withColumn("_label", label)
        open_ = F.col("stratum").isNull()
        n = F.sum(open_.cast("int")).over(Window.partitionBy("_label"))
        out = out.withColumn("stratum", F.when(open_ & (n >= least), F.col("_label")).otherwise(F.col("stratum")))
    return out.withColumn("stratum", F.coalesce("stratum", "domain")).drop("_label")


def stratified_split(panels: DataFrame, ratios: tuple[float, float, float] = (0.7, 0.1, 0.2), seed: int = 1701) -> DataFrame:
    """K2: train, validation and test in proportion within each stratum, by hash; held-out cells apart."""
    w = Window.partitionBy("stratum", "is_ood_intersection").orderBy(hashing.stable_hex(seed, "split", F.col("panel_id")), "panel_id")
    share = (F.row_number().over(w) - 0.5) / F.count(F.lit(1)).over(Window.partitionBy("stratum", "is_ood_intersection"))
    split = F.when(F.col("is_ood_intersection"), "ood_intersection").when(share <= ratios[0], "train").when(share <= ratios[0] + ratios[1], "validation").otherwise("test")
    return panels.withColumn("split", split)


def _units(rows: DataFrame, protocol: str, pool: Column, extra: list[Column]) -> DataFrame:
    return rows.select(F.lit(protocol).alias("protocol"), "panel_id", "domain", "question_key", "question_id", "answer_index", "n_options", pool.alias("item_pool"), F.array_sort("eligible").alias("eligible_source_keys"), *extra)


def _with_own(rows: DataFrame, source: DataFrame) -> DataFrame:
    """Each row with the other items that its panel answered in ``source``."""
    own = source.groupBy("panel_id").agg(F.collect_set("question_key").alias("answered"))
    out = rows.join(own, "panel_id", "left")
    return out.withColumn("eligible", F.array_except(F.coalesce("answered", F.array().cast("array<string>")), F.array("question_key")))


def protocol_a(rows: DataFrame, split: str) -> DataFrame:
    """K4: seen items of a split with the panel's other seen items."""
    mine = rows.where((F.col("split") == split) & ~F.col("is_unseen_item"))
    return _units(_with_own(mine, mine), "A", F.lit("seen"), [])


def protocol_b(rows: DataFrame, folds: DataFrame, split: str, outer: int, n_folds: int, role: str = "test") -> DataFrame:
    """K5: items of a role in an outer fold; history from the calibration pool. ``folds``: domain, question_key, fold (null: pool)."""
    mine = rows.where(F.col("split") == split)
    roles = folds.select("domain", "question_key", fold_role(F.col("fold"), F.lit(outer), n_folds).alias("role"))
    targets = mine.join(roles.where(F.col("role") == role).drop("role"), ["domain", "question_key"], "left_semi")
    pool = mine.join(roles.where(F.col("role") == "calibration"), ["domain", "question_key"], "left_semi")
    return _units(_with_own(targets, pool), "B", F.lit("seen" if role == "train" else "unseen"), [F.lit(outer).alias("fold"), F.lit(role).alias("target_role")])


def protocol_b_candidates(rows: DataFrame, folds: DataFrame, split: str) -> DataFrame:
    """K6: target items of all folds."""
    mine = rows.where(F.col("split") == split)
    targets = mine.join(folds.where("fold is not null").select("domain", "question_key", "fold"), ["domain", "question_key"])
    pool = mine.join(folds.where("fold is null"), ["domain", "question_key"], "left_semi")
    return _units(_with_own(targets, pool), "B", F.lit("unseen"), [F.col("fold")])


def protocol_c(rows: DataFrame, held_out: str, split: str) -> DataFrame:
    """K7: the units of one domain, which training leaves out."""
    return protocol_a(rows.where(F.col("domain") == held_out), split).withColumn("protocol", F.lit("C"))


def protocol_d(rows: DataFrame, split: str = "ood_intersection") -> DataFrame:
    """K8: the units of held-out demographic cells."""
    if split != "ood_intersection":
        raise ValueError("protocol D is defined on the split ood_intersection")
    return protocol_a(rows, split).withColumn("protocol", F.lit("D"))


def respondent_units(rows: DataFrame, folds: DataFrame, split: str) -> DataFrame:
    """K9: one per panel and domain, with its answered calibration items."""
    mine = rows.where(F.col("split") == split)
    pool = mine.join(folds.where("fold is null"), ["domain", "question_key"], "left_semi").groupBy("panel_id", "domain").agg(F.collect_set("question_key").alias("e"))
    units = mine.select("panel_id", "domain").distinct().join(pool, ["panel_id", "domain"], "left")
    return units.select("panel_id", "domain", F.array_sort(F.coalesce("e", F.array().cast("array<string>"))).alias("eligible_source_keys"))


def leakage(rows: DataFrame, orders: DataFrame) -> DataFrame:
    """Violations by kind; all zero where nothing leaks."""
    splits = rows.groupBy("panel_id").agg(F.countDistinct("split").alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("panels in several splits").alias("kind"), "n")
    twice = rows.groupBy("row_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("repeated rows").alias("kind"), "n")
    unseen = rows.where("is_unseen_item").select("domain", "question_id").distinct()
    listed = orders.join(rows.select("panel_id", "domain").distinct(), "panel_id").select("domain", F.explode("ordered_question_ids").alias("question_id"))
    held = listed.join(unseen, ["domain", "question_id"], "left_semi").agg(F.count(F.lit(1)).alias("n")).select(F.lit("unseen items in orders").alias("kind"), "n")
    return splits.unionByName(twice).unionByName(held)


def unit_faults(units: DataFrame) -> DataFrame:
    """Units whose target is among their own sources."""
    return units.where(F.array_contains("eligible_source_keys", F.col("question_key")))


def fold_faults(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Items tested in more than one outer fold."""
    return rows.groupBy(*keys).agg(F.countDistinct("fold").alias("n")).where("n > 1")


def target_rows(rows: DataFrame, orders: DataFrame, split: str, k: int, pool: str = "seen") -> DataFrame:
    """The rows of a split and item pool that are not among their panel's first ``k`` calibration items."""
    mine = rows.where(F.col("split") == split)
    if pool != "all":
        mine = mine.where(F.col("is_unseen_item") if pool == "unseen" else ~F.col("is_unseen_item"))
    used = orders.select("panel_id", F.explode(F.slice("ordered_question_ids", 1, k)).alias("question_id")) if k else None
    return mine if used is None else mine.join(used, ["panel_id", "question_id"], "left_anti")

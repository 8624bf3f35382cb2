"""Pairing, matching and donor joins, and checks of key contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.functions import hashing, probs
from surveyloom.operators.metrics import pearson
from surveyloom.operators.ranking import average_rank


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df``; the job fails on a repeated key."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    ok = F.when(n > 1, F.raise_error(F.concat(F.lit(f"repeated key {', '.join(keys)}: "), F.concat_ws("|", *keys)))).otherwise(F.lit(True))
    return df.withColumn("_ok", ok).where("_ok").drop("_ok")


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """D6, D8"""
    return require_unique(left, keys).join(require_unique(right, keys), keys, how)


def alignment_faults(left: DataFrame, right: DataFrame, key: str = "row_id", metadata: tuple[str, ...] = ("panel_id", "question_key", "answer_index", "n_options")) -> DataFrame:
    """Keys that only one side has, or whose metadata differ; empty if the sides are aligned."""
    a = left.select(key, F.struct(*metadata).alias("ma"))
    b = right.select(key, F.struct(*metadata).alias("mb"))
    both = a.join(b, key, "full_outer")
    fault = F.when(F.col("ma").isNull(), "missing left").when(F.col("mb").isNull(), "missing right").when(~F.col("ma").eqNullSafe(F.col("mb")), "metadata differ")
    return both.select(key, fault.alias("fault")).where("fault is not null")


def strict_align(left: DataFrame, right: DataFrame, key: str = "row_id", metadata: tuple[str, ...] = ("panel_id", "question_key", "answer_index", "n_options")) -> DataFrame:
    """The one-to-one join; fails if keys or metadata differ. Other columns of the right side get ``_right``."""
    if alignment_faults(left, right, key, metadata).limit(1).count():
        raise ValueError("the sides differ in keys or metadata")
    rest = [c for c in right.columns if c != key and c not in metadata]
    return one_to_one(left, right.select(key, *[F.col(c).alias(f"{c}_right") for c in rest]), [key])


def paired(rows: DataFrame, method: str, reference: str, value: str, keys: list[str]) -> DataFrame:
    """Mean of both methods per cell and their difference, in one pass; cells of one method go."""
    side = lambda m: F.avg(F.when(F.col("method") == m, F.col(value)))
    out = rows.where(F.col("method").isin(method, reference)).groupBy(*keys).agg(side(method).alias("candidate"), side(reference).alias("reference"))
    return out.where(F.col("candidate").isNotNull() & F.col("reference").isNotNull()).withColumn("difference", F.col("candidate") - F.col("reference"))


def matched_pairs(panels: DataFrame, attributes: list[str], distance: int = 1, cap: int | None = 200, seed: int = 1701) -> DataFrame:
    """Pairs of panels of a domain that differ in at most ``distance`` (0 or 1) attributes.

    Buckets leave out one attribute each. A bucket of more than ``cap`` panels
    keeps those of least hash of bucket and panel, as the survey protocol asks,
    so the pairs of a bucket are bounded; without a cap (None) all pairs are
    found, as many as a bucket has.
    """
    if distance not in (0, 1):
        raise ValueError("distance must be 0 or 1")
    sets = [attributes] if distance == 0 else [[a for a in attributes if a != drop] for drop in attributes]
    keys = F.array(*[F.concat_ws("|", F.lit(f"{i}"), *[F.coalesce(F.col(a), F.lit("")) for a in s]) for i, s in enumerate(sets)])
    rows = panels.select("domain", "panel_id", F.struct(*attributes).alias("v"), F.explode(keys).alias("bucket"))
    h = hashing.seeded_digest(seed, F.col("bucket"), F.col("panel_id"))
    if cap is not None:
        rows = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("domain", "bucket").orderBy(h, "panel_id"))).where(F.col("_rn") <= cap).drop("_rn")
    a = rows.select("domain", "bucket", F.col("panel_id").alias("panel_id_a"), F.col("v").alias("va"))
    b = rows.select("domain", "bucket", F.col("panel_id").alias("panel_id_b"), F.col("v").alias("vb"))
    pairs = a.join(b, ["domain", "bucket"]).where(F.col("panel_id_a") < F.col("panel_id_b"))
    d = probs.hamming([(F.col(f"va.{x}"), F.col(f"vb.{x}")) for x in attributes])
    return pairs.where(d <= distance).select("domain", "panel_id_a", "panel_id_b", d.alias("distance")).distinct()


def pair_divergence(pairs: DataFrame, rows: DataFrame, items: int = 5, least: float = 0.35, shared: int = 3, seed: int = 1701) -> DataFrame:
    """Pairs whose answers to the first ``items`` shared questions (by hash) differ by ``least`` or more on average."""
    x = rows.select("panel_id", "question_key", (F.col("answer_index") / F.greatest(F.col("n_options") - 1, F.lit(1))).alias("x"))
    a, b = (x.select(F.col("panel_id").alias(f"panel_id_{s}"), "question_key", F.col("x").alias(f"x{s}")) for s in "ab")
    both = pairs.select("domain", "panel_id_a", "panel_id_b").join(a, "panel_id_a").join(b, ["panel_id_b", "question_key"])
    key = ["domain", "panel_id_a", "panel_id_b"]
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(hashing.stable_hex(seed, "divergence_selection", F.col("question_key"))))
    kept = both.withColumn("_r", rank).where(F.col("_r") <= items)
    out = kept.groupBy(*key).agg(
        F.avg(F.abs(F.col("xa") - F.col("xb"))).alias("history_divergence"),
        F.transform(F.array_sort(F.collect_list(F.struct("_r", "question_key"))), lambda s: s["question_key"]).alias("selection_items"),
    )
    return out.where((F.size("selection_items") >= shared) & (F.col("history_divergence") >= least))


def heterogeneity(predictions: DataFrame, pairs: DataFrame, shared: int = 3, least: int = 5) -> DataFrame:
    """Rank correlation and ratio of predicted to true differences of matched pairs, by method and K."""
    s = predictions.select(
        "method", "k", "panel_id", "question_key", probs.expected_score(F.col("p")).alias("e"), (F.col("answer_index") / F.greatest(F.col("n_options") - 1, F.lit(1))).alias("h")
    )
    side = lambda z: s.select("method", "k", F.col("panel_id").alias(f"panel_id_{z}"), "question_key", F.col("e").alias(f"e{z}"), F.col("h").alias(f"h{z}"))
    both = pairs.join(side("a"), "panel_id_a").join(side("b"), ["method", "k", "panel_id_b", "question_key"])
    if "selection_items" in pairs.columns:
        both = both.where(~F.array_contains("selection_items", F.col("question_key")))
    d = both.groupBy("method", "k", "panel_id_a", "panel_id_b").agg(
        F.avg(F.abs(F.col("ha") - F.col("hb"))).alias("d_true"), F.avg(F.abs(F.col("ea") - F.col("eb"))).alias("d_pred"), F.count(F.lit(1)).alias("n")
    )
    d = d.where(F.col("n") >= shared).withColumn("rt", average_rank("d_true", ["method", "k"])).withColumn("rp", average_rank("d_pred", ["method", "k"]))
    enough = F.count(F.lit(1)) >= least
    return d.groupBy("method", "k").agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.when(enough, pearson("rt", "rp")).alias("rho_heterogeneity"),
        F.when(enough & (F.avg("d_true") > 0), F.try_divide(F.avg("d_pred"), F.avg("d_true"))).alias("drr"),
    )


def donor_shuffle(rows: DataFrame, histories: DataFrame, demographics: list[str], seed: int = 1701) -> DataFrame:
    """For each (panel_id, question_key) of ``histories`` the answer of another panel to the same question.

    A donor of equal demographics comes first, then any other, then the panel
    itself. The panels of a question and cell stand on a ring in the order of
    their digests, and each takes the next one's answer; a panel alone in its
    cell takes the panel of the question with the least digest, or the second
    if that is itself. One window and one aggregate, in proportion to the rows.
    """
    h = hashing.seeded_digest(seed, F.col("question_key"), F.col("panel_id"))
    ring = rows.select("question_key", "panel_id", *demographics, F.struct(h.alias("h"), F.col("panel_id").alias("donor"), F.col("answer_index").alias("answer_index")).alias("x"))
    w = Window.partitionBy("question_key", *demographics)
    follower = F.coalesce(F.lead("x").over(w.orderBy("x.h", "panel_id")), F.min("x").over(w))
    ring = ring.withColumn("next", follower)
    lonely = F.col("next.donor") == F.col("panel_id")
    least = rows.select("question_key", F.struct(h.alias("h"), F.col("panel_id").alias("donor"), F.col("answer_index").alias("answer_index")).alias("x"))
    first = least.groupBy("question_key").agg(F.min("x").alias("first"))
    second = least.join(first, "question_key").where(F.col("x.donor") != F.col("first.donor")).groupBy("question_key").agg(F.min("x").alias("second"))
    ends = first.join(second, "question_key", "left")
    found = ring.join(ends, "question_key").withColumn("b", F.when(~lonely, F.col("next")).when(F.col("first.donor") != F.col("panel_id"), F.col("first")).otherwise(F.coalesce("second", "x")))
    kept = histories.select("panel_id", "question_key").distinct()
    return found.join(kept, ["panel_id", "question_key"], "left_semi").select("panel_id", "question_key", F.col("b.donor").alias("donor"), F.col("b.answer_index").alias("answer_index"))


def stratum_shuffle(rows: DataFrame, strata: list[str], unit: str, columns: list[str], seed: int) -> DataFrame:
    """The columns permuted within each stratum; every stratum keeps its multiset."""
    w = Window.partitionBy(*strata)
    own = rows.withColumn("_rn", F.row_number().over(w.orderBy(unit)))
    h = hashing.seeded_digest(seed, F.col(unit))
    other = rows.withColumn("_rn", F.row_number().over(w.orderBy(h, unit))).select(*strata, "_rn", *[F.col(c).alias(f"shuffled_{c}") for c in columns])
    return own.join(other, [*strata, "_rn"]).drop("_rn")


def cell_donor(rows: DataFrame, donors: DataFrame, cell: list[str], unit: str, seed: int, modulus_tag: str = "donor") -> DataFrame:
    """A donor of the same cell, chosen by hash modulo the cell's size; of all donors where the cell has none."""
    pool = donors.select(*cell, F.col(unit).alias("donor"))
    in_cell = pool.withColumn("i", F.row_number().over(Window.partitionBy(*cell).orderBy("donor")) - 1)
    sizes = pool.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    number = lambda n: F.pmod(F.conv(F.substring(hashing.seeded_digest(seed, F.lit(modulus_tag), F.col(unit)), 1, 15), 16, 10).cast("bigint"), n)
    out = rows.join(sizes, cell, "left").withColumn("i", number(F.col("n")))
    out = out.join(in_cell, [*cell, "i"], "left")
    # the fallback numbers donors in parallel: by bucket first, then within it
    n_all = donors.count()
    buckets = pool.withColumn("b", F.pmod(F.xxhash64("donor"), F.lit(1024)).cast("int"))
    before = buckets.groupBy("b").agg(F.count(F.lit(1)).alias("c")).withColumn("before", F.sum("c").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)))
    everyone = buckets.join(F.broadcast(before), "b").withColumn("g", F.coalesce("before", F.lit(0)) + F.row_number().over(Window.partitionBy("b").orderBy("donor")) - 1)
    lost = out.where(F.col("donor").isNull()).drop("donor", "i", "n").withColumn("g", number(F.lit(n_all)))
    found = lost.join(everyone.select("g", "donor"), "g", "left").drop("g")
    return out.where(F.col("donor").isNotNull()).drop("i", "n").unionByName(found)


def semi(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """C7, C9, D9"""
    return df.join(keys.select(*on).distinct(), on, "left_semi")


def anti(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """D10, M1"""
    return df.join(keys.select(*on).distinct(), on, "left_anti")


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a finite number in all the columns."""
    keep = F.lit(True)
    for c in columns:
        x = F.col(c).cast("double")
        keep = keep & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return df.where(keep)


def expand_options(rows: DataFrame, options: Column, vectors: DataFrame | None = None) -> DataFrame:
    """Each row with each of its options, and the option's vector if given."""
    out = rows.select("*", F.posexplode(options).alias("option_index", "option"))
    return out if vectors is None else out.join(vectors, ["question_key", "option_index"], "left")

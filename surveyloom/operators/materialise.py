"""Units made ready for readers and heads: histories, prompts, candidate rows, persona databases and item splits."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.functions import hashing, probs, text
from surveyloom.operators import baselines, ranking, vectors
from surveyloom.operators.joins import require_unique, semi

# The wording and the widths of the canonical prompt.
PROMPT_TASK = "Task: Predict how this real survey respondent is likely to answer the target question."
RESPONDENT_TASK = "Task: Describe this real survey respondent's demographic background and known attitudes, independent of any specific target question."
NO_HISTORY = "No relevant previous responses are available."
WITHHELD = "Withheld for ablation."
LABELS = "ABCDEFGHIJK"


def select_history(keys: Column, k: int, mode: str, seed: int, panel: Column) -> Column:
    """up to ``k`` of the eligible keys: the first by name (``all``) or by hash (``random``); none for k <= 0.

    The semantic mode needs vectors: operators.vectors.evidence_top_k.
    """
    if mode not in ("all", "random"):
        raise ValueError(f"unknown history selection {mode}")
    if k <= 0:
        return F.array().cast("array<string>")
    if mode == "all":
        return F.slice(F.array_sort(keys), 1, k)
    dealt = F.array_sort(F.transform(keys, lambda q: F.struct(hashing.seeded_digest(seed, panel, F.lit("history"), q).alias("h"), q.alias("q"))))
    return F.slice(F.transform(dealt, lambda x: x["q"]), 1, k)


def history_block(history: Column) -> Column:
    """Numbered lines of an array of (question, answer)."""
    lines = F.transform(history, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), text.truncate(x["question"], 160), F.lit(" -> "), text.truncate(x["answer"], 90)))
    return F.when(F.size(history) == 0, NO_HISTORY).otherwise(F.array_join(lines, "\n"))


def canonical_prompt(profile: Column, history: Column, question: Column, options: Column, order: Column, demographic: bool = True) -> Column:
    """Background, previous answers, the question and its options as shown by ``order``."""
    shown = F.transform(order, lambda o, i: F.concat(F.substring(F.lit(LABELS), i + 1, F.lit(1)), F.lit(". "), text.truncate(F.get(options, o), 180)))
    background = text.truncate(profile, 600) if demographic else F.lit(WITHHELD)
    return F.concat(
        F.lit(PROMPT_TASK + "\n\nRespondent background:\n"), background, F.lit("\n\nRelevant previous responses:\n"), history_block(history),
        F.lit("\n\nTarget question:\n"), text.truncate(question, 600), F.lit("\n\nOptions:\n"), F.array_join(shown, "\n"), F.lit("\n\nAnswer:"),
    )


def respondent_prompt(profile: Column, history: Column) -> Column:
    """The same without a target."""
    return F.concat(F.lit(RESPONDENT_TASK + "\n\nRespondent background:\n"), text.truncate(profile, 600), F.lit("\n\nKnown previous responses:\n"), history_block(history))


def prompts(units: DataFrame, rows: DataFrame, k: int, mode: str = "all", history_seed: int = 1701, option_seed: int = 0) -> DataFrame:
    """For each unit (panel_id, question_key, eligible_source_keys) the prompt, its hash, history keys, order of options and label of the answer.

    ``rows``: row_id, panel_id, question_key, question, options, answer_index,
    demographic_text. Option seed 0 keeps the order. A unit without a row fails.
    """
    target = rows.select("row_id", "panel_id", "question_key", "question", "options", "answer_index", "demographic_text")
    both = units.select("panel_id", "question_key", "eligible_source_keys").join(require_unique(target, ["panel_id", "question_key"]), ["panel_id", "question_key"], "left")
    both = both.where(F.when(F.col("row_id").isNull(), F.raise_error(F.concat(F.lit("unit without a response: "), F.col("panel_id"), F.lit(" "), F.col("question_key")))).otherwise(F.lit(True)))
    both = both.withColumn("history_keys", select_history(F.col("eligible_source_keys"), k, mode, history_seed, F.col("panel_id")))
    asked = both.select("row_id", "panel_id", F.posexplode("history_keys").alias("i", "question_key"))
    given = rows.select("panel_id", "question_key", F.struct("question", F.get("options", F.col("answer_index").cast("int")).alias("answer")).alias("x"))
    known = asked.join(given, ["panel_id", "question_key"]).groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("history"))
    out = both.join(known, "row_id", "left").withColumn("history", F.coalesce("history", F.array().cast("array<struct<question:string,answer:string>>")))
    n = F.size("options")
    order = F.sequence(F.lit(0), n - 1) if option_seed == 0 else hashing.hash_order(option_seed, F.col("row_id"), n)
    out = out.withColumn("order", order)
    prompt = canonical_prompt(F.col("demographic_text"), F.col("history"), F.col("question"), F.col("options"), F.col("order"))
    out = out.withColumn("prompt", prompt).withColumn("prompt_hash", hashing.stable_hex(F.col("prompt")))
    label = F.array_position("order", F.col("answer_index").cast("int")) - 1
    return out.select("row_id", "panel_id", "question_key", "history_keys", "order", label.alias("correct_label"), "prompt", "prompt_hash")


def choice_rows(targets: DataFrame, answers: DataFrame, calibration: DataFrame, k: int, seed: int) -> DataFrame:
    """Each target with the answers of its panel to the first ``k`` calibration items of its domain by hash, the target itself left out.

    Adds ``history`` (question_key, answer_index; null where the item was not
    answered) and ``log_prior`` (uniform). Repeated answers fail.
    """
    pool = calibration.groupBy("domain").agg(F.collect_set("question_key").alias("pool"))
    rows = targets.join(pool, "domain", "left")
    others = F.array_except(F.coalesce("pool", F.array().cast("array<string>")), F.array("question_key"))
    rows = rows.withColumn("_keys", ranking.stable_history(F.col("panel_id"), others, k, seed)).drop("pool")
    asked = rows.select("row_id", "panel_id", F.posexplode("_keys").alias("i", "question_key"))
    given = require_unique(answers.select("panel_id", "question_key", "answer_index"), ["panel_id", "question_key"])
    known = asked.join(given, ["panel_id", "question_key"], "left").groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "question_key", "answer_index"))), lambda s: F.struct(s["question_key"].alias("question_key"), s["answer_index"].alias("answer_index"))).alias("history"))
    uniform = F.transform(F.sequence(F.lit(1), F.col("n_options")), lambda _: -F.log(F.col("n_options").cast("double")))
    return rows.drop("_keys").join(known, "row_id", "left").withColumn("log_prior", uniform)


def fold_prior(rows: DataFrame, folds: DataFrame, outer: int, n_folds: int) -> tuple[dict[str, DataFrame], DataFrame]:
    """A prior fitted on training panels and training items of an outer fold only, and those items."""
    train = folds.where(ranking.fold_role(F.col("fold"), F.lit(outer), n_folds) == "train").select("question_key")
    return baselines.population_prior(baselines.only_train(rows, train)), train


def cached_arrays(cache: DataFrame, rows: DataFrame, prior: dict[str, DataFrame], train_items: DataFrame) -> DataFrame:
    """Cached vectors (row_id, vector) joined with their rows and the log of a fold-safe prior."""
    seen = train_items.select("question_key").distinct().withColumn("_seen", F.lit(True))
    known = rows.join(cache.select("row_id", "vector"), "row_id").join(seen, "question_key", "left")
    out = baselines.prior_predict(known, prior, F.coalesce(F.col("_seen"), F.lit(False))).drop("_seen")
    return out.withColumn("log_prior", F.transform("prior", lambda x: F.log(F.greatest(x, F.lit(probs.FLOOR)))))


def with_respondent_vectors(targets: DataFrame, respondents: DataFrame) -> DataFrame:
    """The vector of each target's panel and domain; targets without one go, and none at all fails."""
    out = targets.join(require_unique(respondents.select("panel_id", "domain", "vector"), ["panel_id", "domain"]), ["panel_id", "domain"])
    if not out.limit(1).count():
        raise ValueError("no target has a respondent vector")
    return out


def self_database(rows: DataFrame, options: DataFrame, calibration: DataFrame) -> DataFrame:
    """A record for each answer to a calibration item: panel, domain, item, question, answer and the vector of the chosen option.

    ``rows``: panel_id, domain, question_key, question, options, answer_index;
    ``options``: question_key, option_index, vector. Answers outside the options fail.
    """
    kept = semi(rows, calibration, ["question_key"]).join(options.select("question_key").distinct(), "question_key", "left_semi")
    index = F.col("answer_index").cast("int")
    bad = (index < 0) | (index >= F.size("options"))
    kept = kept.where(F.when(bad, F.raise_error(F.concat(F.lit("invalid calibration answer for "), F.col("question_key")))).otherwise(F.lit(True)))
    vector = options.select("question_key", F.col("option_index").cast("int").alias("answer_index"), "vector")
    return kept.withColumn("answer_index", index).join(vector, ["question_key", "answer_index"]).select("panel_id", "domain", "question_key", "question", "answer_index", F.get("options", index).alias("answer"), "vector")


def profiles(records: DataFrame) -> DataFrame:
    """The mean chosen vector of each panel."""
    return vectors.centroids(records, ["panel_id"])


def collaborative_index(records: DataFrame, splits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records and profiles of training panels (panel_id, split) only."""
    kept = records.join(splits.where("split = 'train'").select("panel_id").distinct(), "panel_id", "left_semi")
    return kept, profiles(kept)


def linked_clusters(points: np.ndarray, n: int) -> list[list[int]]:
    """Average-linkage clusters by cosine distance, numbered by their least member; for the items of one domain."""
    unit = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), probs.FLOOR)
    apart = 1 - unit @ unit.T
    groups = [[i] for i in range(len(points))]
    while len(groups) > n:
        _, a, b = min((round(float(apart[np.ix_(x, y)].mean()), 12), i, j) for (i, x), (j, y) in combinations(list(enumerate(groups)), 2))
        groups[a] = sorted(groups[a] + groups[b])
        del groups[b]
    return sorted(groups)


def whole_clusters(sizes: list[int], wanted: int, n_folds: int) -> tuple[int, ...]:
    """The set of clusters whose size is nearest to ``wanted`` and that leaves an item for each fold.

    Of sets equally near, one of a size below ``wanted`` is taken before one
    above, then one of fewer clusters, then the one of the lowest numbers. A
    table holds the best set for each size that can be reached, so the work
    grows with clusters times items.
    """
    best: dict[int, tuple[int, tuple[int, ...]]] = {0: (0, ())}
    for number, size in enumerate(sizes):
        grown = {reached + size: (n + 1, (*some, number)) for reached, (n, some) in best.items()}
        for reached, found in grown.items():
            best[reached] = min(best.get(reached, found), found)
    left = {reached: found for reached, found in best.items() if reached and sum(sizes) - reached >= n_folds}
    near = min(left, key=lambda reached: (abs(reached - wanted), reached > wanted, left[reached]))
    return left[near][1]


def cluster_split(items: DataFrame, n_calibration: int, n_folds: int, clusters: int, seed: int, representatives: bool = False) -> DataFrame:
    """Whole semantic clusters for calibration (fold null), the other items dealt to folds by hash; (domain, question_key, cluster, fold).

    ``representatives`` (K13) takes the first item of each of the first
    ``n_calibration`` clusters instead. ``items``: domain, question_key, vector
    (the mean of its options). A domain has few items, so one task splits it.
    """

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("question_key").reset_index(drop=True)
        if len(pdf) < n_calibration + n_folds:
            raise ValueError(f"{pdf.domain[0]}: too few items")
        groups = linked_clusters(np.stack(pdf["vector"].to_numpy()).astype(float), min(clusters, len(pdf) - n_folds + 1))
        number = np.empty(len(pdf), np.int64)
        for g, members in enumerate(groups):
            number[members] = g
        if representatives:
            chosen = {members[0] for members in groups[:n_calibration]}
            calibration = [i in chosen for i in range(len(pdf))]
        else:
            kept = whole_clusters([len(g) for g in groups], n_calibration, n_folds)
            calibration = [int(c) in kept for c in number]
        return pdf[["domain", "question_key"]].assign(cluster=number, calibration=calibration)

    from pyspark.sql import Window

    found = items.groupBy("domain").applyInPandas(split, "domain string, question_key string, cluster bigint, calibration boolean")
    h = hashing.stable_hex(seed, "cluster_folds", F.col("question_key"))
    rank = F.row_number().over(Window.partitionBy("domain", "calibration").orderBy(h)) - 1
    return found.withColumn("fold", F.when(~F.col("calibration"), F.pmod(rank, F.lit(n_folds)))).drop("calibration")

"""Neighbours, centroids and evidence over vector columns (array<float> or array<double>)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.functions import probs, text
from surveyloom.operators.ranking import top_n

#: Queries that one block of a search holds, and vectors of the index beside it: some 20 MB of 64 dimensions.
BLOCK, INDEX_BLOCK = 16384, 32768
#: Similarities that are ranked at once: sorting takes some five arrays of as many numbers.
CELLS = 1 << 20


def neighbours(queries: DataFrame, index: DataFrame, n: int, id_col: str = "id", vector: str = "vector") -> DataFrame:
    """The ``n`` most similar rows of ``index`` by cosine for each query, without the query itself; ties by id.

    Both sides are cut into blocks by hash, in their own precision; each task
    holds one block of queries and passes over one block of the index, and
    sends on only its ``n`` best per query.
    """
    parts = max(1, -(-queries.count() // BLOCK))
    cuts = max(1, -(-index.count() // INDEX_BLOCK))
    q = queries.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("v"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(parts)).cast("int").alias("qb"))
    x = index.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("v"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(cuts)).cast("int").alias("xb"))
    q = q.withColumn("xb", F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))))
    x = x.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def best(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"id": [], "neighbour": [], "similarity": []}).astype({"id": "int64", "neighbour": "int64"})
        a, b = np.stack(left["v"]).astype(float), np.stack(right["v"]).astype(float)
        a = a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), probs.FLOOR)
        b = b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), probs.FLOOR)
        ids, other = left["id"].to_numpy(), right["id"].to_numpy()
        out, step = [], max(1, CELLS // len(b))
        for i in range(0, len(a), step):
            mine = ids[i : i + step]
            sims = a[i : i + step] @ b.T
            sims[mine[:, None] == other[None, :]] = -np.inf
            order = np.lexsort((np.broadcast_to(other, sims.shape), -np.round(sims, 12)), axis=1)[:, :n]
            rows = np.arange(len(sims))[:, None]
            found = pd.DataFrame({"id": np.repeat(mine, order.shape[1]), "neighbour": other[order].ravel(), "similarity": sims[rows, order].ravel()})
            out.append(found[np.isfinite(found["similarity"])])
        return pd.concat(out)

    found = q.groupBy("qb", "xb").cogroup(x.groupBy("qb", "xb")).applyInPandas(best, "id bigint, neighbour bigint, similarity double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round("similarity", 12)), "neighbour")))
    return ranked.where(F.col("rank") <= n)


def centroids(rows: DataFrame, keys: list[str], vector: str = "vector") -> DataFrame:
    """The mean vector of each group."""
    each = rows.select(*keys, F.posexplode(vector).alias("i", "x")).groupBy(*keys, "i").agg(F.avg("x").alias("x"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


def nearest_centroid(rows: DataFrame, centers: list[tuple[int, list[float]]], vector: str = "vector") -> DataFrame:
    """The number of the nearest center, the least on ties. Centers are a fitted model of stated size."""
    options = [F.struct(F.round(probs.squared_distance(F.col(vector), F.array(*[F.lit(float(x)) for x in c])), 12).alias("d"), F.lit(i).alias("c")) for i, c in centers]
    return rows.withColumn("cluster", F.array_min(F.array(*options))["c"])


def weighted_history(targets: DataFrame, history: DataFrame, temperature: float = 0.5) -> DataFrame:
    """For each target (row_id, vector) the mean of its history's vectors, weighted by softmax of cosine over temperature.

    Targets without history get zeros.
    """
    both = targets.select("row_id", F.col("vector").alias("t")).join(history.select("row_id", F.col("vector").alias("a")), "row_id")
    sims = both.withColumn("s", probs.cosine(F.col("a"), F.col("t")) / F.lit(max(temperature, 1e-6)))
    w = Window.partitionBy("row_id")
    sims = sims.withColumn("e", F.exp(F.col("s") - F.max("s").over(w)))
    sims = sims.withColumn("w", F.col("e") / F.sum("e").over(w))
    z = sims.select("row_id", F.posexplode("a").alias("i", "x"), "w").groupBy("row_id", "i").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
    z = z.groupBy("row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("z"))
    zero = F.transform("vector", lambda _: F.lit(0.0))
    return targets.join(z, "row_id", "left").withColumn("z", F.coalesce("z", zero))


def evidence_top_k(targets: DataFrame, records: DataFrame, k: int) -> DataFrame:
    """each target's (target_id, panel_id, centroid) ``k`` records of its panel by cosine; ties by panel and question."""
    both = targets.join(records, "panel_id").withColumn("similarity", probs.cosine(F.col("vector"), F.col("centroid")))
    w = Window.partitionBy("target_id").orderBy(F.desc(F.round("similarity", 12)), "panel_id", "question_key")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("vector", "centroid")


def assembled_evidence(own: DataFrame, backfill: DataFrame, k: int, threshold: int) -> DataFrame:
    """own evidence (target_id, record_id, similarity), filled up from neighbours' where fewer than ``threshold`` are found."""
    sizes = own.groupBy("target_id").agg(F.count(F.lit(1)).alias("n_own"))
    all_targets = own.select("target_id").unionByName(backfill.select("target_id")).distinct().join(sizes, "target_id", "left").withColumn("n_own", F.coalesce("n_own", F.lit(0)))
    sparse = all_targets.where(F.col("n_own") < threshold)
    extra = backfill.join(sparse, "target_id").withColumn("_r", F.row_number().over(Window.partitionBy("target_id").orderBy(F.desc("similarity"), "record_id")))
    extra = extra.where(F.col("_r") <= k - F.col("n_own")).select("target_id", "record_id", "similarity", F.lit("neighbour").alias("origin"))
    return own.select("target_id", "record_id", "similarity", F.lit("self").alias("origin")).unionByName(extra)


def summaries(records: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` records of each panel and domain as one text (question cut at 70 characters, answer at 40)."""
    first = top_n(records, ["panel_id", "domain"], [F.col("question_key")], n)
    line = F.concat(text.truncate(F.col("question"), 70, "~"), F.lit(" -> "), text.truncate(F.col("answer"), 40, "~"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("question_key", line.alias("t")))), lambda s: s["t"]), "; ")
    return first.groupBy("panel_id", "domain").agg(F.concat(F.lit("["), F.col("domain"), F.lit("] tendencies (calibration only): "), listed).alias("summary"))


def scored_options(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A reader without a model: option shares from the digest of the prompt."""
    import hashlib

    for pdf in batches:
        out = []
        for prompt, n in zip(pdf["prompt"], pdf["n_options"], strict=True):
            z = np.frombuffer(hashlib.sha256(prompt.encode()).digest(), np.uint8)[: int(n)] / 64.0
            e = np.exp(z - z.max())
            out.append((e / e.sum()).tolist())
        yield pdf.assign(p=out)


def read_prompts(prompts: DataFrame, reader=scored_options) -> DataFrame:
    """A reader (an iterator of pandas frames, as in mapInPandas) adds ``p`` to prompts (prompt, n_options, ...)."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in prompts.schema)
    return prompts.mapInPandas(reader, f"{fields}, p array<double>")

"""Fitted models: pyspark.ml where it has them, numpy in grouped tasks for small per-item fits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, PCA, HashingTF, NGram, Normalizer, OneHotEncoder, RegexTokenizer, StandardScaler, StopWordsRemover, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.functions import probs
from surveyloom.functions.text import STOP_WORDS
from surveyloom.sources.scratch import written


def tfidf(texts: DataFrame, text: str = "text", features: int = 1 << 16) -> DataFrame:
    """Unit vectors of one- and two-word terms without English stop words, weighted by tf (idf + 1)."""
    steps = Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"\w\w+", gaps=False),
            StopWordsRemover(inputCol="_w", outputCol="_s"),
            NGram(n=2, inputCol="_s", outputCol="_b"),
        ]
    )
    rows = steps.fit(texts).transform(texts).withColumn("_t", F.concat("_s", "_b"))
    rows = HashingTF(inputCol="_t", outputCol="_tf", numFeatures=features).transform(rows)
    rows = IDF(inputCol="_tf", outputCol="_idf").fit(rows).transform(rows)
    return Normalizer(inputCol="_idf", outputCol="tfidf").transform(rows).drop("_w", "_s", "_b", "_t", "_tf", "_idf")


#: Bytes of text whose terms are counted in one task, and whose terms meet in one task.
TEXT_PART, TERM_PART = 4 << 20, 16 << 20


def tfidf_terms(texts: DataFrame, key: str, text: str = "text", stop_words: list[str] = STOP_WORDS, only: DataFrame | None = None) -> DataFrame:
    """L23 as rows (key, term, w): one- and two-word terms without stop words, tf (ln((1 + n) / (1 + df)) + 1), each text scaled to length 1.

    Sparse throughout: a text has as many rows as distinct terms. Texts are
    dealt by key before they become terms, so terms travel once, to where
    document frequencies are counted and joined. With ``only`` (term) the other
    terms count in lengths, but have no rows and are not sent on.
    """
    stop = F.array(*[F.lit(w) for w in stop_words])
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\w\w+"), F.lit(0))
    n, size = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    dealt = texts.select(key, text).repartition(1 + size // TEXT_PART, key)
    rows = dealt.select(key, F.filter(words, lambda w: ~F.array_contains(stop, w)).alias("w"))
    pairs = F.zip_with("w", F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    pairs = F.slice(pairs, F.lit(1), F.greatest(F.size("w") - 1, F.lit(0)))
    tf = rows.select(key, F.explode(F.concat("w", pairs)).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    tf = tf.repartition(1 + size // TERM_PART, "term")
    # every row counts; the condition names all columns, so that both sides of the join read one exchange
    df = tf.groupBy("term").agg(F.count(F.when(F.col("tf") > F.pmod(F.xxhash64(key), F.lit(1)), 1)).alias("df"))
    weighed = tf.join(df.hint("shuffle_hash"), "term").select(key, "term", (F.col("tf") * (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1)).alias("x"))
    norm = weighed.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    if only is not None:
        weighed = weighed.join(only.select("term").distinct(), "term", "left_semi")
    # texts of null keys are one text here, as in a window by key
    norm = norm.withColumnRenamed(key, "_key")
    return weighed.join(norm, F.col(key).eqNullSafe(F.col("_key"))).select(key, "term", (F.col("x") / F.col("norm")).alias("w"))


def inductive_pca(vectors: DataFrame, train: Column, k: int, vector: str = "vector") -> DataFrame:
    """Components fitted on training rows only; the training mean is subtracted first."""
    mean = vectors.where(train).select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"))
    mean = [r["m"] for r in mean.orderBy("i").collect()]  # one number per dimension
    centred = F.zip_with(F.col(vector).cast("array<double>"), F.array(*[F.lit(m) for m in mean]), lambda a, b: a - b)
    rows = vectors.withColumn("_v", array_to_vector(centred))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(rows.where(train))
    return model.transform(rows).withColumn("pca", vector_to_array("_p")).drop("_v", "_p")


def factors(rows: DataFrame, columns: list[str], k: int) -> DataFrame:
    """Respondent factors from one-hot answers, standardised; the sign of a factor is arbitrary."""
    index = [f"_i{c}" for c in columns]
    steps = Pipeline(
        stages=[
            StringIndexer(inputCols=columns, outputCols=index, handleInvalid="keep", stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=index, outputCols=[f"_o{c}" for c in columns], dropLast=False),
        ]
    )
    hot = steps.fit(rows).transform(rows)
    joined = F.concat(*[vector_to_array(f"_o{c}") for c in columns])
    hot = hot.withColumn("_v", array_to_vector(joined))
    reduced = PCA(k=k, inputCol="_v", outputCol="_p").fit(hot).transform(hot)
    scaled = StandardScaler(inputCol="_p", outputCol="_z", withMean=True, withStd=True).fit(reduced).transform(reduced)
    return scaled.withColumn("factors", vector_to_array("_z")).select(*rows.columns, "factors")


def personas(profiles: DataFrame, m: int, seed: int = 1701, vector: str = "profile") -> DataFrame:
    """``cluster`` of each profile; the best of several starts, which all read profiles that were written once."""
    rows = written(profiles, "profiles").withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    fits = [KMeans(k=m, seed=seed + i, featuresCol="_v", predictionCol="cluster").fit(rows) for i in range(3)]
    best = min(fits, key=lambda f: f.summary.trainingCost)
    return best.transform(rows).drop("_v")


def demographic_router(train: DataFrame, test: DataFrame, demographics: list[str], label: str = "cluster") -> DataFrame:
    """Shares of clusters from one-hot demographics, as ``prior``."""
    index = [f"_i{c}" for c in demographics]
    steps = Pipeline(
        stages=[
            StringIndexer(inputCols=demographics, outputCols=index, handleInvalid="keep"),
            OneHotEncoder(inputCols=index, outputCols=[f"_o{c}" for c in demographics]),
        ]
    ).fit(train)
    join = lambda df: steps.transform(df).withColumn("_v", array_to_vector(F.concat(*[vector_to_array(f"_o{c}") for c in demographics])))
    model = LogisticRegression(featuresCol="_v", labelCol=label, family="multinomial", regParam=0.01, probabilityCol="_p").fit(join(train))
    return model.transform(join(test)).select(*test.columns, vector_to_array("_p").alias("prior"))


def choice_model(candidates: DataFrame, features: list[Column], train: Column, kind: str = "gbt", row: str = "row_id", seed: int = 1701) -> DataFrame:
    """A classifier over candidates (row, option_index, chosen); scores are normalised within each row.

    Every candidate row is used; there is no silent sample.
    """
    rows = candidates.withColumn("_v", array_to_vector(F.array(*[f.cast("double") for f in features])))
    make = GBTClassifier(featuresCol="_v", labelCol="chosen", maxIter=10, maxDepth=3, seed=seed) if kind == "gbt" else RandomForestClassifier(featuresCol="_v", labelCol="chosen", numTrees=30, maxDepth=6, seed=seed)
    scored = make.fit(rows.where(train)).transform(rows.where(~train)).withColumn("_s", vector_to_array("probability")[1])
    return scored.withColumn("p", F.col("_s") / F.sum("_s").over(Window.partitionBy(row))).select(*candidates.columns, "p")


def indicator_factors(rows: DataFrame, user: str, item: str, rank: int = 4, seed: int = 1701) -> DataFrame:
    """Implicit factors of users and (item, option) indicators; the closest that Spark has to per-option factors."""
    return ALS(userCol=user, itemCol=item, ratingCol="rating", implicitPrefs=True, rank=rank, maxIter=5, seed=seed, coldStartStrategy="drop").fit(rows).transform(rows)


def option_logits(rows: DataFrame, keys: list[str], x: list[str], label: str = "y", ridge: float = 1.0) -> DataFrame:
    """Per group a logistic fit of ``label`` on x with intercept; constant labels give the logit of the clipped share.

    Newton's steps need sums over the group only, so each step is one
    aggregate of fixed width per group, however large the group is.
    """
    d = len(x) + 1
    feats = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in x])
    data = rows.select(*keys, feats.alias("f"), F.col(label).cast("double").alias("y"))
    share = data.groupBy(*keys).agg(F.avg("y").alias("share"))
    clip = F.greatest(F.least(F.col("share"), F.lit(0.99)), F.lit(0.01))
    coef = share.select(*keys, F.array(F.log(clip / (1 - clip)), *[F.lit(0.0)] * (d - 1)).alias("b"), ((F.col("share") == 0) | (F.col("share") == 1)).alias("flat"))
    for _ in range(6):
        p = 1 / (1 + F.exp(-probs.dot(F.col("f"), F.col("b"))))
        joined = data.join(coef, keys).withColumn("p", p)
        sums = joined.groupBy(*keys).agg(
            F.array(*[F.sum((F.col("y") - F.col("p")) * F.col("f")[i]) for i in range(d)]).alias("g"),
            F.array(*[F.sum(F.col("p") * (1 - F.col("p")) * F.col("f")[i] * F.col("f")[j]) for i in range(d) for j in range(d)]).alias("h"),
        )

        def solve(batches):
            for pdf in batches:
                new = []
                for b, g, h, flat in zip(pdf["b"], pdf["g"], pdf["h"], pdf["flat"], strict=True):
                    penal = np.diag([1e-9] + [ridge] * (d - 1))
                    step = np.linalg.solve(np.reshape(h, (d, d)) + penal, np.asarray(g) - penal @ np.asarray(b))
                    new.append(list(np.asarray(b) + (0 if flat else step)))
                yield pdf.drop(columns=["g", "h"]).assign(b=new)

        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in coef.schema)
        # one row per group from here on; the sums are written down so that steps do not pile up
        coef = written(coef.join(sums, keys).mapInPandas(solve, fields), "logits")
    return coef.select(*keys, F.col("b").alias("coefficients"))


def option_softmax(z: DataFrame, coefficients: DataFrame, x: list[str], unit: str, item: str, option: str) -> DataFrame:
    """Option shares of each unit and item from linear scores."""
    terms = F.col("coefficients")[0]
    for i, c in enumerate(x):
        terms = terms + F.col("coefficients")[i + 1] * F.col(c)
    scored = z.join(coefficients, item).withColumn("_s", terms)
    w = Window.partitionBy(unit, item)
    scored = scored.withColumn("_e", F.exp(F.col("_s") - F.max("_s").over(w)))
    return scored.select(unit, item, option, (F.col("_e") / F.sum("_e").over(w)).alias("p"))


def group_ridge(rows: DataFrame, x: list[str], y: str, group: str, alphas: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0, 100.0)) -> pd.DataFrame:
    """Ridge with the penalty of least leave-one-group-out error; only the groups' normal equations reach the driver."""
    d = len(x) + 1
    f = [F.lit(1.0), *[F.col(c).cast("double") for c in x]]
    sums = rows.groupBy(group).agg(
        F.array(*[F.sum(f[i] * f[j]) for i in range(d) for j in range(d)]).alias("xx"), F.array(*[F.sum(f[i] * F.col(y)) for i in range(d)]).alias("xy"), F.sum(F.col(y) * F.col(y)).alias("yy"), F.count(F.lit(1)).alias("n")
    ).orderBy(group).toPandas()
    xx = np.stack([np.reshape(v, (d, d)) for v in sums["xx"]])
    xy, yy = np.stack(sums["xy"].to_list()), sums["yy"].to_numpy()
    out = []
    for a in alphas:
        penal = np.diag([0.0] + [a] * (d - 1))
        error = 0.0
        for g in range(len(sums)):
            b = np.linalg.lstsq(xx.sum(0) - xx[g] + penal, xy.sum(0) - xy[g], rcond=None)[0]
            error += yy[g] - 2 * b @ xy[g] + b @ xx[g] @ b
        out.append((a, error / sums["n"].sum()))
    best = min(out, key=lambda t: t[1])[0]
    b = np.linalg.lstsq(xx.sum(0) + np.diag([0.0] + [best] * (d - 1)), xy.sum(0), rcond=None)[0]
    return pd.DataFrame({"term": ["intercept", *x], "coefficient": b, "alpha": best, "loo_mse": [dict(out)[best]] * d})


def best_by_grid(losses: DataFrame, keys: list[str], parameter: str, loss: str) -> DataFrame:
    """The parameter of least loss, the least on ties."""
    return losses.groupBy(*keys).agg(F.min_by(parameter, F.struct(loss, parameter)).alias(parameter), F.min(loss).alias(loss))


def fisher_update(rows: DataFrame, dims: int, ridge: float = 1.0) -> DataFrame:
    """Per panel the ridge step from chosen minus expected option vectors; ``rows``: panel_id, chosen, expected (arrays), spread (matrix, flat)."""
    sums = rows.groupBy("panel_id").agg(
        F.array(*[F.sum(F.col("chosen")[i] - F.col("expected")[i]) for i in range(dims)]).alias("g"), F.array(*[F.sum(F.col("spread")[i]) for i in range(dims * dims)]).alias("h")
    )

    def solve(batches):
        for pdf in batches:
            yield pd.DataFrame({"panel_id": pdf["panel_id"], "delta": [np.linalg.solve(np.reshape(h, (dims, dims)) + ridge * np.eye(dims), g).tolist() for g, h in zip(pdf["g"], pdf["h"], strict=True)]})

    return sums.mapInPandas(solve, "panel_id string, delta array<double>")

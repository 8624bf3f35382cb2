"""Encoders and readers behind one interface, prompt variants and the parsing of reader replies."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.functions import probs, text
from surveyloom.operators.materialise import LABELS

# The wording of the persona prompt, and the names of its variants.
PERSONA_TASK = "Task: Predict how this real survey respondent is likely to answer the target question. Return exactly one option letter."
PERSONA_WITHHELD = "Withheld."
#: For each variant, whether the background is shown, whose previous answers are (own or a donor's), and whether a persona text is.
VARIANTS = {
    "pe_no_persona": (False, None, False),
    "pe_demographic": (True, None, False),
    "pe_demographic_behavior": (True, None, True),
    "pe_history": (True, "history", False),
    "pe_shuffled_behavior": (True, "shuffled_history", False),
}


def digest_encoder(texts: pd.Series, width: int = 16) -> np.ndarray:
    """An encoder without a model: digest bytes as numbers from 0 to 1."""
    rows = [np.frombuffer(hashlib.sha256(t.encode()).digest(), np.uint8)[:width] / 255.0 for t in texts]
    return np.stack(rows) if rows else np.zeros((0, width))


def encoded(rows: DataFrame, column: str, width: int, encoder: Callable[[pd.Series, int], np.ndarray] = digest_encoder, vector: str = "vector") -> DataFrame:
    """``rows`` with the vector of a text; each distinct text is encoded once, and vectors of another width fail.

    The encoder gets Arrow batches of texts; null texts have no vector.
    """

    @F.pandas_udf("array<double>")
    def encode(texts: pd.Series) -> pd.Series:
        found = np.asarray(encoder(texts, width), float)
        if found.shape != (len(texts), width):
            raise ValueError(f"the encoder gave {found.shape} for {len(texts)} texts of width {width}")
        return pd.Series(list(found))

    distinct = rows.select(column).where(F.col(column).isNotNull()).distinct()
    return rows.join(distinct.withColumn(vector, encode(F.col(column))), column, "left")


def persona_prompt(variant: str, profile: Column, persona: Column, history: Column, question: Column, options: Column) -> Column:
    """The prompt of a variant; ``history`` is an array of (question, answer), the target's answer never enters."""
    shown, source, tendencies = VARIANTS[variant]
    background = text.truncate(profile, 600) if shown else F.lit(PERSONA_WITHHELD)
    lines = F.transform(history, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), text.truncate(x["question"], 160), F.lit(" -> "), text.truncate(x["answer"], 90)))
    told = F.when(F.coalesce(F.size(history), F.lit(0)) <= 0, "None").otherwise(F.array_join(lines, "\n")) if source else F.lit("None")
    block = F.when(F.coalesce(persona, F.lit("")) != "", F.concat(F.lit("Persona tendencies:\n"), text.truncate(persona, 600), F.lit("\n\n"))).otherwise("") if tendencies else F.lit("")
    listed = F.transform(options, lambda o, i: F.concat(F.substring(F.lit(LABELS), i + 1, F.lit(1)), F.lit(". "), text.truncate(o, 180)))
    return F.concat(
        F.lit(PERSONA_TASK + "\n\nRespondent background:\n"), background, F.lit("\n\n"), block, F.lit("Relevant previous responses:\n"), told,
        F.lit("\n\nTarget question:\n"), text.truncate(question, 600), F.lit("\n\nOptions:\n"), F.array_join(listed, "\n"), F.lit("\n\nAnswer:"),
    )


def variant_prompts(targets: DataFrame, variants: list[str]) -> DataFrame:
    """A prompt of each variant for each target.

    ``targets``: row_id, demographic_text, persona, history, shuffled_history
    (arrays of question and answer), question, options.
    """
    each = [
        F.struct(
            F.lit(v).alias("variant"),
            persona_prompt(v, F.col("demographic_text"), F.col("persona"), F.col(VARIANTS[v][1] or "history"), F.col("question"), F.col("options")).alias("prompt"),
        )
        for v in variants
    ]
    return targets.select("row_id", F.explode(F.array(*each)).alias("x")).select("row_id", "x.*")


REPLY = "choices array<struct<logprobs:struct<content:array<struct<top_logprobs:array<struct<token:string,logprob:double>>>>>>>"


def label_shares(payload: Column, labels: list[str]) -> Column:
    """Option shares from a reader's JSON reply, by the best log-probability of each label; null where a label or the list is missing."""
    top = F.from_json(payload, REPLY)["choices"][0]["logprobs"]["content"][0]["top_logprobs"]
    best = lambda label: F.array_max(F.transform(F.filter(top, lambda e: F.trim(e["token"]) == label), lambda e: e["logprob"]))
    scores = F.array(*[best(label) for label in labels])
    return F.when(~F.exists(scores, lambda x: x.isNull()), probs.softmax(scores))

"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.llm import decontamination, language_id, near_dup, personal_data, pieces
from surveyloom.llm.shared import staged, table

#: Documents whose spans fit their languages less than this are rejected, however many languages they mix; a clean short text
#: fits above 0.3, noise about 1 / languages.
LEAST_SCORE = 0.3


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or like no learned language, go. Without labels nothing can be told and all stay."""
    model = language_id.train(docs)
    return docs if model is None else language_id.identified(docs, model, LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by similarities of 0.8 or more of five-word shingles the document of least id stays.

    Rows of one id are one document and stay or go together; rows without an id or without words stay.
    """
    gone = near_dup.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind; n_chars follows the new text."""
    out = personal_data.sanitise(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)
    return out


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every text, with the id only: one row per row of ``docs``."""
    return pieces.with_pieces(docs.select("doc_id", "text")).select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", languages),
    ("near_dup", near_duplicates),
    ("decontamination", decontaminated),
    ("personal_data", sanitised),
    ("pieces", encoded),
]

#: Several stages have no SQL; tests/llm compares the rows with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

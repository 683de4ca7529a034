"""From raw documents to training pieces: quality, near-duplicates, benchmark leaks, personal data, encoding.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and, but for the
last, returns the columns of documents. ``run`` writes each stage's rows and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, near_dedup, pieces, pii, quality_classifier
from ._common import Scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; every row is judged by its own text.

    Nulls and empty texts get the model's bias alone; equal texts share their verdict.
    """
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality_classifier.score(docs, model, out_col="__quality")
    return scored.where(F.col("__quality") >= quality_classifier.THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id; repeated rows once.

    Rows without a doc_id go by their text and come after all others, so they stay where no other row is near.
    """
    by_text = F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    docs = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), by_text))
    kept = near_dedup.near_duplicates(docs, id_col="__id").where("kept").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(kept, "__id", "left_semi").dropDuplicates(["__id", "text"]).drop("__id")  # dealt by __id once for both


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a test item in their text; each row is judged on its own, also one without a doc_id."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    return pii.redact_texts(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids, same_text of every document."""
    return pieces.encode(docs)


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("benchmark leaks", benchmark_leaks),
    ("personal data", personal_data),
    ("sentencepiece", encoding),
]

#: Training, components, tiling and best paths are not SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, one for each document that all stages keep; an empty table gives no rows.

    Rows without a doc_id go through all stages; of rows with equal doc_id and text one stays. Each stage's rows are
    written to the shared folder and read again, so a lost executor costs no more than the stage at work.
    """
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.keep(docs, f"stage{i}")
    return docs

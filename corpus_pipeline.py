"""A training corpus from raw documents: five stages, each over all that the one before kept.

Every stage but the last returns the columns of ``documents``; the last returns the
bins of the packed corpus.  ``run`` writes each stage's documents as Parquet into the
shared folder and reads them again.

Defined results are those of the operators; besides, a document that loses its last
word in a stage is dropped there, and ``n_chars`` follows the text.  An empty table
gives no bins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import decontamination, jaccard_join, line_dedup, packing, quality, shared


def _tidy(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Documents that still have text, with the right ``n_chars``."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.where(F.col("text").rlike(r"[^\s]")).select(*columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    return quality.keep_good(docs)


def first_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every line only where it occurs first."""
    return _tidy(line_dedup.dedup_lines(docs), docs.columns)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least doc_id, of each group of near copies."""
    return jaccard_join.drop_near_copies(docs)


def no_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the spans, or mostly contaminated documents, that the benchmark's n-grams find."""
    return _tidy(decontamination.decontaminate(docs, shared.table(sf_dir, "benchmark", spark)), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins of the corpus."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", first_lines),
    ("ngram_jaccard_join", no_near_copies),
    ("benchmark_decontamination", no_test_items),
    ("best_fit_packing", packed),
]

#: SQL can express neither the classifier nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(sf_dir, "documents", spark)
    for name, stage in STAGES[:-1]:
        before, docs = docs, shared.store(stage(spark, docs, sf_dir), name)
        shared.discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)

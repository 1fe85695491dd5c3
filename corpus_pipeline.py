"""Corpus pipeline: language ID, near-duplicates, decontamination, secrets, packing.

``run`` applies the stages to ``documents``; each stage's rows are written as Parquet in the shared
scratch folder and read again as the documents of the next. All but the last return the columns of
their documents, extra ones unchanged whatever their names. No stage needs a doc_id: rows without one, or with
one that others have too, are decided by themselves. Texts are taken whole, however long; an empty table gives
an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairjudge.llm import decontaminate, language, packing, secrets, simhash
from pairjudge.llm.common import table, written

#: Documents whose language is told with a smaller calibrated probability are rejected.
LEAST_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is told; those without letters (null and empty texts too) or with a
    doubtful language go. Repeated rows share one fate.

    The model learns from these documents' own labels, but for the held-out quarter."""
    return language.keep_identified(docs, language.fit(language.training_rows(docs)), LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that with the smallest doc_id, of each group of near-duplicates.

    Of equal rows one stays; null and empty texts have fingerprint zero and are one group."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a window of a benchmark item; null and empty texts hold none and stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put a mark in place of every secret; n_chars follows. No document goes; a null text stays null."""
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of token ids; repeated rows are packed each, a null text as an empty one."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Model training, XXH64 and tokenization are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

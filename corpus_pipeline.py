"""The corpus pipeline: toxicity, near-duplicates, decontamination, surrogates for personal data, BPE."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioq.llm.bpe import encode_texts
from folioq.llm.common import small_batches, store, table
from folioq.llm.decontaminate import decontaminate
from folioq.llm.near_copies import keep_representatives
from folioq.llm.pii import with_surrogates
from folioq.llm.queries import PII_KEY, vocabulary
from folioq.llm.toxicity import reject_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    small_batches(spark)
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates: five-word shingles, Jaccard 0.8 or more, by SimHash and beyond its radius by a MinHash forest."""
    small_batches(spark)
    return keep_representatives(docs)


def measured(docs: DataFrame) -> DataFrame:
    """n_chars brought up to the text, where there is such a column."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that mostly consist of them go."""
    small_batches(spark)
    return measured(decontaminate(docs, table(spark, sf_dir, "benchmark")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates."""
    return measured(with_surrogates(docs, PII_KEY))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document; the text is what they decode to."""
    small_batches(spark)
    return measured(encode_texts(docs, vocabulary(), round_trip=True))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("bpe", bpe),
]

#: Trees, fingerprints and token merges are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder before the next stage starts."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""From raw documents to token ids, in five stages over what the stage before kept.

Each stage reads the Parquet that its predecessor wrote. All but the last return
the columns of ``documents``; the last returns a digest of each document's ids.

Every stage takes null texts for empty ones, whole texts of any length, and empty tables (which stay
empty); columns beside id and text are carried along, whatever their names. A row without an id is never dropped as a
copy, since no other row can stand for it. Rows that share an id are judged by their own texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parley.llm import bpe, decontamination, exact_dedup, near_dedup, quality
from parley.plans.scratch import save

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that the classifier rejects go; without any positive label all stay."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of equal texts, the row with the largest id stays; rows that repeat its id and text stay with it."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of each group of near copies (five-word shingles, similarity 0.8) the document with the smallest id stays.

    Its fingerprints propose pairs within two bits, as in its query, and further pairs come from MinHash bands; all are
    verified on their shingles. Repeated rows of the document that stays, stay with it.
    """
    return near_dedup.drop_near_copies(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that hold a benchmark item go; without any item all stay."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: a row for each row that is left, with digests of its token ids and of their decoding."""
    return bpe.round_trip_digest(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("bpe", encode),
]

#: Not expressible in SQL: tests/llm/test_pipeline.py holds it against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

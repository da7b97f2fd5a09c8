"""A corpus pipeline of five stages over documents, each written as Parquet and read again as the next one's input.

Every stage works on all documents that its predecessor kept and returns the columns
of documents, the last one the tokens besides.  The stages' operators define what
nulls, empty texts, ties and empty tables give (see pagemill.llm).
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import decontaminate, pieces, quality, secrets, simhash
from pagemill.llm.common import own_tables, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def columns_kept(stage: Stage) -> Stage:
    """The stage over docs whose further columns have neutral names meanwhile, so that none can clash with one of an operator."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        plain = docs.toDF(*(c if c in COLUMNS else f"further{k}" for k, c in enumerate(docs.columns)))
        return stage(spark, plain, sf_dir).select(*plain.columns).toDF(*docs.columns)

    return run


@columns_kept
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, "quality").where("quality >= 0.3")


@columns_kept
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group that a similarity of 0.8 over shingles of five words links; a row without an id goes before one with an id."""
    return simhash.deduplicated(docs, words=5, similarity=0.8)


@columns_kept
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@columns_kept
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in their texts replaced by a mark."""
    found = secrets.scan(docs)
    clean = found.withColumn("text", secrets.redact(F.col("text"), F.col("spans")))
    return clean.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their tokens, whose columns replace any of these names."""
    return pieces.tokenized(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("sentencepiece", tokenize),
]

ORACLE_SQL = None  # learned and hashed stages; tests/llm holds them against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of all stages; of the tables written on the way only the last stage's input stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with own_tables(spark) as tables:
        for k, (name, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if k + 1 < len(STAGES):
                docs = written(docs, name)
                tables.drop(keep=1)
    return docs

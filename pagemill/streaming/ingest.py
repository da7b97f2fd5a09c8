"""Structured Streaming: documents that keep arriving are classified and converted as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pagemill.operators import features, pipelines
from pagemill.sources import corpus


def document_stream(spark: SparkSession, path: str, schema: str = "doc_id long, text string") -> DataFrame:
    """Documents of the Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def planned_stream(docs: DataFrame) -> DataFrame:
    """Plans of arriving documents; stateless, so it runs in append mode without watermarks."""
    return features.planned(features.factors(corpus.paged_documents(docs))).select("doc_id", "page_count", "score", "level", "pipeline")


def converted_stream(docs: DataFrame, force: str | None = None) -> DataFrame:
    """Markdown of arriving documents."""
    return pipelines.adaptive(corpus.paged_documents(docs), force=force)


def run_to_parquet(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

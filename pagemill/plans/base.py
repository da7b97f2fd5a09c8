"""What the query modules share: a registry, page tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.sources import corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PAGED_SQL = """paged AS (SELECT doc_id, CAST(ceil(len(l) / 4.0) AS BIGINT) AS n, [array_to_string(l[i*4+1 : i*4+4], chr(10)) FOR i IN range(CAST(ceil(len(l) / 4.0) AS BIGINT))] AS pages
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))"""
PAGES_SQL = PAGED_SQL + """, dpages AS (SELECT doc_id, CAST(i + 1 AS BIGINT) AS page, pages[i + 1] AS text FROM (SELECT doc_id, pages, unnest(range(n)) AS i FROM paged))"""
LINES_SQL = """dlines AS (SELECT doc_id, CAST(i AS BIGINT) AS line_no, l[i + 1] AS line FROM (SELECT doc_id, l, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)))"""


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def docs(spark: SparkSession, d: str) -> DataFrame:
    return corpus.spread(corpus.table(spark, d, "documents").select("doc_id", "text"))


def pages(spark: SparkSession, d: str) -> DataFrame:
    return corpus.paginate(docs(spark, d))


def paged(spark: SparkSession, d: str) -> DataFrame:
    return corpus.paged_documents(docs(spark, d))


def joined(x):
    """An array of numbers as one string."""
    return F.array_join(F.transform(x, lambda v: v.cast("string")), ",")

"""All driver queries over the document-analytics operators, with their DuckDB oracles."""

from pagemill.plans import base, content_queries, layout_queries, markdown_queries, pdf_queries, pipeline_queries, text_queries  # noqa: F401

QUERIES = base.QUERIES
ORACLES = base.ORACLES

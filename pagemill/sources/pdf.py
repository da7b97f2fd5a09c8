"""What a PDF reader has to give, as rows, and what is made of them.

No PDF library is here: a reader (any source of rows with these columns) sits behind
``Reader``.  Text items, drawing operators, image objects and outline nodes of all
documents are tables with equi-keys, so that nothing but a page's own rows meet.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.operators import geometry


class Reader(Protocol):
    """Tables of a set of files."""

    def metadata(self) -> DataFrame:
        """(doc_id, title, author, creator, created, page_count); any but the first and the last may be null."""

    def items(self) -> DataFrame:
        """(doc_id, page, seq, text): text items in drawing order."""

    def operators(self) -> DataFrame:
        """(doc_id, page, seq, op, name): drawing operators; name: of the object that one paints."""

    def objects(self) -> DataFrame:
        """(doc_id, page, name, data, width, height): image objects, with nulls where they cannot be read."""

    def outline(self) -> DataFrame:
        """(doc_id, node, parent, title, dest): outline nodes; parent is null at the top, dest may be null."""

    def destinations(self) -> DataFrame:
        """(doc_id, dest, page_index): where destinations lead, pages from 0."""


def page_texts(items: DataFrame) -> DataFrame:
    """(doc_id, page, text): a page's items in order, joined by single spaces."""
    got = items.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("i"))
    return got.select("doc_id", "page", F.array_join(F.transform("i", lambda x: x["text"]), " ").alias("text"))


def outline_pages(nodes: DataFrame, destinations: DataFrame) -> DataFrame:
    """Nodes with the page (from 1) that they lead to; null for a destination that does not resolve."""
    at = destinations.groupBy("doc_id", "dest").agg((F.min("page_index") + 1).alias("page"))
    return nodes.join(at.hint("merge"), ["doc_id", "dest"], "left").select("doc_id", "node", "parent", "title", "page")


def embedded_images(operators: DataFrame, objects: DataFrame) -> DataFrame:
    """(doc_id, page, seq, width, height, data): painted images whose object has data and a size; others are left out."""
    painted = operators.where(F.col("op").isin(*geometry.IMAGES)).select("doc_id", "page", "seq", "name")
    whole = objects.where("data IS NOT NULL AND width > 0 AND height > 0")
    return painted.join(whole.hint("merge"), ["doc_id", "page", "name"]).select("doc_id", "page", "seq", "width", "height", "data")


def image_counts(pages: DataFrame, images: DataFrame) -> DataFrame:
    """(doc_id, page, images) for all pages: none where a page has none or could not be scanned."""
    n = images.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("images"))
    return pages.select("doc_id", "page").join(n.hint("merge"), ["doc_id", "page"], "left").select("doc_id", "page", F.coalesce("images", F.lit(0)).cast("long").alias("images"))

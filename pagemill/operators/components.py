"""Connected components of a table of links, by stars that grow and shrink in turns, and are written each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.sources.shared import written

ROUNDS = 64


def components(links: DataFrame) -> DataFrame:
    """(node, component) of links (a, b): the smallest node that each node reaches; nodes without a link to another are left out."""
    edges = written(links.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).where("low < high").distinct(), "links")
    told = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first()
    before = told(edges)
    for _ in range(ROUNDS):
        # Each node's larger neighbours move to the smallest node near it.
        ends = edges.select(F.col("low").alias("node"), F.col("high").alias("other")).unionAll(edges.select(F.col("high").alias("node"), F.col("low").alias("other")))
        least = ends.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("least"))
        moved = ends.where("other > node").join(least, "node").select(F.col("least").alias("low"), F.col("other").alias("high")).where("low < high").distinct()
        # Each node and its smaller neighbours move to the smallest of these.
        least = moved.groupBy("high").agg(F.min("low").alias("least"))
        star = moved.join(least, "high").select("least", F.explode(F.array("low", "high")).alias("high")).select(F.col("least").alias("low"), "high")
        edges = written(star.where("low < high").distinct(), "links")
        now = told(edges)
        if now == before:
            return edges.select(F.col("high").alias("node"), F.col("low").alias("component")).unionAll(edges.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct())
        before = now
    raise RuntimeError("links did not settle")

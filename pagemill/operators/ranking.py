"""Linked structures as tables: ranks along chains, and trees in pre-order, by pointer doubling.

A chain of n links takes about log2(n) rounds, each a join of the nodes with themselves,
whatever the length; no node's neighbourhood and no document meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.sources.shared import written


def ranked(nodes: DataFrame, key: str = "doc_id", weight: str | None = None) -> DataFrame:
    """From (key, node, to): (key, node, tail, rank): the last node of the chain that a node's links lead along, and the weight (default 1) of all
    nodes from the node to it, itself included.

    to is null, or a node of the key; a link to a node that is not there ends the chain.  On a cycle, or a way into
    one, tail and rank are null.  Of repeated nodes one counts.
    """
    one = nodes.groupBy(key, "node").agg(F.min(F.struct("to", *([F.col(weight).alias("w")] if weight else []))).alias("r"))
    w = F.coalesce(F.col("r.w"), F.lit(0)).cast("long") if weight else F.lit(1).cast("long")
    one = one.select(key, "node", F.col("r.to").alias("to"), w.alias("rank"))
    known = one.select(key, F.col("node").alias("to"), F.lit(True).alias("there"))
    at = one.join(known.hint("merge"), [key, "to"], "left").select(key, "node", F.when(F.col("there"), F.col("to")).alias("to"), "rank")
    at = written(at.withColumn("tail", F.when(F.col("to").isNull(), F.col("node"))), "chains")
    most = at.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(most.bit_length()):
        if at.where("to IS NOT NULL").isEmpty():
            break
        ahead = at.select(key, F.col("node").alias("to"), F.col("to").alias("to2"), F.col("rank").alias("rank2"), F.col("tail").alias("tail2"))
        step = at.join(ahead.hint("merge"), [key, "to"], "left")
        at = written(step.select(key, "node", F.col("to2").alias("to"), (F.col("rank") + F.coalesce("rank2", F.lit(0))).alias("rank"), F.coalesce("tail", "tail2").alias("tail")), "chains")
    whole = F.col("to").isNull()
    return at.select(key, "node", F.when(whole, F.col("tail")).alias("tail"), F.when(whole, F.col("rank")).alias("rank"))


def preorder(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """From (key, node, parent, first, next): (key, node, ordinal, depth) of the trees whose links come to an end.

    ordinal: from 0, a node before its children and these before its next sibling; each node without a parent that no
    other one's next leads to begins a tree of its own, counted from 0.  depth: from 0.  Nodes on cycles have nulls.
    """
    # Up from a node without a next one, to the nearest that has one.
    up = ranked(nodes.select(key, "node", F.when(F.col("next").isNull(), F.col("parent")).alias("to")), key)
    after = nodes.select(key, F.col("node").alias("tail"), F.col("next").alias("after"))
    follows = up.join(after.hint("merge"), [key, "tail"], "left").select(key, "node", "tail", "after")
    chain = nodes.join(follows.hint("merge"), [key, "node"]).select(key, "node", F.when(F.col("tail").isNotNull(), F.coalesce("first", "after")).alias("to"))
    places = ranked(chain, key).withColumnRenamed("rank", "left")
    depths = ranked(nodes.select(key, "node", F.col("parent").alias("to")), key).select(key, "node", (F.col("rank") - 1).alias("depth"))
    all_ = places.groupBy(key, "tail").agg(F.max("left").alias("all"))
    return places.join(all_.hint("merge"), [key, "tail"], "left").join(depths.hint("merge"), [key, "node"]).select(key, "node", (F.col("all") - F.col("left")).alias("ordinal"), "depth")

"""Connected components of a large graph by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm.shared import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``node`` and ``component``, its smallest reachable node, for every node with an edge.

    ``edges`` has long columns ``a`` and ``b``; loops, repeats and both directions are
    allowed.  Large stars hang each node's larger neighbours on its smallest one, small
    stars its smaller ones; the forest is flat after about log n rounds of joins, each
    written to the shared folder.
    """
    own = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    own = scratch.keep(own, f"{name}-0")
    before, step = None, 0
    while True:
        both = own.union(own.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(root, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        step += 1
        fresh = scratch.keep(small.union(root.select("a", F.col("m").alias("b"))).distinct(), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        own = fresh
        after = own.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    roots = own.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return own.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)

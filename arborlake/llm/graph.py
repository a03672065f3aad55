"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: longs); root is the least node of its component.

    Alternates large-star and small-star: each round points the larger (then the
    smaller) neighbours of every node to its least neighbour, until no edge
    changes. A round is two joins on the node, whose hot keys can be split, and
    a written table; the number of rounds is about the logarithm of the longest
    chain.
    """
    flat = lambda a, b: F.struct(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    now = scratch.table(edges.filter("a <> b").select(flat(F.col("a"), F.col("b")).alias("e")).select("e.*").distinct(), f"{name}0", merge=True)
    seen, k = None, 0
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, both["a"] == least["u"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        k += 1
        large = scratch.table(large.distinct(), f"{name}{k}", merge=True)
        # Small star: now every edge points down; a node's lower neighbours and itself go to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(least, large["a"] == least["u"]).select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b")
        k += 1
        now = scratch.table(small.distinct(), f"{name}{k}", merge=True)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}{k - 2}")
        scratch.drop(f"{name}{k - 1}")
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)

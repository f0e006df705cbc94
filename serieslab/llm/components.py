"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serieslab.llm.common import keep, materialise


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b; any ordered type): root is the smallest node reachable.

    Each round links a node's larger neighbours, then its smaller ones, to the smallest of them, and
    writes the edges; they become stars after a number of rounds logarithmic in the size of a
    component. Minima are partial before the shuffle and are kept before they are joined back, one row
    a node, so adaptive execution splits a node with very many edges.
    """
    edges = materialise(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = keep(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = both.filter("b > a").join(first, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = keep(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        least = keep(down.groupBy("a").agg(F.min("b").alias("m")))
        small = down.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        edges = materialise(small, "edges", (edges, first, down, least))
        # stars: every node has one root, and no root is a node of another
        several = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        inner = edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi")
        if several.isEmpty() and inner.isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspar.llm.common import materialise


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root for each node of the edges that isn't its component's smallest; root is the smallest.

    Each round hangs every larger neighbour of a node on its smallest neighbour, then every smaller one (and the node)
    on the smallest of those; the longest way shrinks by a constant factor. Rounds are written to the shared folder and
    end with the first whose edges are stars; only that verdict reaches the driver. Loops and repeated edges are allowed.
    """
    now = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    now = materialise(now, "components")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written before the join, which then reads plain exchanges and can split a hub's rows
        least = materialise(both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m")), "components-least")
        large = both.join(least, both["a"] == least["n"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialise(large, "components-large")
        least = materialise(large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")), "components-least")
        hung = large.join(least, large["a"] == least["n"]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialise(hung.unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct(), "components")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller node at most, and none if it has edges to larger ones."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ends = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not ends.agg(F.max((F.col("up") + F.col("down") > 1) & (F.col("up") > 0))).first()[0]

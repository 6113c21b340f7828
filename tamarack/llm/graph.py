"""Connected components of an edge table, by joins and minima alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.shared import has_rows, stored


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b: long); component is the smallest node reachable.

    Alternating stars: every node hands its larger neighbours, then its smaller ones, to the smallest
    node it knows. The rounds grow with the logarithm of a component's diameter. Each step is a grouped
    minimum (combined before the shuffle) and a join (which AQE splits where a node has very many
    neighbours); no neighbour list is ever gathered, and no round returns anything but one flag.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    now = stored(now, tag)
    while True:
        # large star: each neighbour above a node goes to the smallest of the node and its neighbours
        both = now.select(F.col("hi").alias("n"), F.col("lo").alias("m")).unionByName(now.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
        least = both.groupBy("n").agg(F.min("m").alias("m0")).select("n", F.least("n", "m0").alias("m0"))
        large = both.where("m > n").join(least, "n").select(F.col("m").alias("hi"), F.col("m0").alias("lo")).distinct()
        # small star: each neighbour below a node, and the node, go to the smallest of them
        low = large.groupBy("hi").agg(F.min("lo").alias("m0"))
        small = (
            large.join(low, "hi")
            .where("lo <> m0")
            .select(F.col("lo").alias("hi"), F.col("m0").alias("lo"))
            .unionByName(low.select("hi", F.col("m0").alias("lo")))
            .distinct()
        )
        then = stored(small, tag)
        # a forest of stars: no centre is itself below another
        if not has_rows(then.join(then.select(F.col("hi").alias("lo")), "lo", "left_semi")) and not has_rows(
            then.groupBy("hi").agg(F.min("lo").alias("x"), F.max("lo").alias("y")).where("x <> y")
        ):
            return then.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
                then.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
            )
        now = then

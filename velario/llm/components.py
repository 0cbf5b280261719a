"""Connected components of an edge table, by alternating large-star and small-star steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velario.llm.shared import saved


def components(edges: DataFrame, name="components") -> DataFrame:
    """``(node, root)``: the smallest node reachable from each node of ``edges(a, b)``.

    Each step links nodes to the smallest neighbour they know (Kiveris et al.,
    2014). It is a minimum per node, combined before the shuffle, and a join, in
    which Spark splits the rows of a hub; the number of edges never grows. Every
    step is written out, so a lost executor repeats one step at most. Rounds grow
    with the logarithm of the longest chain.
    """
    links = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                  .distinct(), name)
    while True:
        before = links
        # large star: neighbours above a node move to the smallest one near it
        both = before.select("a", "b").unionAll(before.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: neighbours below a node, and the node itself, move to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        near = large.join(low, "a")
        small = near.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionAll(
            low.select("a", F.col("low").alias("b")))
        links = saved(small.distinct(), name)
        # both are sets of links: equal if they are as many and none is new
        if links.count() == before.count() and links.join(before, ["a", "b"], "left_anti").isEmpty():
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))

"""Connected components by alternating stars, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.llm.cut import cut


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges(u, v); root is the least node of its component.

    A round hangs the larger neighbours of each node on its least one, then the smaller
    ones; the number of rounds grows with the logarithm of the nodes. Hubs are never gathered:
    the least neighbour is an aggregate, and the rest is a join that Spark can split.
    """
    both = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct()
    now = cut(both)
    state = None
    for _ in range(most_rounds):
        ways = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the second key makes Spark deal out both sides anew, so that it can split the rows of a hub
        least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.xxhash64("u").alias("k"), F.least("m", "u").alias("m"))
        large = ways.where("v > u").withColumn("k", F.xxhash64("u")).join(least, ["u", "k"]).select(F.col("m").alias("u"), "v").where("u < v").distinct()
        # now v has only smaller neighbours u
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        hung = large.join(least, "v").select(F.col("m"), F.col("u"), F.col("v"))
        small = hung.select(F.col("m").alias("u"), F.col("v")).unionByName(hung.select(F.col("m").alias("u"), F.col("u").alias("v"))).where("u < v").distinct()
        now = cut(small)
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (seen.n, seen.h) == state:
            break
        state = (seen.n, seen.h)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return roots.unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())

"""Trees that are a graph's components or hang from its 2-core, and the round in which peeling takes each of their nodes.

Each round of `hanging_trees` takes all chains that begin at an end, whatever their length: pointers along them double until every
node knows where each of its two ways leads. No more than the logarithm of the number of ends is needed of such rounds. What is left is the 2-core.

Peeling takes a node once at most one of its neighbours is left, and until then what lies behind each neighbour goes as it would if the
node stayed. So a node's round is one more than the second largest height of what lies behind its neighbours. Heights below come from pointers to
ancestors that double, and so do those above, from what the siblings of a node and of its ancestors have below them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.operators.state import cut


def ways_resolved(alive: DataFrame, degrees: DataFrame, rounds: list[int] | None) -> DataFrame:
    """(src, dst, end, exit): for each arc out of a node of degree 1 or 2 the node, of another degree than 2, that one comes to along it, and whether its degree is
    above 2; null on cycles. The numbers of open arcs are added to rounds."""
    slim = degrees.where("deg <= 2").select(F.col("node").alias("src"))
    arcs = alive.join(slim, "src", "left_semi").join(degrees.select(F.col("node").alias("dst"), "deg"), "dst")
    done = F.col("deg") != 2
    following = alive.select(F.col("src").alias("dst"), F.col("dst").alias("to"))
    stop = arcs.where(done).select("src", "dst", F.col("dst").alias("end"), (F.col("deg") > 2).alias("exit"), F.lit(None).cast("bigint").alias("at"), F.lit(None).cast("bigint").alias("to"))
    go = arcs.where(~done).join(following, "dst").where("to <> src").select("src", "dst", F.lit(None).cast("bigint").alias("end"), F.lit(None).cast("boolean").alias("exit"), F.col("dst").alias("at"), "to")
    now, before = cut(stop.unionByName(go)), None
    while True:
        count = now.where("end is null").count()
        if rounds is not None and count:
            rounds.append(count)
        # where an end can be reached, each round resolves some arc
        if not count or count == before:
            return now.select("src", "dst", "end", "exit")
        before = count
        ahead = now.select(F.col("src").alias("at"), F.col("dst").alias("to"), F.col("end").alias("end2"), F.col("exit").alias("exit2"), F.col("at").alias("at2"), F.col("to").alias("to2"))
        moved = now.where("end is null").join(ahead, ["at", "to"]).select("src", "dst", F.col("end2").alias("end"), F.col("exit2").alias("exit"), F.col("at2").alias("at"), F.col("to2").alias("to"))
        now = cut(now.where("end is not null").unionByName(moved))


def hanging_trees(ways: DataFrame, rounds: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(node, parent) of every node but the roots of trees, towards the 2-core or a root, and the arcs (src, dst) of the 2-core. ways: all arcs, both ways, without loops."""
    alive, found = ways, None
    while True:
        degrees = cut(alive.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("deg")))
        if degrees.where("deg = 1").isEmpty():
            none = ways.sparkSession.createDataFrame([], "node bigint, parent bigint")
            return none if found is None else found, alive
        out = ways_resolved(alive, degrees, rounds)
        # towards the bifurcation, or else towards the end of the larger number
        chosen = out.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("deg"), F.count_if("exit").alias("exits"), F.count_if(F.col("end").isNull()).alias("open"), F.max(F.struct("exit", "end", "dst")).alias("best"))
        taken = chosen.where("open = 0 and exits < 2")
        root = (F.col("deg") == 1) & (F.col("exits") == 0) & (F.col("best.end") < F.col("node"))
        taken = cut(taken.select("node", F.when(~root, F.col("best.dst")).alias("parent")))
        gone = taken.select("node")
        alive = cut(alive.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"))
        new = taken.where("parent is not null")
        found = cut(new if found is None else found.unionByName(new))


def heights(parents: DataFrame, core: DataFrame) -> DataFrame:
    """(node, parent, hung, height) of all nodes of trees: the most steps down to a node below, and whether the tree hangs from the core. The parent is null where it is of the core, or there is none."""
    inner = parents.join(core.withColumnRenamed("node", "parent").withColumn("hung", F.lit(True)), "parent", "left")
    inner = inner.select("node", F.when(F.col("hung").isNull(), F.col("parent")).alias("parent"), F.coalesce("hung", F.lit(False)).alias("hung"))
    roots = inner.select(F.col("parent").alias("node")).where("node is not null").distinct().join(inner, "node", "left_anti")
    first = inner.unionByName(roots.select("node", F.lit(None).cast("bigint").alias("parent"), F.lit(False).alias("hung")))
    now, step = cut(first.select("node", "parent", F.col("parent").alias("anc"), "hung", F.lit(0).cast("bigint").alias("height"))), 1
    while not now.where("anc is not null").isEmpty():
        lifted = now.where("anc is not null").groupBy(F.col("anc").alias("node")).agg((F.max("height") + step).alias("low"))
        above = now.select(F.col("node").alias("anc"), F.col("anc").alias("anc2"), F.col("hung").alias("hung2"))
        now = now.join(lifted, "node", "left").join(above, "anc", "left")
        now = cut(now.select("node", "parent", F.col("anc2").alias("anc"), (F.col("hung") | F.coalesce("hung2", F.lit(False))).alias("hung"), F.greatest("height", F.coalesce("low", "height")).alias("height")))
        step *= 2
    return now.drop("anc")


def fringe_layers(ways: DataFrame, rounds: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(node, layer) of the nodes that peeling at degree 1 takes, and the arcs that are left. A node whose last neighbours go in one round is never taken."""
    parents, alive = hanging_trees(ways, rounds)
    nodes = heights(parents, alive.select(F.col("src").alias("node")).distinct())
    below = nodes.where("parent is not null").select("node", "parent", (F.col("height") + 1).alias("d"))
    most = below.groupBy("parent").agg(F.max("d").alias("m1"))
    tops = cut(below.join(most, "parent").groupBy("parent", "m1").agg(F.count_if(F.col("d") == F.col("m1")).alias("n1"), F.max(F.when(F.col("d") < F.col("m1"), F.col("d"))).alias("less")))
    second = F.when(F.col("n1") > 1, F.col("m1")).otherwise(F.coalesce("less", F.lit(0)))
    tops = tops.select("parent", "m1", second.alias("m2"))
    # beside: the most that a sibling has below it, and so the height of what lies above, as seen through the parent alone
    beside = F.when(F.col("d") < F.col("m1"), F.col("m1")).otherwise(F.col("m2"))
    up, step = cut(below.join(tops, "parent").select("node", F.col("parent").alias("anc"), (beside + 1).alias("up"))), 1
    while not up.where("anc is not null").isEmpty():
        above = up.select(F.col("node").alias("anc"), F.col("anc").alias("anc2"), F.col("up").alias("up2"))
        up = up.join(above, "anc", "left").select("node", F.col("anc2").alias("anc"), F.greatest("up", F.coalesce(F.col("up2") + step, "up")).alias("up"))
        up = cut(up)
        step *= 2
    all_ = nodes.join(up.select("node", "up"), "node", "left").join(tops.withColumnRenamed("parent", "node"), "node", "left").fillna(0, ["m1", "m2"])
    up_ = F.coalesce("up", F.lit(0))
    layer = F.when(F.col("hung"), F.col("m1")).otherwise(F.greatest(F.least(up_, "m1"), "m2")) + 1
    # the two that go last go in one round
    lost = ~F.col("hung") & (layer > 1) & (F.greatest(up_, "m1") + 1 == layer)
    return cut(all_.where(~lost).select("node", layer.cast("int").alias("layer"))), alive

"""Chains of nodes with two neighbours, put in order by list ranking.

An edge makes two darts, one for each direction. A dart's predecessor is the one that leads into its tail, where the tail has two
neighbours. Pointers double: each round a dart takes over its pointer's pointer, so the number of rounds grows with the logarithm of the
longest chain; darts that have reached the start of their chain are left out of further rounds. What never gets there is a loop: it is
opened at its least node and ranked in the same way. Nothing holds a chain in one place but the arrays of the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crestline.operators.state import cut

#: Doublings; chains of 2 to this power of edges.
MOST_ROUNDS = 60


def darts_of(weighted: DataFrame) -> DataFrame:
    """(dart, tail, head, edge_id, w) from edges (edge_id, src, dst, w); an edge's darts are twice its id and one more."""
    there = weighted.select((F.col("edge_id") * 2).alias("dart"), F.col("src").alias("tail"), F.col("dst").alias("head"), "edge_id", "w")
    back = weighted.select((F.col("edge_id") * 2 + 1).alias("dart"), F.col("dst").alias("tail"), F.col("src").alias("head"), "edge_id", "w")
    return there.unionByName(back)


def ranked(open_: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From open_(dart, ptr, dist) and starts(dart): (dart, start, dist) of those that lead back to a start, and what is left, (dart, ptr, dist)."""
    done = [starts.select("dart", F.col("dart").alias("start"), F.lit(0).cast("bigint").alias("dist"))]
    open_ = cut(open_)
    for _ in range(MOST_ROUNDS):
        known = reduce(DataFrame.unionByName, done)
        ahead = known.select(F.col("dart").alias("ptr"), F.col("start").alias("to"), F.col("dist").alias("more"), F.lit(True).alias("home"))
        ahead = ahead.unionByName(open_.select(F.col("dart").alias("ptr"), F.col("ptr").alias("to"), F.col("dist").alias("more"), F.lit(False).alias("home")))
        step = cut(open_.join(ahead, "ptr").select("dart", "to", (F.col("dist") + F.col("more")).alias("dist"), "home"))
        new = step.where("home")
        if new.isEmpty():
            return known, open_
        done.append(new.select("dart", F.col("to").alias("start"), "dist"))
        open_ = step.where("not home").select("dart", F.col("to").alias("ptr"), "dist")
    raise RuntimeError("chains did not end")


def opened(loops: DataFrame, darts: DataFrame) -> DataFrame:
    """The darts at which loops(dart, ptr), ptr the predecessor, start: from the least node to the lesser of its neighbours."""
    now = cut(loops.join(darts.select("dart", F.col("tail").alias("least")), "dart").select("dart", "ptr", "least"))
    for _ in range(MOST_ROUNDS):
        ahead = now.select(F.col("dart").alias("ptr"), F.col("ptr").alias("to"), F.col("least").alias("other"))
        step = cut(now.join(ahead, "ptr").select("dart", F.col("to").alias("ptr"), F.least("least", "other").alias("least"), (F.col("other") < F.col("least")).alias("lower")))
        now = step.drop("lower")
        if step.where("lower").isEmpty():
            break
    else:
        raise RuntimeError("loops did not close")
    at = now.join(darts, "dart").where("tail = least").select("dart", "tail", "head")
    return at.groupBy("tail").agg(F.min(F.struct("head", "dart")).alias("first")).select("first.dart")


def chains(weighted: DataFrame, degrees: DataFrame) -> DataFrame:
    """(start, dart, dist, tail, head, edge_id, w) of the darts of each chain, from its proper start (named by its first dart) on.

    weighted: (edge_id, src, dst, w), each pair once. degrees: (node, deg)."""
    ends = degrees.where("deg <> 2").select("node", "deg")
    darts = cut(darts_of(weighted))
    starts = darts.join(ends.select(F.col("node").alias("tail"), F.col("deg").alias("d_tail")), "tail")
    inner = darts.join(ends.select(F.col("node").alias("tail")), "tail", "left_anti")
    into = darts.select(F.col("head").alias("tail"), F.col("tail").alias("before"), F.col("dart").alias("ptr"))
    open_ = cut(inner.join(into, "tail").where("before <> head").select("dart", "ptr", F.lit(1).cast("bigint").alias("dist")))
    found, rest = ranked(open_, starts.select("dart"))
    found = cut(found)
    # both directions of a chain are there: it begins at an end of one neighbour, else at the lesser end, else on the lesser side
    last = found.join(darts.join(ends.select(F.col("node").alias("head"), F.col("deg").alias("d_head")), "head").select("dart", F.col("head").alias("z"), F.col("tail").alias("before_z"), "d_head"), "dart")
    both = last.select("start", "z", "before_z", "d_head").join(starts.select(F.col("dart").alias("start"), F.col("tail").alias("a"), F.col("head").alias("after_a"), "d_tail"), "start")
    one, other = F.struct(F.col("d_tail") > 1, F.col("a"), F.col("after_a")), F.struct(F.col("d_head") > 1, F.col("z"), F.col("before_z"))
    kept = both.where(one < other).select("start")
    out = found.join(kept, "start")
    if not rest.isEmpty():
        loops = open_.join(rest.select("dart"), "dart", "left_semi")
        first = cut(opened(loops.select("dart", "ptr"), darts))
        # in the chosen direction the first dart has no predecessor, so ranks count from it; the other direction never gets there
        round_, _ = ranked(loops.join(first, "dart", "left_anti"), first)
        out = out.unionByName(round_.select(*out.columns))
    return out.join(darts, "dart")


def numbered_groups(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with name, from 0 in the given order, counted by ranges."""
    held = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over the partitions
    starts = held.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return held.withColumn("_place", place).join(F.broadcast(starts), "_part").withColumn(name, (F.col("_start") + F.col("_place") - 1).cast("bigint")).drop("_part", "_start", "_place")

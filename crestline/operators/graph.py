"""Measures and pruning of undirected graphs kept as edge tables.

edges(src, dst) may list a pair in both directions or more than once; functions say
whether that multiplicity counts. nodes(node, ...) names all nodes, isolated ones too.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crestline.functions.geometry import columns, distance
from crestline.operators import dense
from crestline.operators.dense import central, search_order
from crestline.operators.fringe import fringe_layers
from crestline.operators.state import cut, limits

DIMS = ("x", "y")


def canonical(edges: DataFrame) -> DataFrame:
    """Distinct pairs with src < dst."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src < dst").distinct()


def numbered(edges: DataFrame) -> DataFrame:
    """canonical edges with edge_id from 0 in the order of (src, dst), counted by ranges."""
    held = small(canonical(edges))
    if held is not None:
        keep = held.start < held.to
        order = np.lexsort((held.to[keep], held.start[keep]))
        found = pa.table({"edge_id": np.arange(len(order)), "src": held.ids[held.start[keep][order]], "dst": held.ids[held.to[keep][order]]})
        return edges.sparkSession.createDataFrame(found)
    return numbered_rows(canonical(edges))


def numbered_rows(edges: DataFrame) -> DataFrame:
    """All rows of edges(src, dst) with edge_id from 0 in the order of (src, dst), counted by ranges."""
    rows = edges.repartitionByRange("src", "dst").withColumn("_part", F.spark_partition_id())
    rows = cut(rows)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("src", "dst"))
    return rows.withColumn("_place", place).join(F.broadcast(starts), "_part").select((F.col("_start") + F.col("_place") - 1).alias("edge_id"), "src", "dst")


def small(edges: DataFrame) -> dense.Compact | None:
    """The graph of canonical edges(src, dst[, w]) if limits().edges lets it be held. Loops over such a graph run on it at once, or on
    copies of it in the tasks that hold the sources."""
    most = limits().edges
    if most < 0:
        return None
    rows = edges.limit(most + 1).toArrow()
    if rows.num_rows > most:
        return None
    src, dst = (rows.column(c).to_numpy().astype(np.int64) for c in ("src", "dst"))
    return dense.Compact(src, dst, rows.column("w").to_numpy().astype(float) if "w" in edges.columns else None)


def _walks(sources: DataFrame, held: dense.Compact, by_hops: bool) -> DataFrame:
    """(source, node, hops, len) from each source; the graph goes along with the task's function."""

    def run(batches):
        for batch in batches:
            for source in batch.column(0).to_pylist():
                at = held.place(source)
                if at < 0:
                    nodes, hops, lengths = np.array([source]), np.zeros(1, int), np.zeros(1)
                else:
                    places, hops, lengths = held.walk(at, by_hops)
                    nodes = held.ids[places]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), source)), pa.array(nodes), pa.array(hops.astype(np.int32)), pa.array(lengths)], ["source", "node", "hops", "len"])

    return sources.select(F.col("node").cast("long")).mapInArrow(run, "source bigint, node bigint, hops int, len double")


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, multiplicity kept."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def ends(nodes: DataFrame, edges: DataFrame, dims: Sequence[str] = DIMS) -> DataFrame:
    """edges with the coordinates of both ends, as a_d and b_d."""
    a = nodes.select(F.col("node").alias("src"), *[F.col(d).alias(f"a_{d}") for d in dims])
    b = nodes.select(F.col("node").alias("dst"), *[F.col(d).alias(f"b_{d}") for d in dims])
    return edges.join(a, "src").join(b, "dst")


def edge_weights(nodes: DataFrame, edges: DataFrame, dims: Sequence[str] = DIMS) -> DataFrame:
    """edges with w, their Euclidean length."""
    far = distance(columns(dims, "a_"), columns(dims, "b_"))
    return ends(nodes, edges, dims).withColumn("w", far).drop(*[f"{p}_{d}" for p in "ab" for d in dims])


def adjacency(edges: DataFrame, weight: str | None = None, dense: bool = False) -> DataFrame:
    """(row, col, val): symmetric sums over listed edges, or 1 for each distinct pair."""
    value = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = edges.select(F.col("src").alias("row"), F.col("dst").alias("col"), value.alias("val"))
    swapped = rows.select(F.col("col").alias("row"), F.col("row").alias("col"), "val")
    summed = rows.unionByName(swapped).groupBy("row", "col").agg(F.sum("val").alias("val"))
    return summed.withColumn("val", F.lit(1.0)) if dense else summed


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, deg) of every node, multiplicity counted."""
    counted = both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("deg"))
    return nodes.select("node").join(counted, "node", "left").select("node", F.coalesce("deg", F.lit(0)).alias("deg"))


def laplacian(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(row, col, val) of degree minus adjacency, multiplicity counted; rows of isolated nodes are missing."""
    diagonal = degree(nodes, edges).where("deg > 0").select(F.col("node").alias("row"), F.col("node").alias("col"), F.col("deg").cast("double").alias("val"))
    return diagonal.unionByName(adjacency(edges).select("row", "col", (-F.col("val")).alias("val")))


def neighbour_edges(lists: DataFrame, *, drop_self: bool = True) -> DataFrame:
    """(src, dst) from (node, neighbours array): self dropped by value, or else the first entry by place."""
    spread = lists.select(F.col("node").alias("src"), F.posexplode("neighbours").alias("_i", "dst"))
    return spread.where("src <> dst" if drop_self else "_i > 0").select("src", "dst")


def neighbour_lists(edges: DataFrame) -> DataFrame:
    """(node, neighbours): distinct neighbours in ascending order."""
    return both_ways(edges).where("src <> dst").groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_set("dst")).alias("neighbours"))


def edge_lines(nodes: DataFrame, edges: DataFrame, dims: Sequence[str] = DIMS, gaps: bool = True) -> DataFrame:
    """For each edge its ends as one array a dimension, with a null behind if gaps."""
    tail = [F.lit(None).cast("double")] if gaps else []
    return ends(nodes, edges, dims).select("src", "dst", *[F.array(F.col(f"a_{d}"), F.col(f"b_{d}"), *tail).alias(d) for d in dims])


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, comp): comp is the least node of the component.

    Each round gives a node the least label around it and then that label's own label, so the number of rounds
    grows with the logarithm of the longest path.
    """
    held = small(canonical(edges))
    if held is not None:
        label = held.labels()
        known = nodes.sparkSession.createDataFrame([(int(a), int(b)) for a, b in zip(held.ids, held.ids[label], strict=True)], "node bigint, comp bigint")
        return nodes.select("node").join(known, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))
    ways = cut(both_ways(canonical(edges)))
    now = cut(nodes.select("node", F.col("node").alias("comp")))
    for _ in range(most_rounds):
        around = ways.join(now.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("comp").alias("m"))
        lowered = now.join(around, "node", "left").select("node", F.col("comp").alias("old"), F.least("comp", F.coalesce("m", "comp")).alias("comp"))
        # the label of the label; hooks of a label seen at any member reach all its members
        hooks = lowered.groupBy(F.col("old").alias("key")).agg(F.min("comp").alias("h"))
        jumped = lowered.join(hooks, F.col("comp") == F.col("key"), "left").select("node", "old", F.least("comp", F.coalesce("h", "comp")).alias("comp"))
        jumped = cut(jumped)
        changed = jumped.where("old <> comp").limit(1).count()
        now = jumped.select("node", "comp")
        if not changed:
            return now
    raise RuntimeError("components did not settle")


def giant_component(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, in_giant): 1 in the largest component (of equals, that of the least node), else 0; -1 for every node of a graph without edges."""
    parts = components(nodes, edges)
    sizes = parts.groupBy("comp").agg(F.count("*").alias("n"))
    best = sizes.orderBy(F.desc("n"), "comp").limit(1).collect()
    if not best or best[0].n < 2:
        return nodes.select("node", F.lit(-1).alias("in_giant"))
    return parts.select("node", (F.col("comp") == best[0].comp).cast("int").alias("in_giant"))


#: Fronts of a search that are read as one table from then on.
MERGED_FRONTS = 40


def hop_distances(edges: DataFrame, sources: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(source, node, hops) for every node that can be reached from each of sources(node), by rounds of frontiers. A neighbour of a front lies in it,
    in the one before or in the next, so a round looks at no others. An error if the search is not over after most_rounds, where given."""
    held = small(canonical(edges))
    if held is not None:
        return _walks(sources, held, True).select("source", "node", "hops")
    ways = cut(both_ways(canonical(edges)))
    front = cut(sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("hops")))
    before, seen = front.limit(0), [front]
    for step in itertools.count(1):
        if step == most_rounds:
            raise RuntimeError("paths are longer than the rounds allowed")
        near = front.select("source", F.col("node").alias("src")).join(ways, "src").select("source", F.col("dst").alias("node")).distinct()
        new = near.join(front.unionByName(before).select("source", "node"), ["source", "node"], "left_anti")
        before, front = front, cut(new.withColumn("hops", F.lit(step)))
        if front.isEmpty():
            return reduce(DataFrame.unionByName, seen)
        seen.append(front)
        if len(seen) > MERGED_FRONTS:
            seen = [cut(reduce(DataFrame.unionByName, seen))]


def diameter(nodes: DataFrame, edges: DataFrame, searches: list[int] | None = None) -> int:
    """Most hops between two connected nodes. A search from a node bounds how far any other of its component can be from its furthest one; only nodes that might still
    be further than what was found are searched from, one in each component at a time, in turn the one of the largest bound and the most
    central one. The numbers of sources are added to searches."""
    flat = canonical(edges)
    held = small(flat)
    if held is not None:
        return held.diameter(searches)
    flat = cut(flat)
    parts = cut(components(nodes, flat))
    sizes = parts.groupBy("comp").agg((F.count("*") - 1).alias("high")).where("high > 0")
    state = cut(parts.join(sizes, "comp").select("node", "comp", F.lit(0).cast("bigint").alias("low"), "high", F.lit(0).alias("hops"), F.lit(True).alias("open"), F.lit(False).alias("searched")))
    best = 0
    for turn in itertools.count():
        # a central node may bound the others well though it is itself no end of a longest path
        able = state.where("not searched" if central(turn) else "open")
        pick = F.min(F.struct(search_order(F.col("hops"), F.col("low"), F.col("high"), turn).alias("o"), "node"))
        sources = cut(able.groupBy("comp").agg(pick.alias("p")).select("comp", "p.node"))
        count = sources.count()
        if searches is not None and count:
            searches.append(count)
        if not count:
            return best
        found = cut(hop_distances(flat, sources.select("node")))
        far = found.groupBy("source").agg(F.max("hops").alias("ecc"))
        best = max(best, far.agg(F.max("ecc").alias("e")).first().e)
        known = found.join(far, "source").select("node", "hops", "ecc")
        low, high = F.greatest("low", "hops", F.col("ecc") - F.col("hops")), F.least("high", F.col("ecc") + F.col("hops"))
        tight = state.drop("hops").join(known, "node").select("node", "comp", low.alias("low"), high.alias("high"), "hops", (F.col("searched") | (F.col("hops") == 0)).alias("searched"))
        tight = cut(tight.withColumn("open", (F.col("high") > best) & (F.col("low") < F.col("high")) & ~F.col("searched")))
        state = tight.join(tight.where("open").select("comp").distinct(), "comp", "left_semi")


def path_lengths(nodes: DataFrame, edges: DataFrame, sources: DataFrame, dims: Sequence[str] = DIMS, fewest_hops: bool = True, most_rounds: int = 10_000) -> DataFrame:
    """(source, node, hops, len): Euclidean length along the path of fewest hops (ties: the shortest such), or else the shortest length."""
    weighted = edge_weights(nodes, canonical(edges), dims)
    held = small(weighted)
    if held is not None:
        return _walks(sources, held, fewest_hops)
    ways = cut(weighted.select("src", "dst", "w").unionByName(weighted.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")))
    best = front = cut(sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("hops"), F.lit(0.0).alias("len")))
    for step in range(1, most_rounds):
        out = front.select("source", F.col("node").alias("src"), "len").join(ways, "src")
        out = out.groupBy("source", F.col("dst").alias("node")).agg(F.min(F.col("len") + F.col("w")).alias("new"))
        known = best.select("source", "node", F.col("len").alias("known"))
        reached = out.join(known, ["source", "node"], "left").where("known is null" if fewest_hops else "known is null or new < known - 1e-12")
        front = cut(reached.select("source", "node", F.lit(step).alias("hops"), F.col("new").alias("len")))
        if front.isEmpty():
            return best
        best = cut(best.join(front.select("source", "node"), ["source", "node"], "left_anti").unionByName(front))
    raise RuntimeError("paths are longer than the rounds allowed")


def shortest_path(edges: DataFrame, start: int, stop: int) -> DataFrame:
    """(step, node) along a path of fewest hops from start to stop, the least former node at each step; empty if there is none."""
    spark = edges.sparkSession
    flat = cut(canonical(edges))
    hops = cut(hop_distances(flat, spark.createDataFrame([(start,)], "node bigint")).select("node", "hops"))
    if hops.where(F.col("node") == stop).isEmpty():
        return spark.createDataFrame([], "step int, node bigint")
    ends_ = both_ways(flat).join(hops.select(F.col("node").alias("src"), F.col("hops").alias("h")), "src").join(hops.select(F.col("node").alias("dst"), F.col("hops").alias("former")), "dst")
    ptr = cut(ends_.where("former = h - 1").groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("ptr")))
    # pointers double, and so do the nodes known to lie on the path
    path = hops.where(F.col("node") == stop).select("node")
    while True:
        more = path.join(ptr, "node").select(F.col("ptr").alias("node")).join(path, "node", "left_anti")
        more = cut(more)
        if more.isEmpty():
            return hops.join(path, "node").select(F.col("hops").cast("int").alias("step"), "node")
        path = cut(path.unionByName(more))
        ptr = cut(ptr.join(ptr.select(F.col("node").alias("ptr"), F.col("ptr").alias("further")), "ptr").select("node", F.col("further").alias("ptr")))


def edge_id_of(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(src, dst) in any direction with edge_id, null where there is no such edge."""
    ways = edges.select("edge_id", F.least("src", "dst").alias("_a"), F.greatest("src", "dst").alias("_b"))
    asked = pairs.withColumn("_a", F.least("src", "dst")).withColumn("_b", F.greatest("src", "dst"))
    return asked.join(ways, ["_a", "_b"], "left").drop("_a", "_b")


def onion_layers(nodes: DataFrame, edges: DataFrame, searches: list[int] | None = None) -> DataFrame:
    """(node, coreness, layer, global_layer) by peeling: each round takes all nodes of degree from 1 to the core's number; the core
    rises once every node left has a larger degree. Nodes that lose their last edge without being taken, and isolated ones, get
    the last core and its layer counter. All that goes at degree 1 (trees, whatever their depth) is worked out at once (operators/fringe.py);
    the cores beyond are peeled round by round. The numbers of open pointers of the rounds are added to searches."""
    held = small(canonical(edges))
    if held is not None:
        a, b, c, core, layer = held.peel()
        took = [(int(i), *map(int, v)) for i, *v in zip(held.ids, a, b, c, strict=True) if v[0]]
        known = nodes.sparkSession.createDataFrame(took, "node bigint, coreness int, layer int, global_layer int")
        rest = (core, layer, layer)
        return nodes.select("node").join(known, "node", "left").select("node", *[F.coalesce(n, F.lit(v)).alias(n) for n, v in zip(("coreness", "layer", "global_layer"), rest, strict=True)])
    # what goes at degree 1 takes rounds by the logarithm of its length
    first, alive = fringe_layers(cut(both_ways(canonical(edges)).where("src <> dst")), searches)
    last = first.agg(F.max("layer").alias("m")).first().m or 1
    parts = [first.select("node", F.lit(1).alias("coreness"), "layer", F.col("layer").alias("global_layer"))]
    core, layer, rounds = 1, last + 1, last + 1
    while not alive.isEmpty():
        if alive.groupBy("src").count().agg(F.min("count").alias("m")).first().m >= core + 1:
            core, layer = core + 1, 1
        degrees = alive.groupBy("src").agg(F.count("*").alias("deg"))
        peeled = cut(degrees.where(F.col("deg") <= core).select(F.col("src").alias("node"), F.lit(core).alias("coreness"), F.lit(layer).alias("layer"), F.lit(rounds).alias("global_layer")))
        gone = peeled.select("node")
        alive = cut(alive.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"))
        parts.append(peeled)
        if len(parts) > MERGED_FRONTS:
            parts = [cut(reduce(DataFrame.unionByName, parts))]
        layer, rounds = layer + 1, rounds + 1
    taken = reduce(DataFrame.unionByName, parts)
    left = nodes.select("node").join(taken, "node", "left_anti")
    return taken.unionByName(left.select("node", F.lit(core).alias("coreness"), F.lit(layer).alias("layer"), F.lit(layer).alias("global_layer")))


def prune(nodes: DataFrame, edges: DataFrame, level: int) -> DataFrame:
    """Nodes whose global onion layer is above level."""
    return nodes.join(onion_layers(nodes, edges).where(F.col("global_layer") > level).select("node"), "node", "left_semi")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes."""
    kept = nodes.select("node")
    return edges.join(kept.withColumnRenamed("node", "src"), "src", "left_semi").join(kept.withColumnRenamed("node", "dst"), "dst", "left_semi")


def terminal_branches(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, branch): nodes of the chains that lead from an end (degree 1) up to a bifurcation (degree above 2), which is not part
    of them, or to another end; branch is the least end of the chain."""
    flat = canonical(edges)
    degrees = degree(nodes, flat)
    slim = degrees.where("deg between 1 and 2").select("node")
    chains = components(slim, induced(flat, slim))
    tips = degrees.where("deg = 1").select("node")
    named = chains.join(tips, "node", "left_semi").groupBy("comp").agg(F.min("node").alias("branch"))
    return chains.join(named, "comp").select("node", "branch")


def cut_short_branches(nodes: DataFrame, edges: DataFrame, most_nodes: int) -> DataFrame:
    """Nodes left after removing terminal branches of most_nodes nodes or fewer, once."""
    branches = terminal_branches(nodes, edges)
    short = branches.groupBy("branch").agg(F.count("*").alias("n")).where(F.col("n") <= most_nodes).select("branch")
    return nodes.join(branches.join(short, "branch", "left_semi").select("node"), "node", "left_anti")


def cut_short_branches_fully(nodes: DataFrame, edges: DataFrame, most_nodes: int) -> DataFrame:
    """cut_short_branches until nothing changes; nodes without edges at that point are left out."""
    kept, n = cut(nodes), -1
    while n != (n := kept.count()):
        inner = induced(edges, kept)
        kept = cut(cut_short_branches(kept, inner, most_nodes))
    return kept.join(degree(kept, induced(edges, kept)).where("deg > 0").select("node"), "node", "left_semi")

"""Graph builders over points: neighbours, ranges, trees, proximity graphs.

Each builder takes nodes(node, x, y[, z]) and returns edges(src, dst). TOPOLOGIES
names those that a fit may use.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crestline.functions.geometry import columns, eigenvalues_2d, squared_distance
from crestline.functions.stats import covariance
from crestline.operators import dense, pyramid
from crestline.operators.delaunay import delaunay_by_cells
from crestline.operators.graph import canonical, components, diameter, edge_weights, ends, giant_component
from crestline.operators.spatial import knn_join, range_join
from crestline.operators.state import cut, limits

DIMS = ("x", "y")
#: Nodes of a full graph, whose edges are quadratic in them.
FULL_NODES = 20_000


def knn(nodes: DataFrame, k: int, dims: Sequence[str] = DIMS) -> DataFrame:
    """Directed edges to the k - 1 nearest other nodes (a node counts as its own first), with rank and d2."""
    found = knn_join(nodes, nodes, k - 1, query_id="node", point_id="node", dims=dims, exclude_self=True)
    return found.select(F.col("q_id").alias("src"), F.col("p_id").alias("dst"), "rank", "d2")


def knn_graph(nodes: DataFrame, k: int = 10, dims: Sequence[str] = DIMS) -> DataFrame:
    """Directed neighbour pairs; a mutual pair is listed both ways."""
    return knn(nodes, k, dims).select("src", "dst").distinct()


def reciprocal_knn_graph(nodes: DataFrame, k: int = 15, dims: Sequence[str] = DIMS) -> DataFrame:
    """Pairs that are neighbours of each other, both ways."""
    found = knn_graph(nodes, k, dims)
    return found.join(found.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"])


def fixed_length(nodes: DataFrame, radius: float, dims: Sequence[str] = DIMS) -> DataFrame:
    """(src, dst, d2) within radius, a node and itself included."""
    found = range_join(nodes, nodes, radius, left_id="node", right_id="node", dims=dims)
    return found.select(F.col("r_id").alias("src"), F.col("l_id").alias("dst"), "d2")


def fixed_length_graph(nodes: DataFrame, radius: float = 150, dims: Sequence[str] = DIMS) -> DataFrame:
    return fixed_length(nodes, radius, dims).where("src <> dst").select("src", "dst")


def sphere_of_influence(nodes: DataFrame, k: float, dims: Sequence[str] = DIMS) -> DataFrame:
    """t to s where 0 < d(t, s) < k times the distance of t to its nearest other node."""
    near = knn(nodes, 2, dims).select(F.col("src").alias("node"), (F.sqrt("d2") * k).alias("reach"))
    found = range_join(nodes, nodes.join(near, "node"), "reach", left_id="node", right_id="node", dims=dims)
    return found.where("d2 > 0 and d2 < r_reach * r_reach").select(F.col("r_id").alias("src"), F.col("l_id").alias("dst"))


def ellipsoid(nodes: DataFrame, radius: float, dims: Sequence[str] = DIMS, *, least: int = 15, margin: float = 500, border: float = 75_000) -> DataFrame:
    """Within 0 < d < radius; in two dimensions a node with more than `least` points in its ball, itself included, that keeps a margin to the
    border of the domain, takes instead those in an ellipse along the local covariance, radius times r long and radius over r wide, where r is the root
    of the ratio of eigenvalues, and the long side lies along the larger one."""
    ball = range_join(nodes, nodes, radius, left_id="node", right_id="node", dims=dims)
    inside = ball.where(f"(d2 > 0 and d2 < {radius * radius}) or l_id = r_id")
    plain = inside.where("l_id <> r_id").select(F.col("r_id").alias("src"), F.col("l_id").alias("dst"))
    if len(dims) != 2:
        return plain
    x, y = dims
    shape = covariance(inside.select(F.col("r_id").alias("node"), *[F.col(f"l_{d}").alias(d) for d in dims]), ["node"], dims).where(F.col("n") > least)
    large, small = eigenvalues_2d(F.col(f"c_{x}{x}"), F.col(f"c_{y}{y}"), F.col(f"c_{x}{y}"))
    shape = shape.withColumn("l1", large).withColumn("l2", F.greatest(small, F.lit(0.0))).where("l2 > 0")
    ratio = F.sqrt(F.col("l1") / F.col("l2"))
    # direction of the smaller eigenvalue; along it the ellipse is the narrower
    off = F.col(f"c_{x}{y}")
    axis_x = F.when(off != 0, off).otherwise(F.when(F.col(f"c_{x}{x}") <= F.col(f"c_{y}{y}"), 1.0).otherwise(0.0))
    axis_y = F.when(off != 0, F.col("l2") - F.col(f"c_{x}{x}")).otherwise(F.when(F.col(f"c_{x}{x}") <= F.col(f"c_{y}{y}"), 0.0).otherwise(1.0))
    size = F.sqrt(axis_x * axis_x + axis_y * axis_y)
    free = " and ".join(f"{d} > {margin} and {d} < {border - margin}" for d in dims)
    shaped = nodes.where(free).join(shape.select("node", (radius * ratio).alias("long"), (radius / ratio).alias("short"), (axis_x / size).alias("ux"), (axis_y / size).alias("uy")), "node")
    found = range_join(nodes, shaped, "long", left_id="node", right_id="node", dims=dims, right_extra=["short", "ux", "uy"])
    dx, dy = F.col(f"l_{x}") - F.col(f"r_{x}"), F.col(f"l_{y}") - F.col(f"r_{y}")
    u, v = dx * F.col("r_ux") + dy * F.col("r_uy"), dx * F.col("r_uy") - dy * F.col("r_ux")
    within = (u * u / (F.col("r_short") * F.col("r_short")) + v * v / (F.col("r_long") * F.col("r_long"))) <= 1
    curved = found.where(within & (F.col("l_id") != F.col("r_id"))).select(F.col("r_id").alias("src"), F.col("l_id").alias("dst"))
    return plain.join(shaped.select(F.col("node").alias("src")), "src", "left_anti").unionByName(curved)


def best_radius(nodes: DataFrame, radii: Iterable[float], build: Callable[[DataFrame, float], DataFrame], measure: Callable[[DataFrame, DataFrame], float]) -> tuple[float, float]:
    """The first radius with the largest measure of its graph, and that measure."""
    found = [(measure(nodes, build(nodes, r)), r) for r in radii]
    most = max(m for m, _ in found)
    return next(r for m, r in found if m == most), most


def weighted_diameter(nodes: DataFrame, edges: DataFrame, dims: Sequence[str] = DIMS) -> float:
    """Longest of the shortest Euclidean path lengths between connected nodes."""
    from crestline.operators.graph import path_lengths

    return path_lengths(nodes, edges, nodes, dims, fewest_hops=False).agg(F.max("len").alias("d")).first().d or 0.0


def best_fixed_length(nodes: DataFrame, radii: Iterable[float], weighted: bool = False) -> tuple[float, float]:
    """Radius of the largest diameter, in hops or by length."""
    return best_radius(nodes, radii, fixed_length_graph, weighted_diameter if weighted else diameter)


def best_ellipsoid(nodes: DataFrame, radii: Iterable[float]) -> tuple[float, float]:
    return best_radius(nodes, radii, ellipsoid, diameter)


def giant_size(nodes: DataFrame, edges: DataFrame) -> int:
    return giant_component(nodes, edges).where("in_giant = 1").count()


def best_giant(nodes: DataFrame, radii: Iterable[float]) -> tuple[float, float]:
    """Radius of the largest giant component."""
    return best_radius(nodes, radii, fixed_length_graph, giant_size)


def gradient_graph(nodes: DataFrame, info: str, k1: int, k2: int, dims: Sequence[str] = DIMS) -> DataFrame:
    """Of the k1 - 1 nearest nodes the k2 - 1 with the highest info, ties to the nearer."""
    near = knn(nodes, k1, dims).join(nodes.select(F.col("node").alias("dst"), F.col(info).alias("_info")), "dst")
    order = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("_info"), "rank"))
    return near.withColumn("_o", order).where(F.col("_o") <= k2 - 1).select("src", "dst")


def full_graph(nodes: DataFrame, most_nodes: int = FULL_NODES) -> DataFrame:
    """All pairs, the larger node first; quadratic by definition, so an error beyond most_nodes nodes."""
    if nodes.limit(most_nodes + 1).count() > most_nodes:
        raise ValueError(f"more than {most_nodes} nodes make too many pairs")
    a, b = nodes.select(F.col("node").alias("src")), nodes.select(F.col("node").alias("dst"))
    return a.join(b, F.col("src") > F.col("dst"))


def _by_rep(nodes: DataFrame, edges_of: Callable[[np.ndarray, np.ndarray], np.ndarray], dims: Sequence[str], rep: str | None, out: str = "src bigint, dst bigint") -> DataFrame:
    """Run a dense routine over the places and ids of the nodes of each replica in one task; edges come back as node ids."""
    rows = nodes.select((F.col(rep) if rep else F.lit(0)).cast("int").alias("rep"), F.col("node").cast("long").alias("node"), *dims)

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("node").to_numpy()
        order = np.argsort(ids, kind="stable")
        x = np.stack([table.column(d).to_numpy()[order] for d in dims], 1).astype(float)
        pairs = edges_of(x, ids[order])
        found = ids[order][pairs] if len(pairs) else np.zeros((0, 2), np.int64)
        return pa.table({"rep": pa.array(np.full(len(found), table.column("rep")[0].as_py(), np.int32)), "src": pa.array(found[:, 0]), "dst": pa.array(found[:, 1])})

    found = rows.groupBy("rep").applyInArrow(run, f"rep int, {out}")
    return found.withColumnRenamed("rep", rep) if rep else found.drop("rep")


def mst(nodes: DataFrame, dims: Sequence[str] = DIMS, rep: str | None = None, local_nodes: int | None = None, rep_nodes: int | None = None) -> DataFrame:
    """Euclidean minimum spanning tree, edges with src < dst, ties by (length, src, dst). With rep, a tree for each replica.

    Up to local_nodes nodes (limits().trees, if not given) a tree is grown in one task, replicas in parallel; larger sets grow by rounds of joins, all replicas in the same ones.
    rep_nodes: the nodes of a replica, where that is known."""
    most = limits().trees if local_nodes is None else local_nodes
    if rep and rep_nodes is not None and rep_nodes <= most:
        return _by_rep(nodes, lambda x, _: dense.spanning_tree(x), dims, rep)
    if rep:
        sizes = nodes.groupBy(rep).agg(F.count("*").alias("n")).orderBy(rep).collect()
        if not sizes or max(r.n for r in sizes) <= most:
            return _by_rep(nodes, lambda x, _: dense.spanning_tree(x), dims, rep)
        return trees_by_rounds(nodes, dims, rep, [r[rep] for r in sizes], max(r.n for r in sizes))
    if nodes.limit(most + 1).count() <= most:
        return _by_rep(nodes, lambda x, _: dense.spanning_tree(x), dims, None)
    return boruvka(nodes, dims)


def trees_by_rounds(nodes: DataFrame, dims: Sequence[str], rep: str, reps: Sequence, most: int) -> DataFrame:
    """(rep, src, dst): the trees of all replicas, of at most `most` nodes each, by the same rounds. A node of a replica has a number that keeps the order of
    replicas and nodes, so that ties go as they do within a replica."""
    held = cut(nodes.select(rep, F.col("node").cast("long").alias("node"), *dims))
    number = cut(held.select("node").distinct().orderBy("node").select("node", F.monotonically_increasing_id().alias("_n")))
    bits = int(number.agg(F.max("_n").alias("m")).first().m).bit_length()
    if len(reps).bit_length() + bits > 62:
        raise ValueError("too many replicas to number their nodes")
    place = nodes.sparkSession.createDataFrame(list(zip(reps, range(len(reps)), strict=True)), f"{rep} {nodes.schema[rep].dataType.simpleString()}, _r int")
    whole = F.shiftleft(F.col("_r").cast("long"), bits) + F.col("_n")
    numbered = held.join(F.broadcast(place), rep).join(number, "node").select("_r", whole.alias("node"), *dims)
    tree = boruvka(numbered, dims, key="_r", n=most, keys=len(reps), bits=bits)
    tree = tree.select(F.shiftright("src", bits).cast("int").alias("_r"), *[F.col(c).bitwiseAND(F.lit((1 << bits) - 1)).alias(c) for c in ("src", "dst")])
    own = [number.select(F.col("node").alias(f"_{c}"), F.col("_n").alias(c)) for c in ("src", "dst")]
    found = tree.join(own[0], "src").join(own[1], "dst").join(F.broadcast(place), "_r")
    return found.select(rep, F.col("_src").alias("src"), F.col("_dst").alias("dst"))


def sure_edges(placed: pyramid.Pyramid) -> tuple[DataFrame | None, DataFrame]:
    """Edges (src, dst) of the trees that the points of an upper cell decide alone, and (id, comp) of all points by them. An edge of the cell's own tree is one of the whole tree if it
    is shorter than the way to the cell's rim from all that shorter edges bind to one of its ends. Without upper cells there are none."""
    rows, dims = placed.rows, placed.dims
    if placed.upper is None:
        return None, cut(rows.select("id", F.col("id").alias("comp")))
    side, value = placed.upper
    cells = len(side) + 1

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], np.stack([table.column(d).to_numpy()[order] for d in dims], 1)
        pairs = dense.spanning_tree(x)
        comp, sure = dense.sure_pairs(x, pairs, pyramid.rim(x, table.column("cell")[0].as_py() % cells, side, value))
        none = pa.nulls(len(ids) - len(sure), pa.int64())
        src, dst = (pa.concat_arrays([pa.array(ids[sure[:, j]]), none]) for j in (0, 1))
        return pa.table({"id": ids, "comp": ids[comp], "src": src, "dst": dst})

    named = rows.select("id", *dims, F.expr(f"shiftright(code, {placed.lower})").alias("cell"))
    found = cut(named.groupBy("cell").applyInArrow(run, "id bigint, comp bigint, src bigint, dst bigint"))
    return found.where("src is not null").select("src", "dst"), found.select("id", "comp")


def boruvka(nodes: DataFrame, dims: Sequence[str] = DIMS, k: int = 8, most_rounds: int = 64, looked: list[int] | None = None, key: str | None = None, n: int | None = None, keys: int = 1, bits: int = 0) -> DataFrame:
    """The same tree by rounds, after what is sure within upper cells: each component takes its shortest way out. It is among the k nearest neighbours of its nodes, unless some node
    has all its neighbours inside and might have a nearer foreign one beyond them; such nodes descend through cells for it, past those that hold
    their own component only. The numbers of compared pairs are added to looked. With key (whole numbers from 0 on, of which there are keys), a tree for each value,
    which the bits of a node's number beyond `bits` must be; n: at most so many nodes of each."""
    n = nodes.count() if n is None else n
    if n < 2:
        return nodes.sparkSession.createDataFrame([], "src bigint, dst bigint")
    k = min(k, n - 1)
    placed = pyramid.plant(nodes, n, id_col="node", dims=dims, leaf=pyramid.leaf_size(k + 1), need=k + 1, key=key, keys=keys)
    near = cut(pyramid.nearest(placed, placed, k, exclude_self=True, looked=looked).select(F.col("q_id").alias("src"), F.col("p_id").alias("dst"), "d2"))
    reach = cut(near.groupBy("src").agg(F.max("d2").alias("known")))
    tree, label = sure_edges(placed)
    for _ in range(most_rounds):
        named, other = label.withColumnRenamed("id", "src"), label.select(F.col("id").alias("dst"), F.col("comp").alias("other"))
        # what has come to lie inside a component stays there, so lists shrink as components grow
        seen = cut(near.join(named, "src").join(other, "dst").where(F.col("comp") != F.col("other")))
        near = seen.select("src", "dst", "d2")
        edge = F.struct("d2", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        # both ends see an edge, so that components agree on the order of edges
        ways = seen.select("comp", edge.alias("e")).unionByName(seen.select(F.col("other").alias("comp"), edge.alias("e")))
        best = ways.groupBy("comp").agg(F.min("e").alias("e"))
        inside = named.join(reach, "src").join(seen.select("src").distinct(), "src", "left_anti")
        seekers = cut(inside.join(best.select("comp", F.col("e.d2").alias("bound")), "comp", "left").where("bound is null or known <= bound").select(F.col("src").alias("id"), F.coalesce("bound", F.lit(float("inf"))).alias("bound")))
        new = best
        if not seekers.isEmpty():
            found = pyramid.ways_out(placed, label, seekers, looked=looked)
            new = new.unionByName(found.select("comp", F.struct("d2", "src", "dst").alias("e"))).groupBy("comp").agg(F.min("e").alias("e"))
        new = cut(new.select("e.src", "e.dst").distinct())
        tree = new if tree is None else tree.unionByName(new)
        # components hang together by their new edges; their nodes follow in one join
        comps = label.select(F.col("comp").alias("node")).distinct()
        links = new.join(named.withColumnRenamed("comp", "a"), "src").join(other.withColumnRenamed("other", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
        merged = cut(components(comps, links))
        # a tree is complete once its key has one component; its nodes take no further part
        of = F.shiftright("comp", bits) if key else F.lit(0)
        left = cut(merged.select("comp").distinct().groupBy(of.alias("of")).agg(F.count("*").alias("n")).where("n > 1").select("of"))
        if left.isEmpty():
            return tree.distinct()
        joined = merged.select(F.col("node").alias("comp"), F.col("comp").alias("joined"))
        label = label.join(joined, "comp").select("id", F.col("joined").alias("comp"))
        label = cut(label.join(pyramid.broadcast_small(left, keys), of == F.col("of"), "left_semi") if key else label)
    raise RuntimeError("the tree did not close")


def subsamples(nodes: DataFrame, reps: int, size: int, seed: int = 0, n: int | None = None) -> DataFrame:
    """reps samples of size nodes without replacement: those with the smallest md5 of seed|rep|node. Adds rep, from 0.

    md5 is uniform, so all but the few nodes whose digest lies near the wanted share are in or out at sight; only these
    are ranked, behind the counted number of those below them. n: the number of nodes, where it is known."""
    n = nodes.count() if n is None else n
    drawn = nodes.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("rep").cast("string"), F.col("node").cast("string")))
    drawn = drawn.withColumn("_k", key)
    share = min(1.0, size / max(n, 1))
    margin = 8 * (share * (1 - share) / max(n, 1)) ** 0.5 + 16 / max(n, 1)
    low, high = share - margin, share + margin
    first = F.lit(f"{int(low * 16**8):08x}") if low > 0 else F.lit("")
    last = F.lit(f"{int(high * 16**8):08x}") if high < 1 else F.lit("g")
    sure = {}
    if n and low > 0:
        counts = drawn.groupBy("rep").agg(F.count_if(F.col("_k") < first).alias("sure"), F.count_if(F.col("_k") < last).alias("most")).collect()
        sure = {r.rep: r.sure for r in counts}
        if any(r.sure > size or r.most < min(size, n) for r in counts):  # as good as impossible
            first, last, sure = F.lit(""), F.lit("g"), {}
    place = F.row_number().over(Window.partitionBy("rep").orderBy("_k", "node"))
    left = F.lit(size) - (F.element_at(F.array(*[F.lit(sure.get(i, 0)) for i in range(reps)]), F.col("rep") + 1) if sure else F.lit(0))
    border = drawn.where((F.col("_k") >= first) & (F.col("_k") < last)).withColumn("_p", place).where(F.col("_p") <= left).drop("_p", "_k")
    return drawn.where(F.col("_k") < first).drop("_k").unionByName(border) if sure else border


def bootstrap_frequency(nodes: DataFrame, reps: int = 500, share: float = 0.75, seed: int = 0, dims: Sequence[str] = DIMS) -> DataFrame:
    """(src, dst, freq): how often an edge lies in the trees of reps samples of min(int(N share) + 1, N) nodes."""
    n = nodes.count()
    size = min(int(n * share) + 1, n)
    trees = mst(subsamples(nodes, reps, size, seed, n), dims, rep="rep", rep_nodes=size)
    return trees.groupBy("src", "dst").agg((F.count("*") / reps).alias("freq"))


def bootstrap_mst(nodes: DataFrame, reps: int = 100, share: float = 0.75, threshold: float = 0.35, seed: int = 0, dims: Sequence[str] = DIMS) -> DataFrame:
    """Edges more frequent than threshold (or always there), and the tree of all nodes."""
    often = bootstrap_frequency(nodes, reps, share, seed, dims).where((F.col("freq") > threshold) | (F.col("freq") == 1)).select("src", "dst")
    return canonical(often.unionByName(mst(nodes, dims)))


def relative_neighbours(nodes: DataFrame, dims: Sequence[str] = DIMS, local_nodes: int | None = None) -> DataFrame:
    """Pairs with no third node strictly nearer to both than they are to each other. Up to local_nodes nodes (limits().nodes, if not given) go to every task, which
    looks at its own; beyond, candidate pairs are Delaunay edges."""
    most = limits().nodes if local_nodes is None else local_nodes
    own = nodes.select(F.col("node").cast("long").alias("node"), *[F.col(d).cast("double").alias(d) for d in dims]).limit(max(most, 0) + 1).toArrow()
    if own.num_rows <= most:
        order = np.argsort(own.column(0).to_numpy(), kind="stable")
        ids, *x = (c.to_numpy()[order] for c in own.columns)
        x = np.stack(x, 1)

        def run(batches):
            for batch in batches:
                found = ids[dense.relative_neighbour_pairs(x, batch.column(0).to_numpy())]
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["src", "dst"])

        spark = nodes.sparkSession
        places = spark.range(0, len(ids), 1, max(1, min(len(ids) // 64, 4 * spark.sparkContext.defaultParallelism)))
        return places.mapInArrow(run, "src bigint, dst bigint")
    return relative_neighbours_of_many(nodes, dims)


def relative_neighbours_of_many(nodes: DataFrame, dims: Sequence[str] = DIMS, k: int = 16, first: int = 64) -> DataFrame:
    """The same pairs by few candidates. No node lies in the sphere around a pair of the graph, so it is an edge of the Delaunay graph of the distinct positions (the plane and space only). A third node
    is sought among the k nearest of both ends, which is enough where one end is among those of the other; for what is open then, in the sphere
    that holds all places nearer to both, the `first` nodes nearest to its centre first, and more while these are not all."""
    if len(dims) not in (2, 3):
        raise ValueError(f"relative neighbours of more than {limits().nodes} nodes are sought in the plane and in space")
    places = cut(nodes.groupBy(*[F.col(d).cast("double").alias(d) for d in dims]).agg(F.min(F.col("node").cast("long")).alias("node")))
    n = places.count()
    k = min(k, n - 1)
    pairs = places.select(F.col("node").alias("src"), F.col("node").alias("dst")).limit(0)
    if n > 1:
        placed = pyramid.plant(places, n, id_col="node", dims=dims, leaf=pyramid.leaf_size(k + 1), need=k + 1)
        near = cut(pyramid.nearest(placed, placed, k, exclude_self=True).select(F.col("q_id").alias("src"), F.col("p_id").alias("r"), F.col("d2").alias("r2")))
        edges = cut(ends(places, delaunay(places, dims), dims).withColumn("d2", squared_distance(columns(dims, "a_"), columns(dims, "b_"))))
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[F.col(f"{q}_{d}").alias(f"{p}_{d}") for p, q in ("ab", "ba") for d in dims], "d2"))
        third = places.select(F.col("node").alias("r"), *[F.col(d).alias(f"r_{d}") for d in dims])
        nearer = squared_distance(columns(dims, "b_"), columns(dims, "r_")) < F.col("d2")
        pair = [F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")]
        gone = both.join(near, "src").where("r2 < d2").join(third, "r").where(nearer).select(*pair).distinct()
        # whoever is nearer to an end than the other end is known if that end's list reaches as far
        reach = near.groupBy("src").agg(F.max("r2").alias("reach"))
        known = both.join(reach, "src").groupBy(*pair).agg(F.max((F.col("d2") <= F.col("reach")) | F.lit(k == n - 1)).alias("known"))
        left = cut(edges.join(gone, ["src", "dst"], "left_anti").join(known, ["src", "dst"]))
        pairs, open_, most = left.where("known").select("src", "dst"), left.where("not known").drop("known"), first
        while not open_.isEmpty():
            middle = [((F.col(f"a_{d}") + F.col(f"b_{d}")) / 2).alias(f"c_{d}") for d in dims]
            spheres = open_.select(F.struct("src", "dst").alias("item"), *middle, (F.col("d2") * (0.75 + 1e-9)).alias("r2"))
            inside = cut(pyramid.inside_spheres(placed, spheres, most).select("item.src", "item.dst", *[F.col(d).alias(f"r_{d}") for d in dims]).join(open_, ["src", "dst"]))
            hit = F.max(nearer & (squared_distance(columns(dims, "a_"), columns(dims, "r_")) < F.col("d2")))
            seen = inside.groupBy("src", "dst").agg(hit.alias("hit"), F.count("*").alias("n"))
            judged = cut(open_.join(seen, ["src", "dst"], "left").where("hit is null or not hit"))
            full = F.coalesce("n", F.lit(0)) >= most
            pairs, open_, most = cut(pairs.unionByName(judged.where(~full).select("src", "dst"))), judged.where(full).drop("hit", "n"), most * 8
    # nodes of one position have all neighbours of it, and each other
    here = nodes.select(F.col("node").cast("long").alias("own"), *[F.col(d).cast("double").alias(d) for d in dims]).join(places, list(dims)).select("own", "node")
    spread = pairs.join(here.select(F.col("node").alias("src"), F.col("own").alias("a")), "src").join(here.select(F.col("node").alias("dst"), F.col("own").alias("b")), "dst")
    same = here.join(here.withColumnRenamed("own", "other"), "node").where("own < other").select(F.col("own").alias("src"), F.col("other").alias("dst"))
    return canonical(spread.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(same))


def delaunay(nodes: DataFrame, dims: Sequence[str] = DIMS) -> DataFrame:
    """Delaunay edges, src < dst, of a planar or spatial set of nodes (ties of cocircular points are settled by a tiny shift, fixed by a node's id). Up to
    limits().nodes nodes are triangulated in one task, more by cells that know enough of what is around them."""
    most = max(limits().nodes, len(dims) + 1)
    if nodes.limit(most + 1).count() <= most:
        return _by_rep(nodes, dense.delaunay_pairs, dims, None)
    return delaunay_by_cells(nodes, dims)


def remove_short_edges(nodes: DataFrame, edges: DataFrame, length: float, dims: Sequence[str] = DIMS) -> tuple[DataFrame, DataFrame]:
    """Drop edges shorter than length and nodes left without edge, and grow the tree of the others; unchanged if no edge is short."""
    weighted = cut(edge_weights(nodes, edges, dims))
    if weighted.where(F.col("w") < length).isEmpty():
        return nodes, edges
    long = weighted.where(F.col("w") >= length)
    used = long.select(F.col("src").alias("node")).unionByName(long.select(F.col("dst").alias("node"))).distinct()
    left = cut(nodes.join(used, "node", "left_semi"))
    return left, mst(left, dims)


def merged_trees(nodes: DataFrame, reps: int, share: float, k: float, seed: int = 0, dims: Sequence[str] = DIMS) -> DataFrame:
    """(src, dst, p): a graph grown from the tree of all nodes by the trees of samples of int(N share) nodes. An edge of a sample's tree that
    exists is counted once; one that is longer than its path in the graph over k counts the edges of that path; any other is added, with no count yet.
    The outcome depends on the order of edges, (rep, src, dst), each on what came before, so it is folded on the driver, whatever the number of nodes; the trees come there as arrays."""
    n = nodes.count()
    size = int(n * share)
    trees = mst(subsamples(nodes, reps, size, seed, n), dims, rep="rep", rep_nodes=size)

    def in_order(edges: DataFrame, *names: str) -> list[tuple]:
        columns_ = [c.to_numpy() for c in edges.select(*names).toArrow().columns]
        order = np.lexsort(columns_[::-1])
        return list(zip(*(c[order].tolist() for c in columns_), strict=True))

    samples, first = in_order(trees, "rep", "src", "dst"), in_order(mst(nodes, dims), "src", "dst")
    ids, *x = (c.to_numpy() for c in nodes.select("node", *dims).toArrow().columns)
    place = dict(zip(ids.tolist(), np.stack(x, 1).astype(float), strict=True))
    found = dense.fold_trees(place, first, samples, reps, k)
    src, dst, p = zip(*found, strict=True) if found else ((), (), ())
    return nodes.sparkSession.createDataFrame(pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64()), "p": pa.array(p, pa.float64())}))


#: Builders by name, for fits and catalogues.
TOPOLOGIES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "mst": mst,
    "bootstrap_mst": bootstrap_mst,
    "knn": knn_graph,
    "reciprocal_knn": reciprocal_knn_graph,
    "fixed_length": fixed_length_graph,
    "full": full_graph,
    "relative_neighbours": relative_neighbours,
    "delaunay": delaunay,
}

"""Filaments of a graph: extraction, labels, refinement, distances, connectivity.

Types: 0 a closed loop, 1 from end to end, 2 from end to bifurcation, 3 between
bifurcations. Each is listed once: a path of type 1 or 3 starts at its lesser end, one of
type 2 at its end, a loop at its least node.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crestline.functions.geometry import columns, distance, segment_distance
from crestline.operators import dense
from crestline.operators.chains import chains, numbered_groups
from crestline.operators.graph import canonical, degree, edge_weights, ends, hop_distances, induced, numbered, path_lengths
from crestline.operators.mixture import responsibilities
from crestline.operators.spatial import knn_join
from crestline.operators.state import cut, limits

DIMS = ("x", "y")


@dataclass
class Filament:
    """One filament as an object on the driver."""

    fil_id: int
    type: int
    length: float
    curvature: float
    nodes: list[int]
    edges: list[int]
    assignment: list[int] = field(default_factory=list)
    residuals: list[float] = field(default_factory=list)
    uncertainty: list[float] = field(default_factory=list)

    def summary(self) -> str:
        kinds = ("loop", "from end to end", "from end to bifurcation", "between bifurcations")
        return f"filament {self.fil_id}, {kinds[self.type]}: {len(self.nodes)} nodes, length {self.length:.3f}, curvature {self.curvature:.3f}, {len(self.assignment)} points"


FILAMENT_SCHEMA = "fil_id bigint, type int, length double, curvature double, nodes array<bigint>, edges array<bigint>, assignment array<bigint>, residuals array<double>, uncertainty array<double>"


def to_objects(filaments: DataFrame) -> list[Filament]:
    """The filaments of a graph, which are few, as objects."""
    return [Filament(**{k: v for k, v in r.asDict().items() if k in Filament.__dataclass_fields__}) for r in filaments.orderBy("fil_id").collect()]


def to_table(spark, filaments: Sequence[Filament]) -> DataFrame:
    return spark.createDataFrame([tuple(asdict(f)[k] for k in Filament.__dataclass_fields__) for f in filaments], FILAMENT_SCHEMA)


def _in_order(src: list, dst: list, ids: list, w: list, degrees: dict) -> tuple[list, list, float]:
    """Nodes and edge ids along a chain, from its proper start, and its length."""
    around: dict = {}
    for a, b, e, far in zip(src, dst, ids, w, strict=True):
        around.setdefault(a, []).append((b, e, far))
        around.setdefault(b, []).append((a, e, far))
    tips = [v for v in around if degrees[v] == 1]
    forks = [v for v in around if degrees[v] > 2]
    begin = min(tips) if tips else min(forks) if forks else min(around)
    nodes, path, length, used = [begin], [], 0.0, set()
    while True:
        ways = sorted((b, e, far) for b, e, far in around[nodes[-1]] if e not in used)
        if not ways or (len(nodes) > 1 and degrees[nodes[-1]] != 2):
            return nodes, path, length
        b, e, far = ways[0]
        used.add(e)
        nodes.append(b)
        path.append(e)
        length += far


def _described(src: list, dst: list, ids: list, w: list, degrees: dict, place: dict) -> tuple[int, float, float, list, list]:
    """(type, length, curvature, nodes, edges) of the edges of one chain."""
    path, numbers, length = _in_order(src, dst, ids, w, degrees)
    first, last = path[0], path[-1]
    if degrees[first] == 2:
        kind = 0
    elif degrees[first] == 1:
        kind = 1 if degrees[last] == 1 else 2
    else:
        kind = 3
    chord = float(np.linalg.norm(np.array(place[first]) - np.array(place[last])))
    return kind, length, 1 - chord / length if length > 0 else 0.0, path, numbers


def _small_chains(nodes: DataFrame, weighted: DataFrame, dims: Sequence[str]) -> DataFrame | None:
    """The filaments of a graph of edges (edge_id, src, dst, w) that limits().edges lets be held, worked out at once; None for a larger one."""
    most = limits().edges
    rows = ends(nodes, weighted, dims).limit(most + 1).collect() if most >= 0 else []
    if len(rows) > most:
        return None
    degrees: dict = {}
    place: dict = {}
    for r in rows:
        for v, p in ((r["src"], "a"), (r["dst"], "b")):
            degrees[v] = degrees.get(v, 0) + 1
            place[v] = [r[f"{p}_{d}"] for d in dims]
    inner = [(r["src"], r["dst"]) for r in rows if degrees[r["src"]] == degrees[r["dst"]] == 2]
    pairs = np.array(inner, np.int64).reshape(-1, 2)
    held = dense.Compact(pairs[:, 0], pairs[:, 1])
    chain = dict(zip(held.ids.tolist(), held.ids[held.labels()].tolist(), strict=True))
    groups: dict = {}
    for r in rows:
        slim = [v for v in (r["src"], r["dst"]) if degrees[v] == 2]
        groups.setdefault(chain.get(slim[0], slim[0]) if slim else (r["src"], r["dst"]), []).append(r)
    found = [_described([r["src"] for r in g], [r["dst"] for r in g], [r["edge_id"] for r in g], [r["w"] for r in g], degrees, place) for g in groups.values()]
    found.sort(key=lambda f: (f[0] == 3, f[0] != 0, f[3]))
    return nodes.sparkSession.createDataFrame([(i, *f) for i, f in enumerate(found)], "fil_id bigint, type int, length double, curvature double, nodes array<bigint>, edges array<bigint>")


def find_filaments(nodes: DataFrame, edges: DataFrame, dims: Sequence[str] = DIMS, *, between: bool = True) -> DataFrame:
    """(fil_id, type, length, curvature, nodes, edges): chains of degree-2 nodes between other nodes, as whole paths. Curvature is
    1 - chord / length. fil_id counts from 0 over loops, then paths with an end, then those between bifurcations, by their nodes.
    Without `between` those between bifurcations are left out; the others keep their numbers.

    Chains of a graph that is not held in one place are ranked by pointer doubling (operators/chains.py); the arrays are made last."""
    found = _filaments(nodes, edges, dims)
    return found if between else found.where("type <> 3")


def _filaments(nodes: DataFrame, edges: DataFrame, dims: Sequence[str]) -> DataFrame:
    flat = edges if "edge_id" in edges.columns else numbered(edges)
    weighted = edge_weights(nodes, flat.select("edge_id", "src", "dst"), dims)
    held = _small_chains(nodes, weighted, dims)
    if held is not None:
        return held
    deg = cut(degree(nodes, flat.select("src", "dst")).where("deg > 0"))
    links = cut(chains(weighted, deg))
    whole = links.groupBy("start").agg(F.sum("w").alias("length"), F.min(F.struct("dist", "tail", "head")).alias("a"), F.max(F.struct("dist", "head")).alias("z"))
    whole = whole.select("start", "length", F.col("a.tail").alias("first"), F.col("a.head").alias("second"), F.col("z.head").alias("last"))
    for side in ("first", "last"):
        place = nodes.select(F.col("node").alias(side), *[F.col(d).alias(f"{side[0]}_{d}") for d in dims])
        whole = whole.join(place, side).join(deg.select(F.col("node").alias(side), F.col("deg").alias(f"deg_{side}")), side)
    kind = F.expr("CASE WHEN deg_first = 2 THEN 0 WHEN deg_first > 1 THEN 3 WHEN deg_last = 1 THEN 1 ELSE 2 END")
    chord = distance(columns(dims, "f_"), columns(dims, "l_"))
    whole = whole.select("start", kind.alias("type"), "length", F.when(F.col("length") > 0, 1 - chord / F.col("length")).otherwise(0.0).alias("curvature"), "first", "second")
    # two paths that begin alike differ in their second node
    whole = numbered_groups(whole.withColumn("late", F.col("type") == 3).withColumn("not_loop", F.col("type") != 0), ["late", "not_loop", "first", "second"], "fil_id")
    held = links.groupBy("start").agg(F.array_sort(F.collect_list(F.struct("dist", F.col("head").cast("long").alias("head"), F.col("edge_id").cast("long").alias("edge_id")))).alias("way"))
    path = F.concat(F.array(F.col("first").cast("long")), F.transform("way", lambda s: s["head"]))
    return whole.join(held, "start").select("fil_id", "type", "length", "curvature", path.alias("nodes"), F.transform("way", lambda s: s["edge_id"]).alias("edges"))


def component_of(points: DataFrame, nodes: DataFrame, *, ksig: float = 7.0, alpha: float = 0.0, area: float = 1.0, background: bool = False, dims: Sequence[str] = DIMS) -> DataFrame:
    """(id, node): the node with the largest share in each point (ties to the lesser); -1 where no node is within ksig, or
    the background's share is larger than that of all nodes together."""
    resp = responsibilities(points, nodes, ksig=ksig, alpha=alpha, area=area, background=background, dims=dims)
    top = resp.groupBy("id").agg(
        F.max(F.when(F.col("node") >= 0, F.struct("r", (-F.col("node")).alias("m")))).alias("best"),
        F.coalesce(F.sum(F.when(F.col("node") >= 0, F.col("r"))), F.lit(0.0)).alias("in"),
        F.coalesce(F.max(F.when(F.col("node") < 0, F.col("r"))), F.lit(0.0)).alias("out"),
    )
    kept = top.where("in > 0 and out <= in").select("id", (-F.col("best.m")).alias("node"))
    return points.select("id").join(kept, "id", "left").select("id", F.coalesce("node", F.lit(-1)).cast("long").alias("node"))


def filament_of_nodes(filaments: DataFrame) -> DataFrame:
    """(node, fil_id): the last filament that holds a node."""
    return filaments.select("fil_id", F.explode("nodes").alias("node")).groupBy("node").agg(F.max("fil_id").alias("fil_id"))


def assign_labels(points: DataFrame, nodes: DataFrame, filaments: DataFrame, *, ksig: float = 3.0, dims: Sequence[str] = DIMS, **background) -> DataFrame:
    """(id, label): filament of each point's component, or -1."""
    own = component_of(points, nodes, ksig=ksig, dims=dims, **background)
    return own.join(filament_of_nodes(filaments), "node", "left").select("id", F.coalesce("fil_id", F.lit(-1)).cast("long").alias("label"))


def in_pattern(points: DataFrame, nodes: DataFrame, *, ksig: float = 7.0, dims: Sequence[str] = DIMS, **background) -> DataFrame:
    """(id, inside): 1 for points that belong to a component, 0 for others."""
    own = component_of(points, nodes, ksig=ksig, dims=dims, **background)
    return own.select("id", (F.col("node") >= 0).cast("int").alias("inside"))


def filament_segments(nodes: DataFrame, edges: DataFrame, filaments: DataFrame, dims: Sequence[str] = DIMS) -> DataFrame:
    """(fil_id, edge_id, a_d, b_d) of the edges of each filament."""
    held = filaments.select("fil_id", F.explode("edges").alias("edge_id"))
    return held.join(ends(nodes, edges.select("edge_id", "src", "dst"), dims), "edge_id")


def filament_residuals(points: DataFrame, nodes: DataFrame, edges: DataFrame, filaments: DataFrame, labels: DataFrame, dims: Sequence[str] = DIMS) -> DataFrame:
    """(id, label, residual): distance of each labelled point to its filament. Segments that limits().edges lets be held go along with
    the task's function, so points are joined with their labels only, however long a filament is."""
    seg = filament_segments(nodes, edges, filaments, dims)
    rows = labels.where("label >= 0").join(points.select("id", *dims), "id")
    most = limits().edges
    held = seg.select("fil_id", *[f"{p}_{d}" for p in "ab" for d in dims]).limit(max(most, 0) + 1).toArrow()
    if held.num_rows > most:
        far = segment_distance(columns(dims), columns(dims, "a_"), columns(dims, "b_"))
        return rows.join(seg, F.col("label") == F.col("fil_id")).groupBy("id", "label").agg(F.min(far).alias("residual"))
    order = np.argsort(held.column(0).to_numpy(), kind="stable")
    fils, *places = (c.to_numpy()[order] for c in held.columns)
    start, stop = np.stack(places[: len(dims)], 1).astype(float), np.stack(places[len(dims) :], 1).astype(float)

    def run(batches):
        for batch in batches:
            label = batch.column(1).to_numpy()
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[2:]], 1)
            best = np.full(len(label), np.nan)
            for k in np.unique(label):
                low, high = np.searchsorted(fils, (k, k + 1))
                if low < high:
                    at = np.flatnonzero(label == k)
                    best[at] = dense.segment_distances(x[at], start[low:high], stop[low:high])
            kept = pa.array(~np.isnan(best))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best)], ["id", "label", "residual"]).filter(kept)

    kind = points.schema["id"].dataType.simpleString()
    return rows.select("id", F.col("label").cast("long").alias("label"), *[F.col(d).cast("double").alias(d) for d in dims]).mapInArrow(run, f"id {kind}, label bigint, residual double")


def skeleton_distance(points: DataFrame, nodes: DataFrame, edges: DataFrame, near: int = 10, dims: Sequence[str] = DIMS) -> DataFrame:
    """(id, distance) to the nearest edge among those at the `near` nodes nearest to a point."""
    at = knn_join(points, nodes, near, point_id="node", dims=dims).select(F.col("q_id").alias("id"), F.col("p_id").alias("node"))
    seg = ends(nodes, canonical(edges), dims)
    touching = seg.select(F.col("src").alias("node"), "*").unionByName(seg.select(F.col("dst").alias("node"), "*"))
    rows = at.join(touching, "node").join(points.select("id", *dims), "id")
    return rows.groupBy("id").agg(F.min(segment_distance(columns(dims), columns(dims, "a_"), columns(dims, "b_"))).alias("distance"))


def describe_filaments(points: DataFrame, nodes: DataFrame, edges: DataFrame, filaments: DataFrame, *, uncertainty: DataFrame | None = None, dims: Sequence[str] = DIMS, **background) -> DataFrame:
    """filaments with assignment (ids of points whose component lies on it), residuals in the same order, and uncertainty by node
    (zeros unless a table (node, rho) is given). These arrays grow with the points of a filament; labels and residuals as rows
    are what assign_labels and filament_residuals return."""
    labels = assign_labels(points, nodes, filaments, ksig=7.0, dims=dims, **background)
    rest = filament_residuals(points, nodes, edges, filaments, labels, dims)
    held = rest.groupBy(F.col("label").alias("fil_id")).agg(F.array_sort(F.collect_list(F.struct("id", "residual"))).alias("m"))
    rho = (uncertainty if uncertainty is not None else nodes.select("node", F.lit(0.0).alias("rho"))).select("node", "rho")
    spread = filaments.select("fil_id", F.posexplode("nodes").alias("i", "node")).join(rho, "node", "left")
    balls = spread.groupBy("fil_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("rho", F.lit(0.0)).alias("rho")))), lambda s: s["rho"]).alias("uncertainty"))
    out = filaments.join(held, "fil_id", "left").join(balls, "fil_id", "left")
    return out.select("*", F.coalesce(F.transform("m", lambda s: s["id"]), F.array().cast("array<bigint>")).alias("assignment"), F.coalesce(F.transform("m", lambda s: s["residual"]), F.array().cast("array<double>")).alias("residuals")).drop("m")


def refine(nodes: DataFrame, edges: DataFrame, shortest: float, dims: Sequence[str] = DIMS, most_rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without branches from an end to a bifurcation that are shorter than `shortest`, until there are none. nodes keeps the former
    number as node_before; numbers run from 0 without gaps; nodes isolated from the start stay. Every round takes nodes away, so there is an end; where most_rounds is given and short branches remain after it, that is an error."""
    kept, left = cut(nodes), cut(numbered(edges))
    for done in itertools.count():
        found = find_filaments(kept, left, dims)
        gone = cut(found.where((F.col("type") == 2) & (F.col("length") < shortest)).select(F.explode(F.slice("nodes", F.lit(1), F.size("nodes") - 1)).alias("node")).distinct())
        if gone.isEmpty():
            break
        if done == most_rounds:
            raise RuntimeError(f"short branches remain after {most_rounds} rounds")
        kept = cut(kept.join(gone, "node", "left_anti"))
        left = cut(numbered(induced(left, kept)))
    order = kept.select("node").repartitionByRange("node").withColumn("_part", F.spark_partition_id())
    order = cut(order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = order.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_s"))
    new = order.withColumn("_i", F.row_number().over(Window.partitionBy("_part").orderBy("node"))).join(F.broadcast(starts), "_part").select("node", (F.col("_s") + F.col("_i") - 1).alias("new"))
    out = kept.join(new, "node").withColumnRenamed("node", "node_before").withColumnRenamed("new", "node")
    a, b = (new.select(F.col("node").alias(c), F.col("new").alias(f"n_{c}")) for c in ("src", "dst"))
    moved = left.join(a, "src").join(b, "dst").select("edge_id", F.col("n_src").alias("src"), F.col("n_dst").alias("dst"))
    return out.select("node", "node_before", *[c for c in nodes.columns if c != "node"]), moved


def connectivity_events(position: Sequence[float], radius: float, nodes: DataFrame, edges: DataFrame, dims: Sequence[str] = DIMS) -> DataFrame:
    """(node, event, euclidean, geodesic, connectivity) around the node nearest to a position: deg of that node first, then deg - 2 at each
    bifurcation and -1 at each end that paths within radius of it reach, by Euclidean distance from it; connectivity is the running sum."""
    spark = nodes.sparkSession
    where = spark.createDataFrame([(0, *map(float, position))], f"id bigint, {', '.join(f'{d} double' for d in dims)}")
    centre = knn_join(where, nodes, 1, point_id="node", dims=dims).first().p_id
    home = nodes.where(F.col("node") == centre).select(*[F.col(d).alias(f"o_{d}") for d in dims])
    ranged = nodes.join(F.broadcast(home)).withColumn("euclidean", distance(columns(dims, "o_"), columns(dims))).select("node", "euclidean")
    close = cut(ranged.where((F.col("euclidean") < radius) | (F.col("node") == centre)))
    start = close.where(F.col("node") == centre).select("node")
    reached = hop_distances(induced(edges, close), start).select("node")
    lengths = path_lengths(nodes, edges, start, dims).select("node", F.col("len").alias("geodesic"))
    deg = degree(nodes, canonical(edges))
    rows = close.join(reached, "node", "left_semi").join(lengths, "node").join(deg, "node")
    event = F.when(F.col("node") == centre, F.col("deg")).when(F.col("deg") == 1, F.lit(-1)).when(F.col("deg") > 2, F.col("deg") - 2)
    rows = rows.withColumn("event", event).where("event is not null").select("node", F.col("event").cast("int").alias("event"), "euclidean", "geodesic")
    running = F.sum("event").over(Window.orderBy("euclidean", "node").rowsBetween(Window.unboundedPreceding, 0))  # over ends and forks near one node
    return rows.withColumn("connectivity", running)

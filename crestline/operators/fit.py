"""Fitting a mixture whose nodes follow a graph, by expectation and maximisation.

The model (nodes, edges) is small: it lives on the driver and goes to the tasks with
their function, as in other mixture fits on Spark. Points stay where they are (unless
there are at most limits().points of them, where the driver makes the rounds); in each round a task reads its points once, compares them with the nodes of near cells
only, and sends back one row of sums for each node it met. So a round is a single pass
with one small shuffle, whatever the number of points. Models of more than
MOST_NODES nodes, such as those with the points themselves as nodes, are tables (operators/fit_tables.py).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.functions.stats import bandwidth
from crestline.operators import dense
from crestline.operators.dense import Cells, shares
from crestline.operators.fit_tables import TableModel, fit_tables
from crestline.operators.graph import prune
from crestline.operators.mixture import box_area
from crestline.operators.state import cut, limits
from crestline.operators.topology import TOPOLOGIES, subsamples

DIMS = ("x", "y")
#: Nodes of a model: its table is sent with each task (under 10 MB) and solved on the driver.
MOST_NODES = 100_000
#: Topologies of node sets held in one place.
DIRECT = {"mst": dense.spanning_tree, "relative_neighbours": dense.relative_neighbour_pairs, "delaunay": dense.delaunay_pairs}


@dataclass(frozen=True)
class FitParameters:
    """What a fit needs; the defaults are the usual ones."""

    topology: str | Callable[[DataFrame], DataFrame] = "mst"
    a0: float = 0.1
    lam: float = 1.0
    lam_sig: float = 5.0
    lam_pi: float = 1.0
    denoising: int = 4
    reps: int = 100
    share: float = 0.75
    max_rounds: int = 10
    eps: float = 1e-6
    ksig: float = 7.0
    min_sigma: float = 0.0
    sig: float | None = None
    update: str = "adaptive"
    covariance: str = "spherical"
    background: bool = False
    alpha: float = 0.0
    area: float | None = None
    refresh_every: int = 1
    seed: int = 0

    def with_bandwidth(self, points: DataFrame, dims: Sequence[str] = DIMS) -> FitParameters:
        """sig from the bandwidth rule over points."""
        return replace(self, sig=bandwidth(points, self.a0, dims).first().sig)

    def changed(self, **values) -> FitParameters:
        """The same with some values changed."""
        return replace(self, **values)

    def show(self) -> str:
        """A line for each parameter."""
        return "\n".join(f"{k} = {v}" for k, v in self.__dict__.items())


@dataclass(frozen=True)
class GraphModel:
    """A fitted graph: node ids, positions, variance and weight of each; edges as pairs of places in them; background weight."""

    ids: np.ndarray
    positions: np.ndarray
    sig: np.ndarray
    pi: np.ndarray
    edges: np.ndarray
    alpha: float = 0.0
    area: float = 1.0
    background: bool = False
    dims: tuple[str, ...] = DIMS
    movements: tuple[float, ...] = ()
    objectives: tuple[float, ...] = ()
    previous: tuple = field(default=(), repr=False)

    def nodes(self, spark) -> DataFrame:
        rows = [(int(i), *map(float, x), float(s), float(p)) for i, x, s, p in zip(self.ids, self.positions, self.sig, self.pi, strict=True)]
        return spark.createDataFrame(rows, f"node bigint, {', '.join(f'{d} double' for d in self.dims)}, sig double, pi double")

    def edge_table(self, spark) -> DataFrame:
        pairs = sorted((int(min(self.ids[a], self.ids[b])), int(max(self.ids[a], self.ids[b]))) for a, b in self.edges)
        return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "edge_id bigint, src bigint, dst bigint")


def local_edges(name_or_build: str | Callable, ids: np.ndarray, x: np.ndarray, dims: Sequence[str], spark) -> np.ndarray:
    """Edges of a topology as places in ids. Trees and proximity graphs of a model are worked out at once on the driver;
    any other builder is called with a table of the nodes."""
    if isinstance(name_or_build, str) and name_or_build in DIRECT:
        return DIRECT[name_or_build](x)
    build = TOPOLOGIES[name_or_build] if isinstance(name_or_build, str) else name_or_build
    table = spark.createDataFrame([(int(i), *map(float, r)) for i, r in zip(ids, x, strict=True)], f"node bigint, {', '.join(f'{d} double' for d in dims)}")
    place = {int(i): k for k, i in enumerate(ids)}
    return np.array(sorted((place[r.src], place[r.dst]) for r in build(table).select("src", "dst").collect()), np.int64).reshape(-1, 2)


def part_sums(own: np.ndarray, cells: Cells, sig: np.ndarray, pi: np.ndarray, floor: float) -> tuple[np.ndarray, float]:
    """Over the given points: by node, sums of r, of r (x - node) and of its squares; and the sum of all r."""
    x = cells.x
    k, d = x.shape
    sums, assigned = np.zeros((k, 1 + 2 * d)), 0.0
    for p, n, r in shares(cells, own, sig, pi, floor):
        # differences from the node keep the digits that squares of coordinates would lose
        moved = own[p] - x[n]
        assigned += r.sum()
        sums[:, 0] += np.bincount(n, r, k)
        for j in range(d):
            sums[:, 1 + j] += np.bincount(n, r * moved[:, j], k)
            sums[:, 1 + d + j] += np.bincount(n, r * moved[:, j] ** 2, k)
    return sums, assigned


def finite_rows(columns: Sequence[np.ndarray]) -> np.ndarray:
    own = np.stack(columns, 1)
    return own[np.isfinite(own).all(1)]


def local_sums(own: np.ndarray, par: FitParameters) -> Callable:
    """The expectation step over points held here."""

    def run(x, sig, pi, floor):
        sums, assigned = part_sums(own, Cells(x, sig, par.ksig), sig, pi, floor)
        return sums, assigned, len(own)

    return run


def distributed_sums(points: DataFrame, par: FitParameters, dims: Sequence[str]) -> Callable:
    """The expectation step as one pass over a table of points."""

    def run(x, sig, pi, floor):
        k, d = x.shape
        cells = Cells(x, sig, par.ksig)
        names = [f"s{j}" for j in range(1 + 2 * d)]

        def task(batches):
            sums, assigned, count = np.zeros((k, 1 + 2 * d)), 0.0, 0
            for batch in batches:
                own = finite_rows([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
                more, part = part_sums(own, cells, sig, pi, floor)
                sums, assigned, count = sums + more, assigned + part, count + len(own)
            met = np.flatnonzero(sums[:, 0])
            rows = np.concatenate((sums[met], [[count, assigned, *[0.0] * (2 * d - 1)]]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((met, [-1])), pa.int64()), *[pa.array(rows[:, j]) for j in range(1 + 2 * d)]], ["node", *names])

        part = points.select(*dims).mapInArrow(task, f"node bigint, {', '.join(f'{n} double' for n in names)}")
        sums, assigned, count = np.zeros((k, 1 + 2 * d)), 0.0, 0
        for r in part.groupBy("node").agg(*[F.sum(n).alias(n) for n in names]).collect():
            if r.node < 0:
                count, assigned = int(r.s0), r.s1
            else:
                sums[r.node] = r[1:]
        return sums, assigned, count

    return run


def smooth(fresh: np.ndarray, sig: np.ndarray, n: np.ndarray, edges: np.ndarray, lam_sig: float, d: int, floor: float) -> np.ndarray:
    """Variances drawn to the mean of distinct neighbours' former ones; isolated nodes keep their own."""
    pairs = np.unique(np.concatenate((edges, edges[:, ::-1])), axis=0) if len(edges) else edges.reshape(-1, 2)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    deg = np.bincount(pairs[:, 0], minlength=len(sig))
    around = np.bincount(pairs[:, 0], sig[pairs[:, 1]], len(sig)) / np.maximum(deg, 1)
    c = 4 * lam_sig / (d * n)
    return np.maximum(np.where(deg > 0, (fresh + c * around) / (1 + c), fresh), floor)


def rounds(sums_of: Callable, edges_of: Callable, ids: np.ndarray, x: np.ndarray, sig: np.ndarray, pi: np.ndarray, lam: float, area: float, par: FitParameters, dims: Sequence[str], objective_of: Callable | None = None) -> GraphModel:
    """Expectation and maximisation until nodes rest, the objective settles, or max_rounds; sums_of makes the expectation step."""
    k, d = x.shape
    alpha = par.alpha if par.background else 0.0
    edges = edges_of(x)
    movements: list[float] = []
    objectives: list[float] = []
    before = (x, sig, pi, alpha)
    for t in range(par.max_rounds):
        before = (x, sig, pi, alpha)
        floor = alpha / area if par.background else 0.0
        sums, assigned, count = sums_of(x, sig, pi, floor)
        n, first, second = sums[:, 0], sums[:, 1 : 1 + d], sums[:, 1 + d :]
        weight = np.maximum(n, par.eps)
        right = (first + n[:, None] * x) / sig[:, None]
        new = dense.laplacian_solve(k, edges[:, 0], edges[:, 1], weight / sig, lam, right)
        alpha = max(0.0, count - assigned) / max(count, 1) if par.background else 0.0
        if par.update == "fixed":
            pi = np.full(k, (1 - alpha) / k) if par.background else pi
        else:
            move = new - x
            fresh = ((second - 2 * move * first + move**2 * n[:, None]) / weight[:, None]).mean(1)
            sig = np.maximum(smooth(fresh, sig, weight, edges, par.lam_sig, d, par.min_sigma), 1e-300)
            pi = (weight / max(count, 1) + par.lam_pi * (1 - alpha) / k) / (1 + par.lam_pi)
        step = np.sqrt(((new - x) ** 2).sum(1))
        x = new
        movements.append(float(np.sqrt((step**2).sum())))
        if (t and t % par.refresh_every == 0) or t <= 3:
            edges = edges_of(x)
        if objective_of is not None:
            objectives.append(objective_of(GraphModel(ids, x, sig, pi, edges, alpha, area, par.background, tuple(dims))))
            if len(objectives) > 1 and abs(objectives[-1] - objectives[-2]) < par.eps:
                break
        if movements[-1] < par.eps or step.max() < par.eps:
            break
    return GraphModel(ids, x, sig, pi, edges, alpha, area, par.background, tuple(dims), tuple(movements), tuple(objectives), before)


def fit_graph(points: DataFrame, nodes: DataFrame, par: FitParameters, *, dims: Sequence[str] = DIMS, with_objective: bool = False, small_points: int | None = None) -> GraphModel:
    """Fit nodes(node, x, y[, z][, sig][, pi]) to points. Stops when no node moves more than eps, or the objective settles,
    or after max_rounds. The result keeps movements (and objectives, if asked for) of each round."""
    if par.covariance != "spherical":
        raise ValueError("fits take spherical covariances; full ones have a responsibility operator of their own")
    spark = points.sparkSession
    own = nodes.orderBy("node").limit(MOST_NODES + 1).collect()
    k = len(own)
    if not 0 < k <= MOST_NODES:
        raise ValueError(f"a model has 1 to {MOST_NODES} nodes, not {k}")
    ids = np.array([r["node"] for r in own], np.int64)
    x = np.array([[r[c] for c in dims] for r in own], float)
    per_node = "sig" in nodes.columns
    start = par.sig if par.sig is not None else None if per_node else bandwidth(points, par.a0, dims).first().sig
    sig = np.array([r["sig"] for r in own], float) if per_node else np.full(k, start)
    pi = np.array([r["pi"] for r in own], float) if "pi" in nodes.columns else np.full(k, (1 - (par.alpha if par.background else 0.0)) / k)
    area = par.area if par.area is not None else box_area(points, dims) if par.background else 1.0
    held = points.select("id", *[F.col(c).cast("double").alias(c) for c in dims]).persist()

    def objective_of(model: GraphModel) -> float:
        from crestline.operators.mixture import objective

        return objective(held, model.nodes(spark), model.edge_table(spark), lam, alpha=model.alpha, area=area, background=par.background, dims=dims).first().objective

    lam = par.lam if per_node else par.lam / start
    try:
        most = limits().points if small_points is None else small_points
        some = held.select(*dims).limit(max(most, 0) + 1).toArrow()
        if some.num_rows <= most:
            sums_of = local_sums(finite_rows([some.column(c).to_numpy().astype(float) for c in dims]), par)
        else:
            sums_of = distributed_sums(held, par, dims)
        return rounds(sums_of, lambda y: local_edges(par.topology, ids, y, dims, spark), ids, x, sig, pi, lam, area, par, dims, objective_of if with_objective else None)
    finally:
        held.unpersist()


def fit_from_points(points: DataFrame, par: FitParameters, dims: Sequence[str] = DIMS, most_nodes: int = MOST_NODES) -> GraphModel | TableModel:
    """Fit with the points themselves as nodes, after dropping those in the outer onion layers of their graph where denoising is above 0. A model of
    more than most_nodes nodes is a table."""
    nodes = points.select(F.col("id").alias("node"), *dims)
    if par.denoising > 0:
        build = TOPOLOGIES[par.topology] if isinstance(par.topology, str) else par.topology
        nodes = prune(nodes, build(nodes), par.denoising).select("node", *dims)
    nodes = cut(nodes)
    own = nodes.withColumnRenamed("node", "id")
    if nodes.limit(max(most_nodes, 0) + 1).count() > most_nodes:
        return fit_tables(own, nodes, par, dims=dims)
    return fit_graph(own, nodes, par, dims=dims)


def fit_sample(ids: np.ndarray, x: np.ndarray, par: FitParameters, dims: Sequence[str]) -> GraphModel:
    """fit_from_points over points held here, for the topologies in DIRECT and a given sig."""
    if par.denoising > 0:
        pairs = DIRECT[par.topology](x)
        graph = dense.Compact(pairs[:, 0], pairs[:, 1])
        core, _, layer, last_core, last = graph.peel()
        rank = np.full(len(x), last)
        rank[graph.ids] = np.where(core > 0, layer, last)
        ids, x = ids[rank > par.denoising], x[rank > par.denoising]
    k = len(x)
    if not k:
        return GraphModel(ids, x, np.zeros(0), np.zeros(0), np.zeros((0, 2), np.int64), dims=tuple(dims))
    area = par.area if par.area is not None else float(np.prod(x.max(0) - x.min(0))) if par.background else 1.0
    pi = np.full(k, (1 - (par.alpha if par.background else 0.0)) / k)
    return rounds(local_sums(x, par), DIRECT[par.topology], ids, x, np.full(k, par.sig), pi, par.lam / par.sig, area, par, dims)


def bootstrap_fits(points: DataFrame, par: FitParameters, dims: Sequence[str] = DIMS, local_points: int | None = None, most_nodes: int = MOST_NODES) -> tuple[DataFrame, DataFrame]:
    """(rep, node, x, ...) and (rep, src, dst) of fits to par.reps samples of int(N share) points. An error in a replica is raised, not hidden.
    Samples of at most local_points points (limits().nodes, if not given) are fitted in parallel, one in a task; larger ones one after another, each distributed."""
    spark = points.sparkSession
    count = points.count()
    size = int(count * par.share)
    place = ", ".join(f"{c} double" for c in dims)
    drawn = subsamples(points.select(F.col("id").cast("long").alias("node"), *[F.col(c).cast("double").alias(c) for c in dims]), par.reps, size, par.seed, count)
    if par.sig is None:
        par = par.with_bandwidth(points, dims)
    if size <= (limits().nodes if local_points is None else local_points) and isinstance(par.topology, str) and par.topology in DIRECT:

        def run(table: pa.Table) -> pa.Table:
            order = np.argsort(table.column("node").to_numpy(), kind="stable")
            ids = table.column("node").to_numpy()[order]
            model = fit_sample(ids, np.stack([table.column(c).to_numpy()[order] for c in dims], 1), par, dims)
            k, e = len(model.ids), len(model.edges)
            none = np.full(e, np.nan)
            columns = {
                "rep": pa.array(np.full(k + e, table.column("rep")[0].as_py(), np.int32)),
                "node": pa.array([*model.ids.tolist(), *[None] * e], pa.int64()),
                **{c: pa.array(np.concatenate((model.positions[:, j], none))) for j, c in enumerate(dims)},
                "src": pa.array([*[None] * k, *model.ids[model.edges[:, 0]].tolist()], pa.int64()),
                "dst": pa.array([*[None] * k, *model.ids[model.edges[:, 1]].tolist()], pa.int64()),
            }
            return pa.table(columns)

        both = cut(drawn.select("rep", "node", *dims).groupBy("rep").applyInArrow(run, f"rep int, node bigint, {place}, src bigint, dst bigint"))
        return both.where("node is not null").select("rep", "node", *dims), both.where("node is null").select("rep", "src", "dst")
    drawn = cut(drawn)
    models = [fit_from_points(drawn.where(F.col("rep") == rep).select(F.col("node").alias("id"), *dims), par, dims, most_nodes) for rep in range(par.reps)]
    nodes = [m.nodes(spark).select(F.lit(rep).alias("rep"), "node", *dims) for rep, m in enumerate(models)]
    edges = [(m.edge_rows if isinstance(m, TableModel) else m.edge_table(spark)).select(F.lit(rep).alias("rep"), "src", "dst") for rep, m in enumerate(models)]
    return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges)

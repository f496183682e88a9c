"""Gaussian mixtures over points: responsibilities, likelihoods, densities, covariances.

nodes(node, x, y[, z], sig, pi): sig is the variance of a node, pi its weight.
points(id, x, y[, z]). A responsibility table is resp(id, node, r).

Nodes are few beside the points. Up to SMALL_NODES of them, a few MB, go along with the task's function, and what a point needs of them is
worked out where the point is, a block of points by all nodes (or those of near cells) at a time: nothing is shuffled by point. Points
with a null or non-finite coordinate are near no node, and their sums are null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crestline.functions.geometry import columns, spherical_pdf, squared_distance
from crestline.functions.stats import covariance
from crestline.operators.dense import Cells, shares
from crestline.operators.spatial import knn_join, range_join

DIMS = ("x", "y")
#: Nodes whose table is sent to every executor; a larger table is joined where sums have a cutoff, and an error where they have none.
SMALL_NODES = 100_000
#: Pairs of a point and a node that a task works on at once.
CELLS = 2_000_000


@dataclass(frozen=True)
class Held:
    """Nodes as arrays, in the order of their numbers."""

    ids: np.ndarray
    x: np.ndarray
    extra: dict[str, np.ndarray]


def held_nodes(nodes: DataFrame, dims: Sequence[str], extra: Sequence[str] = ("sig", "pi"), most: int = SMALL_NODES) -> Held | None:
    """The nodes if there are at most `most`."""
    wanted = [F.col("node").cast("long"), *[F.col(c).cast("double").alias(c) for c in (*dims, *extra)]]
    table = nodes.select(*wanted).limit(max(most, 0) + 1).toArrow()
    if table.num_rows > most:
        return None
    order = np.argsort(table.column(0).to_numpy(), kind="stable")
    ids, *values = (c.to_numpy()[order] for c in table.columns)
    return Held(ids, np.stack(values[: len(dims)], 1).astype(float), dict(zip(extra, values[len(dims) :], strict=True)))


def all_held(nodes: DataFrame, dims: Sequence[str], extra: Sequence[str] = ("sig", "pi")) -> Held:
    held = held_nodes(nodes, dims, extra)
    if held is None:
        raise ValueError(f"sums without cutoff take at most {SMALL_NODES} nodes")
    return held


def by_point(points: DataFrame, dims: Sequence[str], schema: str, work: Callable[[pa.Array, np.ndarray], Iterator[list]], width: int) -> DataFrame:
    """Rows of work(ids, coordinates) over blocks of points so that a block has CELLS pairs with width nodes; each result is a list of columns of schema after the id's."""
    kind = points.schema["id"].dataType.simpleString()
    names = ["id", *[c.split()[0] for c in schema.split(", ")]]
    step = max(1, CELLS // max(1, width))

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in part.columns[1:]], 1)
                for columns_of in work(part.column(0), x):
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, from_pandas=True) for c in columns_of], names)

    return points.select("id", *[F.col(d).cast("double").alias(d) for d in dims]).mapInArrow(run, f"id {kind}, {schema}")


def squared(x: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Squared distances, points by nodes."""
    return sum((x[:, j, None] - nodes[None, :, j]) ** 2 for j in range(x.shape[1]))


def log_densities(d2: np.ndarray, sig: np.ndarray, d: int) -> np.ndarray:
    return -d2 / (2 * sig) - d / 2 * np.log(2 * np.pi * sig)


def softmax(e: np.ndarray) -> np.ndarray:
    """Shares of exp(e) by row."""
    p = np.exp(e - e.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def spread(ids: pa.Array, nodes: np.ndarray, values: np.ndarray) -> list:
    """Columns id, node and value of a table of points by nodes; rows of a null value are left out."""
    n, k = values.shape
    kept = np.flatnonzero(~np.isnan(values.ravel()))
    return [ids.take(pa.array(kept // k)), nodes[kept % k], values.ravel()[kept]]


def near_pairs(points: DataFrame, nodes: DataFrame, ksig: float = 7.0, dims: Sequence[str] = DIMS) -> DataFrame:
    """(id, node, d2, sig, pi) for points within ksig standard deviations of a node."""
    reach = nodes.withColumn("reach", F.sqrt("sig") * ksig)
    found = range_join(points, reach, "reach", dims=dims, right_extra=["sig", "pi"])
    return found.select(F.col("l_id").alias("id"), F.col("r_id").alias("node"), "d2", F.col("r_sig").alias("sig"), F.col("r_pi").alias("pi"))


def responsibilities(points: DataFrame, nodes: DataFrame, *, ksig: float = 7.0, alpha: float = 0.0, area: float = 1.0, background: bool = False, dims: Sequence[str] = DIMS, small_nodes: int = SMALL_NODES) -> DataFrame:
    """(id, node, r): share of each node in a point, its weight times density over the row's total; with a background, alpha / area
    takes part, and its share is on rows of node -1 (1 for a point that is near no node). Points without either give no row.
    More than small_nodes nodes are joined to the points by cells."""
    held = held_nodes(nodes, dims, most=small_nodes)
    floor = alpha / area if background else 0.0
    if held is not None and len(held.ids):
        sig, pi = held.extra["sig"], held.extra["pi"]

        def work(ids, x):
            cells = Cells(held.x, sig, ksig)
            usable = np.flatnonzero(np.isfinite(x).all(1))
            inside = np.zeros(len(x))
            for p, k, r in shares(cells, x[usable], sig, pi, floor):
                inside[usable] += np.bincount(p, r, len(usable))
                some = r > 0 if floor > 0 else np.ones(len(r), bool)
                yield [ids.take(pa.array(usable[p[some]])), held.ids[k[some]], r[some]]
            if background:
                yield [ids, np.full(len(x), -1), np.maximum(0.0, 1 - inside)]

        return by_point(points, dims, "node bigint, r double", work, 16)
    pairs = near_pairs(points, nodes, ksig, dims).withColumn("p", F.col("pi") * spherical_pdf(F.col("d2"), F.col("sig"), len(dims)))
    rows = pairs.select("id", "node", "p")
    if background:
        rows = rows.unionByName(points.select("id", F.lit(-1).cast("long").alias("node"), F.lit(floor).alias("p")))
    return row_normalise(rows, "id", "p", "r").select("id", "node", "r")


def row_normalise(rows: DataFrame, row: str, value: str, into: str, constant: float = 0.0) -> DataFrame:
    """value over (constant + sum of the row); null where that is zero."""
    whole = F.sum(value).over(Window.partitionBy(row)) + constant
    return rows.withColumn(into, F.when(whole != 0, F.col(value) / whole))


def softmax_responsibility(points: DataFrame, nodes: DataFrame, dims: Sequence[str] = DIMS) -> DataFrame:
    """(id, node, r): softmax of -d2 / 2 sig over all nodes, without weights or cutoff."""
    held = all_held(nodes, dims, ["sig"])

    def work(ids, x):
        yield spread(ids, held.ids, softmax(-squared(x, held.x) / (2 * held.extra["sig"])))

    return by_point(points, dims, "node bigint, r double", work, len(held.ids))


def densities(points: DataFrame, nodes: DataFrame, dims: Sequence[str] = DIMS) -> DataFrame:
    """(id, node, p): density of each node's Gaussian at each point."""
    if nodes.limit(SMALL_NODES + 1).count() > SMALL_NODES:
        raise ValueError(f"sums without cutoff take at most {SMALL_NODES} nodes")
    few = nodes.select("node", *[F.col(d).alias(f"n_{d}") for d in dims], "sig")
    both = points.crossJoin(F.broadcast(few))
    return both.select("id", "node", spherical_pdf(squared_distance(columns(dims), columns(dims, "n_")), F.col("sig"), len(dims)).alias("p"))


def full_covariance_responsibilities(points: DataFrame, nodes: DataFrame, dims: Sequence[str] = DIMS) -> DataFrame:
    """(id, node, r) with a full covariance for each node (columns c_xx, c_xy, ...), equal weights and no background."""
    names = [f"c_{a}{b}" for i, a in enumerate(dims) for b in dims[i:]]
    held = all_held(nodes, dims, names)
    k, d = held.x.shape
    c = np.zeros((k, d, d))
    for n in names:
        i, j = dims.index(n[2]), dims.index(n[3])
        c[:, i, j] = c[:, j, i] = held.extra[n]
    turned, log_size = np.linalg.inv(c), np.linalg.slogdet(c)[1]

    def work(ids, x):
        far = x[:, None, :] - held.x[None]
        q = np.einsum("pkd,kde,pke->pk", far, turned, far, optimize=True)
        yield spread(ids, held.ids, softmax(-(q + log_size) / 2))

    return by_point(points, dims, "node bigint, r double", work, len(held.ids) * len(dims))


def node_sums(points: DataFrame, resp: DataFrame, dims: Sequence[str] = DIMS) -> DataFrame:
    """Per node: n (sum of r), and sums of r d, r d d' for dimensions d <= d', as s_d and s_dd'. Background rows are left out."""
    rows = resp.where("node >= 0").join(points.select("id", *dims), "id")
    crossed = [(a, b) for i, a in enumerate(dims) for b in dims[i:]]
    return rows.groupBy("node").agg(
        F.sum("r").alias("n"),
        *[F.sum(F.col("r") * F.col(d)).alias(f"s_{d}") for d in dims],
        *[F.sum(F.col("r") * F.col(a) * F.col(b)).alias(f"s_{a}{b}") for a, b in crossed],
    )


def weighted_covariance(points: DataFrame, nodes: DataFrame, resp: DataFrame, dims: Sequence[str] = DIMS, diagonal: bool = False) -> DataFrame:
    """(node, n, c_dd', ...): weighted covariance of the points of a node around the node's own position."""
    sums = node_sums(points, resp, dims).join(nodes.select("node", *dims), "node")
    crossed = [(a, b) for i, a in enumerate(dims) for b in dims[i:] if a == b or not diagonal]
    n = F.col("n")

    def c(a, b):
        return F.col(f"s_{a}{b}") / n - F.col(f"s_{a}") / n * F.col(b) - F.col(f"s_{b}") / n * F.col(a) + F.col(a) * F.col(b)

    return sums.select("node", "n", *[c(a, b).alias(f"c_{a}{b}") for a, b in crossed])


def mixture_update(points: DataFrame, nodes: DataFrame, resp: DataFrame, dims: Sequence[str] = DIMS) -> DataFrame:
    """(node, n, sig, pi): spherical variance around the node (mean of the diagonal) and share of all points."""
    around = weighted_covariance(points, nodes, resp, dims, diagonal=True)
    total = points.select(F.count("*").alias("_all"))
    mean = sum(F.col(f"c_{d}{d}") for d in dims) / len(dims)
    return around.join(F.broadcast(total)).select("node", "n", mean.alias("sig"), (F.col("n") / F.col("_all")).alias("pi"))


def background_share(points: DataFrame, resp: DataFrame) -> DataFrame:
    """One row, alpha: mean share of the background."""
    total = points.select(F.count("*").alias("_all"))
    given = resp.where("node = -1").agg(F.coalesce(F.sum("r"), F.lit(0.0)).alias("_sum"))
    return given.join(total).select((F.col("_sum") / F.col("_all")).alias("alpha"))


def smoothed_variance(nodes: DataFrame, edges: DataFrame, lam_sig: float, dims: Sequence[str] = DIMS, floor: float = 0.0, fresh: str = "sig0", weight: str = "n") -> DataFrame:
    """(node, sig): fresh variance drawn to the mean of the neighbours' sig by c = 4 lam_sig / (D n); a node without neighbour keeps
    its fresh one; not below floor. Neighbours count once."""
    ways = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    near = ways.join(nodes.select(F.col("node").alias("dst"), "sig"), "dst").groupBy(F.col("src").alias("node")).agg(F.avg("sig").alias("around"))
    c = 4 * lam_sig / (len(dims) * F.col(weight))
    drawn = F.when(F.col("around").isNull(), F.col(fresh)).otherwise((F.col(fresh) + c * F.col("around")) / (1 + c))
    return nodes.join(near, "node", "left").select("node", F.greatest(drawn, F.lit(float(floor))).alias("sig"))


def log_likelihoods(x: np.ndarray, held: Held, floor: float = 0.0) -> np.ndarray:
    """Log of the mixture's density at each of x, with floor (background density) added once."""
    e = np.log(held.extra["pi"]) + log_densities(squared(x, held.x), held.extra["sig"], x.shape[1])
    top = e.max(1)
    if floor > 0:
        top = np.maximum(top, np.log(floor))
    return top + np.log(np.exp(e - top[:, None]).sum(1) + (floor * np.exp(-top) if floor > 0 else 0.0))


def log_likelihood_rows(points: DataFrame, nodes: DataFrame, dims: Sequence[str] = DIMS, floor: float = 0.0) -> DataFrame:
    """(id, ll): log of the mixture's density at each point, with floor (background density) added once."""
    held = all_held(nodes, dims)

    def work(ids, x):
        yield [ids, log_likelihoods(x, held, floor)]

    return by_point(points, dims, "ll double", work, len(held.ids))


def log_likelihood(points: DataFrame, nodes: DataFrame, dims: Sequence[str] = DIMS) -> DataFrame:
    """One row, ll: log-likelihood without prior and background."""
    return log_likelihood_rows(points, nodes, dims).agg(F.sum("ll").alias("ll"))


def objective(points: DataFrame, nodes: DataFrame, edges: DataFrame, lam: float, *, alpha: float = 0.0, area: float = 1.0, background: bool = False, dims: Sequence[str] = DIMS) -> DataFrame:
    """One row, objective: log-likelihood less lam times the sum over edges of squared lengths (multiplicity counted).
    The background's density is added once to each point's sum."""
    rows = log_likelihood_rows(points, nodes, dims, alpha / area if background else 0.0).agg(F.sum("ll").alias("ll"))
    a = nodes.select(F.col("node").alias("src"), *[F.col(d).alias(f"a_{d}") for d in dims])
    b = nodes.select(F.col("node").alias("dst"), *[F.col(d).alias(f"b_{d}") for d in dims])
    rough = edges.join(a, "src").join(b, "dst").agg(F.coalesce(F.sum(squared_distance(columns(dims, "a_"), columns(dims, "b_"))), F.lit(0.0)).alias("rough"))
    return rows.join(rough).select((F.col("ll") - lam * F.col("rough")).alias("objective"))


def local_objective(points: DataFrame, nodes: DataFrame, dims: Sequence[str] = DIMS, h: float = 1.0) -> DataFrame:
    """(node, value): sum over points of the log density, weighted by a Gaussian of variance h * h around the node."""
    held = all_held(nodes, dims)
    d = len(dims)
    step = max(1, CELLS // max(1, len(held.ids)))

    def run(batches):
        sums = np.zeros(len(held.ids))
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.slice(a, step).columns], 1)
                x = x[np.isfinite(x).all(1)]
                kernel = np.exp(log_densities(squared(x, held.x), np.full(len(held.ids), h * h), d))
                sums += (kernel * log_likelihoods(x, held)[:, None]).sum(0) if len(x) else 0
        yield pa.RecordBatch.from_arrays([pa.array(held.ids), pa.array(sums)], ["node", "value"])

    # a task sends one sum for each node
    part = points.select(*[F.col(c).cast("double").alias(c) for c in dims]).mapInArrow(run, "node bigint, value double")
    return part.groupBy("node").agg(F.sum("value").alias("value"))


def mixture_density(points: DataFrame, nodes: DataFrame, dims: Sequence[str] = DIMS) -> DataFrame:
    """(id, density): the mixture's density at each point, scaled so that the sum over points is the number of nodes."""
    own = log_likelihood_rows(points, nodes, dims).select("id", F.exp("ll").alias("p"))
    scale = own.agg(F.sum("p").alias("s")).join(nodes.agg(F.count("*").alias("k")))
    return own.join(F.broadcast(scale)).select("id", (F.col("p") / F.col("s") * F.col("k")).alias("density"))


def neighbour_covariance(points: DataFrame, centres: DataFrame, k: int, dims: Sequence[str] = DIMS) -> DataFrame:
    """(node, n, c_dd', ...): sample covariance of the k nearest points of each centre."""
    near = knn_join(centres, points, k, query_id="node", dims=dims)
    rows = near.select(F.col("q_id").alias("node"), F.col("p_id").alias("id")).join(points.select("id", *dims), "id")
    return covariance(rows, ["node"], dims)


def box_area(points: DataFrame, dims: Sequence[str] = DIMS) -> float:
    """Area (volume) of the bounding box of the points with finite coordinates."""
    finite = " and ".join(f"{d} is not null and not isnan({d}) and abs({d}) < double('infinity')" for d in dims)
    box = points.where(finite).agg(*[(F.max(d) - F.min(d)).alias(d) for d in dims]).first()
    return reduce(mul, [box[d] for d in dims])

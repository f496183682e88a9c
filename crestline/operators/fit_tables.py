"""Fits whose model is a table too: for as many nodes as there are points.

A round is a few joins. Points meet the nodes near them by cells of powers of two (range_join), shares are taken within a point's few pairs,
and each node's sums come from a groupBy that Spark combines before it shuffles. New positions solve the system of the graph by
tables (operators/solve.py), variances are drawn to those of neighbours by a join along the edges, and the graph is built anew over the new
positions. Only counts and the largest movement come to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.functions.geometry import columns, spherical_pdf, squared_distance
from crestline.functions.stats import bandwidth
from crestline.operators.graph import numbered_rows
from crestline.operators.mixture import box_area
from crestline.operators.solve import solve
from crestline.operators.spatial import range_join
from crestline.operators.state import cut
from crestline.operators.topology import TOPOLOGIES

DIMS = ("x", "y")


@dataclass(frozen=True)
class TableModel:
    """A fitted graph: node_rows(node, dims, sig, pi), edge_rows(src, dst) as listed by the topology, and the background's weight."""

    node_rows: DataFrame
    edge_rows: DataFrame
    alpha: float = 0.0
    area: float = 1.0
    background: bool = False
    dims: tuple[str, ...] = DIMS
    movements: tuple[float, ...] = field(default=())

    def nodes(self, spark=None) -> DataFrame:
        return self.node_rows

    def edge_table(self, spark=None) -> DataFrame:
        return numbered_rows(self.edge_rows.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")))


def expectation(points: DataFrame, nodes: DataFrame, floor: float, ksig: float, dims: Sequence[str]) -> DataFrame:
    """(node, n, f_d, s_d): sums over near points of their share, and of it times the difference from the node and its square."""
    reach = nodes.withColumn("reach", F.sqrt("sig") * ksig)
    pairs = range_join(points, reach, "reach", dims=dims, right_extra=["sig", "pi"])
    weighed = pairs.select(F.col("l_id").alias("id"), F.col("r_id").alias("node"), (F.col("r_pi") * spherical_pdf(F.col("d2"), F.col("r_sig"), len(dims))).alias("w"), *[(F.col(f"l_{d}") - F.col(f"r_{d}")).alias(f"m_{d}") for d in dims])
    whole = weighed.groupBy("id").agg(F.sum("w").alias("whole"))
    shares = weighed.join(whole, "id").withColumn("r", F.col("w") / F.greatest(F.col("whole") + floor, F.lit(1e-300)))
    sums = [F.sum("r").alias("n"), *[F.sum(F.col("r") * F.col(f"m_{d}")).alias(f"f_{d}") for d in dims], *[F.sum(F.col("r") * F.col(f"m_{d}") * F.col(f"m_{d}")).alias(f"s_{d}") for d in dims]]
    return shares.groupBy("node").agg(*sums)


def around(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, around): mean variance of distinct neighbours."""
    ways = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    return ways.join(nodes.select(F.col("node").alias("dst"), "sig"), "dst").groupBy(F.col("src").alias("node")).agg(F.avg("sig").alias("around"))


def fit_tables(points: DataFrame, nodes: DataFrame, par, *, dims: Sequence[str] = DIMS) -> TableModel:
    """The fit of operators/fit.py (parameters as there) for any number of nodes(node, dims[, sig][, pi])."""
    if par.covariance != "spherical":
        raise ValueError("fits take spherical covariances; full ones have a responsibility operator of their own")
    finite = " and ".join(f"{d} is not null and not isnan({d}) and abs({d}) < double('infinity')" for d in dims)
    held = cut(points.select("id", *[F.col(d).cast("double").alias(d) for d in dims]).where(finite))
    count, k, per_node = held.count(), nodes.count(), "sig" in nodes.columns
    if not k:
        raise ValueError("a model has at least one node")
    start = par.sig if par.sig is not None else None if per_node else bandwidth(held, par.a0, dims).first().sig
    alpha = par.alpha if par.background else 0.0
    area = par.area if par.area is not None else box_area(held, dims) if par.background else 1.0
    lam = par.lam if per_node else par.lam / start
    sig = F.col("sig").cast("double") if per_node else F.lit(float(start))
    pi = F.col("pi").cast("double") if "pi" in nodes.columns else F.lit((1 - alpha) / k)
    now = cut(nodes.select(F.col("node").cast("long").alias("node"), *[F.col(d).cast("double").alias(d) for d in dims], sig.alias("sig"), pi.alias("pi")))
    build = TOPOLOGIES[par.topology] if isinstance(par.topology, str) else par.topology

    def graph(rows: DataFrame) -> DataFrame:
        return cut(build(rows.select("node", *dims)).select("src", "dst"))

    edges, movements = graph(now), []
    for t in range(par.max_rounds):
        sums = expectation(held, now, alpha / area if par.background else 0.0, par.ksig, dims)
        names = ["n", *[f"{p}_{d}" for p in "fs" for d in dims]]
        met = now.join(sums, "node", "left").fillna(0.0, names).withColumn("weight", F.greatest("n", F.lit(float(par.eps))))
        met = cut(met.withColumns({f"b_{d}": (F.col(f"f_{d}") + F.col("n") * F.col(d)) / F.col("sig") for d in dims} | {"ridge": F.col("weight") / F.col("sig")}))
        right = [f"b_{d}" for d in dims]
        new = solve(met.select("node", "ridge", *right), edges, lam, right=right).withColumnsRenamed({f"b_{d}": f"n_{d}" for d in dims})
        moved = met.join(new, "node").join(around(now, edges), "node", "left")
        alpha = max(0.0, count - (met.agg(F.sum("n").alias("s")).first().s or 0.0)) / max(count, 1) if par.background else 0.0
        if par.update == "fixed":
            sig, pi = F.col("sig"), F.lit((1 - alpha) / k) if par.background else F.col("pi")
        else:
            step = {d: F.col(f"n_{d}") - F.col(d) for d in dims}
            fresh = sum((F.col(f"s_{d}") - 2 * step[d] * F.col(f"f_{d}") + step[d] * step[d] * F.col("n")) / F.col("weight") for d in dims) / len(dims)
            c = 4 * par.lam_sig / (len(dims) * F.col("weight"))
            drawn = F.when(F.col("around").isNull(), fresh).otherwise((fresh + c * F.col("around")) / (1 + c))
            sig = F.greatest(drawn, F.lit(max(float(par.min_sigma), 1e-300)))
            pi = (F.col("weight") / max(count, 1) + par.lam_pi * (1 - alpha) / k) / (1 + par.lam_pi)
        far2 = squared_distance(columns(dims), columns(dims, "n_"))
        now = cut(moved.select("node", *[F.col(f"n_{d}").alias(d) for d in dims], sig.alias("sig"), pi.alias("pi"), far2.alias("far2")))
        far = now.agg(F.sum("far2").alias("all"), F.max("far2").alias("most")).first()
        now = now.drop("far2")
        movements.append(far["all"] ** 0.5)
        if (t and t % par.refresh_every == 0) or t <= 3:
            edges = graph(now)
        if movements[-1] < par.eps or far["most"] ** 0.5 < par.eps:
            break
    return TableModel(now, edges, alpha, area, par.background, tuple(dims), tuple(movements))

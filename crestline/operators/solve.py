"""Systems (lam L + diagonal) F = right over a graph kept as tables, L its Laplacian.

Nodes with at most two neighbours are eliminated, round by round, an independent set of them at a time: ends give what
they hold to their neighbour, and a node between two others leaves an edge in its place. Trees and chains vanish in a number of rounds that grows
with the logarithm of their size, and the solution, exact up to rounding, comes back in reverse. What has more neighbours everywhere goes through
conjugate gradients, whose residual is checked: a system that does not settle is an error.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.operators import dense
from crestline.operators.state import cut, limits

#: Neighbours of nodes that are eliminated.
FEW = 2


def ways_of(edges: DataFrame, lam: float) -> DataFrame:
    """(src, dst, w) in both directions; w is lam times the multiplicity."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst")
    return both.groupBy("src", "dst").agg((F.count("*") * float(lam)).alias("w"))


def solve(nodes: DataFrame, edges: DataFrame, lam: float, *, ridge: str = "ridge", right: Sequence[str] = ("x", "y"), settled: float = 1e-12, most_steps: int = 10_000) -> DataFrame:
    """(node, right...): the solution for nodes(node, ridge > 0, right...). A system that limits().edges lets be held is solved at once."""
    right = list(right)
    ways = cut(ways_of(edges, lam))
    degree = ways.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("w"))
    left = nodes.select("node", F.col(ridge).alias("d"), *right).join(degree, "node", "left")
    left = cut(left.select("node", (F.col("d") + F.coalesce("w", F.lit(0.0))).alias("d"), *right))
    gone: list[DataFrame] = []
    found = held(left, ways, right)
    while found is None:
        few = eliminable(left, ways, right, len(gone))
        if few.isEmpty():
            found = left.select("node", *right) if left.isEmpty() else conjugate_gradients(left, ways, right, settled, most_steps)
            break
        gone.append(few)
        left, ways = without(left, ways, few, right)
        found = held(left, ways, right)
    for few in reversed(gone):
        found = cut(found.unionByName(returned(few, found, right)))
    return found


def held(left: DataFrame, ways: DataFrame, right: list[str]) -> DataFrame | None:
    """The solution if the graph that is left may be held."""
    most = limits().edges
    if most < 0:
        return None
    # counted first, so that no round of a larger system brings a part of it here
    if left.count() > most or ways.count() > 2 * most:
        return None
    rows, pairs = left.toArrow(), ways.where("src < dst").toArrow()
    ids, d, *b = (c.to_numpy() for c in rows.select(["node", "d", *right]).columns)
    order = np.argsort(ids)
    src, dst = (order[np.searchsorted(ids[order], pairs.column(c).to_numpy())] for c in ("src", "dst"))
    x = dense.weighted_solve(d, src, dst, pairs.column("w").to_numpy(), np.stack(b, 1).astype(float).reshape(len(ids), len(right)))
    return left.sparkSession.createDataFrame(pa.table({"node": ids, **{c: x[:, j] for j, c in enumerate(right)}}))


def eliminable(left: DataFrame, ways: DataFrame, right: list[str], salt: int) -> DataFrame:
    """Nodes with few neighbours (first: u and wu, second: v and wv), none beside another."""
    around = ways.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("c"), F.min(F.struct("dst", "w")).alias("a"), F.max(F.struct("dst", "w")).alias("b"))
    slim = left.join(around, "node", "left").where(f"c is null or c <= {FEW}").withColumn("turn", F.xxhash64("node", F.lit(salt)))
    slim = cut(slim.select("node", "d", *right, "turn", F.col("a.dst").alias("u"), F.col("a.w").alias("wu"), F.when(F.col("c") == FEW, F.col("b.dst")).alias("v"), F.when(F.col("c") == FEW, F.col("b.w")).alias("wv")))
    beside = slim.select("node", "turn", F.explode(F.array("u", "v")).alias("other")).join(slim.select(F.col("node").alias("other"), F.col("turn").alias("t")), "other")
    later = beside.where("t < turn or (t = turn and other < node)").select("node").distinct()
    return cut(slim.join(later, "node", "left_anti").drop("turn"))


def without(left: DataFrame, ways: DataFrame, few: DataFrame, right: list[str]) -> tuple[DataFrame, DataFrame]:
    """What is left of the system once few are expressed by their neighbours."""
    sides = few.select("d", *right, F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("wu").alias("w")), F.struct(F.col("v").alias("node"), F.col("wv").alias("w")))).alias("s")).where("s.node is not null")
    given = sides.groupBy(F.col("s.node").alias("node")).agg(F.sum(F.col("s.w") * F.col("s.w") / F.col("d")).alias("_d"), *[F.sum(F.col("s.w") * F.col(c) / F.col("d")).alias(f"_{c}") for c in right])
    gone = few.select("node")
    rest = left.join(gone, "node", "left_anti").join(given, "node", "left")
    rest = rest.select("node", (F.col("d") - F.coalesce("_d", F.lit(0.0))).alias("d"), *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0.0))).alias(c) for c in right])
    between = few.where("v is not null").select("u", "v", (F.col("wu") * F.col("wv") / F.col("d")).alias("w"))
    new = between.select(F.col("u").alias("src"), F.col("v").alias("dst"), "w").unionByName(between.select(F.col("v").alias("src"), F.col("u").alias("dst"), "w"))
    kept = ways.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
    return cut(rest), cut(kept.unionByName(new).groupBy("src", "dst").agg(F.sum("w").alias("w")))


def returned(few: DataFrame, found: DataFrame, right: list[str]) -> DataFrame:
    """The solution at few from that at their neighbours."""
    rows = few
    for side in "uv":
        rows = rows.join(found.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in right]), side, "left")
    return rows.select("node", *[((F.col(c) + F.coalesce(F.col("wu") * F.col(f"u_{c}"), F.lit(0.0)) + F.coalesce(F.col("wv") * F.col(f"v_{c}"), F.lit(0.0))) / F.col("d")).alias(c) for c in right])


def conjugate_gradients(left: DataFrame, ways: DataFrame, right: list[str], settled: float, most_steps: int) -> DataFrame:
    """By rounds of one join with the neighbours and sums over all nodes, preconditioned by the diagonal."""
    k = range(len(right))
    now = left.select("node", "d", *[(F.col(c) / F.col("d")).alias(f"x{j}") for j, c in enumerate(right)], *[F.col(c).alias(f"b{j}") for j, c in enumerate(right)])

    def times(rows: DataFrame, name: str) -> DataFrame:
        """rows with q0.. = matrix times name0.."""
        near = rows.select(F.col("node").alias("dst"), *[f"{name}{j}" for j in k])
        given = ways.join(near, "dst").groupBy(F.col("src").alias("node")).agg(*[F.sum(F.col("w") * F.col(f"{name}{j}")).alias(f"g{j}") for j in k])
        return rows.join(given, "node", "left").withColumns({f"q{j}": F.col("d") * F.col(f"{name}{j}") - F.coalesce(f"g{j}", F.lit(0.0)) for j in k}).drop(*[f"g{j}" for j in k])

    most = left.agg(*[F.max(F.abs(c)) for c in right]).first()
    enough = settled * max(1.0, *map(float, most))
    now = times(now, "x").withColumns({f"r{j}": F.col(f"b{j}") - F.col(f"q{j}") for j in k})
    now = cut(now.withColumns({f"p{j}": F.col(f"r{j}") / F.col("d") for j in k}).drop(*[f"q{j}" for j in k], *[f"b{j}" for j in k]))
    state = [*[F.sum(F.col(f"r{j}") * F.col(f"r{j}") / F.col("d")) for j in k], *[F.max(F.abs(f"r{j}")) for j in k]]
    sums = now.agg(*state).first()
    for _ in range(most_steps):
        if max(sums[len(right) :]) <= enough:
            return now.select("node", *[F.col(f"x{j}").alias(c) for j, c in enumerate(right)])
        ahead = cut(times(now, "p"))
        along = ahead.agg(*[F.sum(F.col(f"p{j}") * F.col(f"q{j}")) for j in k]).first()
        step = [sums[j] / along[j] if along[j] > 0 else 0.0 for j in k]
        moved = cut(ahead.withColumns({f"x{j}": F.col(f"x{j}") + step[j] * F.col(f"p{j}") for j in k} | {f"r{j}": F.col(f"r{j}") - step[j] * F.col(f"q{j}") for j in k}).drop(*[f"q{j}" for j in k]))
        after = moved.agg(*state).first()
        turn = [after[j] / sums[j] if sums[j] > 0 else 0.0 for j in k]
        # the turn is worked into the next table that is written
        now, sums = moved.withColumns({f"p{j}": F.col(f"r{j}") / F.col("d") + turn[j] * F.col(f"p{j}") for j in k}), after
    raise RuntimeError(f"the system did not settle in {most_steps} steps: residual {max(sums[len(right) :])}")

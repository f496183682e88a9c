"""What replicas of a graph say about it: probability maps and position uncertainty."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.functions.stats import bounding_box
from crestline.operators.spatial import knn_join
from crestline.operators.state import limits

DIMS = ("x", "y")


def sampled_segments(segments: DataFrame, steps: str, dims: Sequence[str] = DIMS, keep: Sequence[str] = ()) -> DataFrame:
    """Points a + k (b - a) / steps for k from 0 to int(steps), and b itself, of segments with ends a_d and b_d."""
    k = F.explode(F.concat(F.transform(F.sequence(F.lit(0), F.col(steps).cast("int")), lambda i: i / F.col(steps)), F.array(F.lit(None).cast("double"))))
    spread = segments.select(*keep, *[f"{p}_{d}" for d in dims for p in "ab"], k.alias("_t"))
    return spread.select(*keep, *[F.coalesce(F.col(f"a_{d}") + F.col("_t") * (F.col(f"b_{d}") - F.col(f"a_{d}")), F.col(f"b_{d}")).alias(d) for d in dims])


def probability_map(points: DataFrame, nodes: DataFrame, edges: DataFrame, cells: int | Sequence[int], dims: Sequence[str] = DIMS) -> DataFrame:
    """(i_d, ..., p): share of replicas whose edges cross a cell. nodes and edges carry rep. A dimension has bins of its range over `cells`, counted
    from the minimum; the last strip is left out, so cells run from 0 to cells - 2, and the last cell holds its upper border."""
    counts = [cells] * len(dims) if isinstance(cells, int) else list(cells)
    box = bounding_box(points, dims).first()
    a = nodes.select("rep", F.col("node").alias("src"), *[F.col(d).alias(f"a_{d}") for d in dims])
    b = nodes.select("rep", F.col("node").alias("dst"), *[F.col(d).alias(f"b_{d}") for d in dims])
    reps = nodes.select("rep").distinct().count()
    seg = edges.join(a, ["rep", "src"]).join(b, ["rep", "dst"])
    size = F.sqrt(sum((F.col(f"b_{d}") - F.col(f"a_{d}")) * (F.col(f"b_{d}") - F.col(f"a_{d}")) for d in dims))
    seg = seg.withColumn("_n", size / (box.shortest / max(counts) / 5)).where("_n > 0")
    drawn = sampled_segments(seg, "_n", dims, ["rep"])
    names = []
    for d, n in zip(dims, counts, strict=True):
        step = (box[f"max_{d}"] - box[f"min_{d}"]) / n
        place = F.floor((F.col(d) - box[f"min_{d}"]) / step)
        drawn = drawn.withColumn(f"i_{d}", F.when(F.col(d) == box[f"min_{d}"] + (n - 1) * step, F.lit(n - 2)).otherwise(place).cast("long")).where(f"i_{d} between 0 and {n - 2}")
        names.append(f"i_{d}")
    return drawn.select("rep", *names).distinct().groupBy(*names).agg((F.count("*") / reps).alias("p"))


def position_uncertainty(nodes: DataFrame, replicas: DataFrame, dims: Sequence[str] = DIMS, local_points: int | None = None) -> DataFrame:
    """(node, rho): root mean square over replicas of a node's distance to the replica's nearest node. Where nodes or a replica are more than
    local_points (limits().nodes, if not given), nodes descend through the cells of each replica."""
    most = limits().nodes if local_points is None else local_points
    own = nodes.select("node", *dims).limit(max(most, 0) + 1).collect()
    if len(own) > most or (replicas.groupBy("rep").count().agg(F.max("count").alias("n")).first().n or 0) > most:
        reps = [r.rep for r in replicas.select("rep").distinct().collect()]
        asked = nodes.select("node", *dims, F.explode(F.array(*map(F.lit, reps))).alias("rep"))
        found = knn_join(asked, replicas.withColumn("_id", F.col("node")), 1, query_id="node", point_id="_id", dims=dims, key="rep")
        return found.groupBy(F.col("q_id").alias("node")).agg(F.sqrt(F.avg("d2")).alias("rho"))
    own.sort(key=lambda r: r[0])
    ids = np.array([r[0] for r in own], np.int64)
    x = np.array([r[1:] for r in own], float).reshape(-1, len(dims))

    def nearest(table: pa.Table) -> pa.Table:
        there = np.stack([table.column(d).to_numpy() for d in dims], 1)
        best = np.full(len(x), np.inf)
        step = max(1, 4_000_000 // max(1, len(x)))
        for a in range(0, len(there), step):
            d2 = sum((x[:, j, None] - there[None, a : a + step, j]) ** 2 for j in range(len(dims)))
            best = np.minimum(best, d2.min(1))
        return pa.table({"node": ids, "d2": best})

    found = replicas.select("rep", *dims).groupBy("rep").applyInArrow(nearest, "node bigint, d2 double")
    return found.groupBy("node").agg(F.sqrt(F.avg("d2")).alias("rho"))

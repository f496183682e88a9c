"""Delaunay edges by cells that learn what they need of their surroundings.

The points of a cell are triangulated with their nearest neighbours. A simplex at a point of the cell is right if no point of the whole set lies in
its sphere: known at once where the sphere lies within the ball that the point's list of neighbours fills, and searched for in the pyramid
otherwise. What is found inside a sphere joins the cell's points, and the cell is triangulated again, until nothing is found; so
only cells at borders and gaps of the set go on, and each gathers a few points more. When all simplices around a point are right,
they are those of the whole set. Far corners, the same for all cells, stand for what is outside.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.operators import dense, pyramid
from crestline.operators.state import cut

#: Points of a cell, and neighbours of each of them, by dimensions.
CELL_POINTS = 48
NEIGHBOURS = {2: 16, 3: 28}


def scaled(nodes: DataFrame, dims: Sequence[str]) -> DataFrame:
    """(id, dims) about the origin, of extent 1, each point shifted a little."""
    finite = " and ".join(f"{d} is not null and not isnan({d}) and abs({d}) < double('infinity')" for d in dims)
    rows = nodes.select(F.col("node").cast("long").alias("id"), *[F.col(d).cast("double").alias(d) for d in dims]).where(finite)
    span = rows.agg(*[f(d) for d in dims for f in (F.min, F.max, F.avg)]).first()
    low, high, mean = (np.array(span[k::3], float) for k in range(3))
    extent = max(float((high - low).max()), 1e-12)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            x = np.stack([c.to_numpy() for c in batch.columns[1:]], 1)
            x = (x - mean + dense.unit_shift(ids, len(dims)) * extent * 1e-9) / extent
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x[:, j]) for j in range(len(dims))]], ["id", *dims])

    return rows.mapInArrow(run, "id bigint, " + ", ".join(f"{d} double" for d in dims))


def stars(state: DataFrame, dims: Sequence[str]) -> DataFrame:
    """From (cell, own, around), own with the squared radius `filled` of the ball in which all points are at hand: rows (cell, src, dst) for the edges at
    own points, and (cell, k, c_d, r2) for the spheres that may hold others."""
    names = ["cell", "src", "dst", "k", *[f"c_{d}" for d in dims], "r2"]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, own, around in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                rows = {r["id"]: [r[d] for d in dims] for r in [*own, *around]}
                filled = np.array([r["filled"] for r in own])
                ids, x = list(rows), np.array(list(rows.values()))
                n, mine = len(ids), len(own)
                edges, spheres = set(), []
                for simplex, (centre, r2) in zip(*dense.simplices(x), strict=True):
                    at = [p for p in simplex if p < mine]
                    if not at:
                        continue
                    edges |= {(min(ids[a], ids[b]), max(ids[a], ids[b])) for a in at for b in simplex if b < n and b != a}
                    # a sphere through a point lies in the ball of twice its radius around it
                    if not (4 * r2 <= filled[at]).any():
                        spheres.append((*centre, r2))
                e, s = len(edges), len(spheres)
                edges, spheres = np.array(sorted(edges), np.int64).reshape(-1, 2), np.array(spheres, float).reshape(-1, len(dims) + 1)
                none, gap = pa.nulls(s, pa.int64()), pa.nulls(e, pa.float64())
                both = lambda a, b: pa.concat_arrays([pa.array(a) if not isinstance(a, pa.Array) else a, pa.array(b) if not isinstance(b, pa.Array) else b])
                columns = [pa.array(np.full(e + s, cell)), both(edges[:, 0], none), both(edges[:, 1], none), both(pa.nulls(e, pa.int64()), np.arange(s)), *[both(gap, spheres[:, j]) for j in range(len(dims) + 1)]]
                yield pa.RecordBatch.from_arrays(columns, names)

    doubles = ", ".join(f"{c} double" for c in names[4:])
    return state.select("cell", "own", "around").mapInArrow(run, f"cell bigint, src bigint, dst bigint, k bigint, {doubles}")


def delaunay_by_cells(nodes: DataFrame, dims: Sequence[str] = ("x", "y"), *, cell_points: int = CELL_POINTS, neighbours: int | None = None, most_rounds: int = 1000) -> DataFrame:
    """Edges (src, dst), src < dst, of any number of nodes."""
    dims = tuple(dims)
    points = cut(scaled(nodes, dims))
    n = points.count()
    k = min(NEIGHBOURS.get(len(dims), 40) if neighbours is None else neighbours, n - 1)
    placed = pyramid.plant(points, n, dims=dims, leaf=cell_points, need=k + 1)
    near = cut(pyramid.nearest(placed, placed, k, exclude_self=True))
    reach = near.groupBy(F.col("q_id").alias("id")).agg(F.max("d2").alias("filled"))
    own = cut(placed.rows.select("id", *dims, F.col("code").alias("cell")).join(reach, "id"))
    held = own.groupBy("cell").agg(F.collect_list(F.struct("id", *dims, "filled")).alias("own"))
    place = placed.rows.select("id", *dims)
    beside = near.select(F.col("q_id").alias("id"), "p_id").join(own.select("id", "cell"), "id").join(own.select(F.col("id").alias("p_id"), F.col("cell").alias("other")), "p_id")
    beside = beside.where("cell <> other").select("cell", F.col("p_id").alias("id")).distinct()
    around = beside.join(place, "id").groupBy("cell").agg(F.collect_list(F.struct("id", *dims)).alias("around"))
    empty = F.array().cast(f"array<struct<id: bigint, {', '.join(f'{d}: double' for d in dims)}>>")
    state = cut(held.join(around, "cell", "left").withColumn("around", F.coalesce("around", empty)))
    found = None
    for _ in range(most_rounds):
        drawn = cut(stars(state, dims))
        spheres = drawn.where("k is not null").select(F.struct("cell", "k").alias("item"), *[f"c_{d}" for d in dims], "r2")
        # its own corners may seem to lie inside a sphere by rounding
        hits = pyramid.inside_spheres(placed, spheres, len(dims) + 3).select("item.cell", "id", *dims).distinct()
        fresh = hits.groupBy("cell").agg(F.collect_list(F.struct("id", *dims)).alias("hits"))
        known = lambda h: F.exists(F.col("own"), lambda o: o["id"] == h["id"]) | F.exists(F.col("around"), lambda o: o["id"] == h["id"])
        more = state.join(fresh, "cell").withColumn("hits", F.filter("hits", lambda h: ~known(h))).where("size(hits) > 0")
        more = cut(more.select("cell", "own", F.concat("around", "hits").alias("around")))
        done = drawn.where("src is not null").join(more.select("cell"), "cell", "left_anti").select("src", "dst")
        found = done if found is None else found.unionByName(done)
        if more.isEmpty():
            return found.distinct()
        state = more
    raise RuntimeError("the triangulation did not close")

"""Distance joins over a grid, so that only near cells meet.

Points carry an id and one column for each dimension. Coordinates are matched by
equality on cells, which Spark plans as a hash or sort-merge join (with skew
handling where cells are crowded), and the distance is a residual test.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.functions.geometry import columns, squared_distance
from crestline.operators import dense, pyramid
from crestline.operators.state import limits

DIMS = ("x", "y")


def _cell(dims: Sequence[str], prefix: str, width) -> list[Column]:
    return [F.floor(F.col(prefix + d) / width).alias(f"_c_{d}") for d in dims]


def _near_cells(rows: DataFrame, dims: Sequence[str], prefix: str, width) -> DataFrame:
    """A row for the own cell and each one beside it."""
    for d in dims:
        base = F.floor(F.col(prefix + d) / width)
        rows = rows.withColumn(f"_c_{d}", F.explode(F.array(base - 1, base, base + 1)))
    return rows


def _named(rows: DataFrame, id_col: str, dims: Sequence[str], prefix: str, extra: Sequence[str] = ()) -> DataFrame:
    return rows.select(F.col(id_col).alias(f"{prefix}id"), *[F.col(d).alias(prefix + d) for d in dims], *[F.col(e).alias(prefix + e) for e in extra])


def range_join(left: DataFrame, right: DataFrame, radius: float | str, *, left_id: str = "id", right_id: str = "node", dims: Sequence[str] = DIMS, left_extra: Sequence[str] = (), right_extra: Sequence[str] = ()) -> DataFrame:
    """Pairs of l_id and r_id at distance `radius` or less, with coordinates, extra columns and d2.
    radius is a number or a column of right. Cells are as wide as the radius, and each row of right visits
    the cells around its own; rows of right with unlike radii have cells by powers of two of these, so that a
    wide one does not widen the cells of the others, and rows of left have a cell of each such width."""
    l_rows = _named(left, left_id, dims, "l_", left_extra)
    if isinstance(radius, str):
        r_rows = _named(right, right_id, dims, "r_", [*right_extra, *([] if radius in right_extra else [radius])])
        own = F.col(f"r_{radius}")
        limit = own * own
        # at most some hundred of them, whatever the number of rows
        r_rows = r_rows.where(own >= 0).withColumn("_w", F.when(own > 0, F.pow(F.lit(2.0), F.ceil(F.log2(own)))).otherwise(1.0))
        widths = sorted(r["_w"] for r in r_rows.select("_w").distinct().collect()) or [1.0]
    else:
        limit, widths = F.lit(radius * radius), [float(radius) if radius > 0 else 1.0]
        r_rows = _named(right, right_id, dims, "r_", right_extra).withColumn("_w", F.lit(widths[0]))
    cells = ["_w", *[f"_c_{d}" for d in dims]]
    l_rows = l_rows.withColumn("_w", F.explode(F.array(*map(F.lit, widths))) if len(widths) > 1 else F.lit(widths[0]))
    l_rows = l_rows.select("*", *_cell(dims, "l_", F.col("_w")))
    joined = l_rows.join(_near_cells(r_rows, dims, "r_", F.col("_w")), cells).drop(*cells)
    return joined.withColumn("d2", squared_distance(columns(dims, "l_"), columns(dims, "r_"))).where(F.col("d2") <= limit)


def _knn_small(queries: DataFrame, points: DataFrame, k: int, query_id: str, point_id: str, dims: Sequence[str], exclude_self: bool) -> DataFrame:
    """The same by comparing each query with all points, which go along with the task's function."""
    own = points.select(F.col(point_id).cast("long").alias("id"), *[F.col(d).cast("double") for d in dims]).collect()
    ids = np.array([r[0] for r in own], np.int64)
    x = np.array([r[1:] for r in own], float).reshape(-1, len(dims))

    def run(batches):
        for batch in batches:
            q_ids = batch.column(0).to_numpy()
            q = np.stack([c.to_numpy() for c in batch.columns[1:]], 1)
            for row, rank, found, d2 in dense.nearest(q, x, ids, k, q_ids if exclude_self else None):
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(rank.astype(np.int32)), pa.array(found), pa.array(d2)], ["q_id", "rank", "p_id", "d2"])

    rows = queries.select(F.col(query_id).cast("long").alias("q_id"), *[F.col(d).cast("double").alias(d) for d in dims])
    return rows.mapInArrow(run, "q_id bigint, rank int, p_id bigint, d2 double")


def knn_join(queries: DataFrame, points: DataFrame, k: int, *, query_id: str = "id", point_id: str = "id", dims: Sequence[str] = DIMS, exclude_self: bool = False, key: str | None = None, looked: list[int] | None = None) -> DataFrame:
    """The k nearest points of each query, ties to the smaller id: q_id, rank (from 1), p_id and d2. With key, a column of whole numbers from 0 on of both, only among points of the
    query's key (all, where they are fewer), which comes along.

    Up to limits().neighbours points go to every task and are compared with all its queries. Beyond, both lie in cells that follow their density, and
    those cells meet that may hold a neighbour; the number of compared pairs is added to looked.
    """
    if key:
        sizes = points.groupBy(key).count().agg(F.max("count").alias("n"), F.count("*").alias("keys")).first()
        if not sizes.keys or k < 1:
            return points.sparkSession.createDataFrame([], f"{key} int, q_id bigint, rank int, p_id bigint, d2 double")
        need = k + exclude_self
        held = {"dims": dims, "key": key, "keys": sizes["keys"]}
        placed = pyramid.plant(points, sizes.n, id_col=point_id, leaf=pyramid.leaf_size(need), need=need, **held)
        most = queries.groupBy(key).count().agg(F.max("count").alias("n")).first().n or 0
        asked = placed if queries is points and query_id == point_id else pyramid.plant(queries, most, id_col=query_id, **held)
        return pyramid.nearest(asked, placed, k, exclude_self=exclude_self, looked=looked).withColumnRenamed("rep", key)
    n = points.count()
    wanted = min(k, n - (1 if exclude_self else 0))
    if wanted < 1:
        return points.sparkSession.createDataFrame([], "q_id bigint, rank int, p_id bigint, d2 double")
    if n <= limits().neighbours:
        return _knn_small(queries, points, wanted, query_id, point_id, dims, exclude_self)
    need = wanted + exclude_self
    placed = pyramid.plant(points, n, id_col=point_id, dims=dims, leaf=pyramid.leaf_size(need), need=need)
    asked = placed if queries is points and query_id == point_id else pyramid.plant(queries, queries.count(), id_col=query_id, dims=dims)
    return pyramid.nearest(asked, placed, wanted, exclude_self=exclude_self, looked=looked).drop("rep")

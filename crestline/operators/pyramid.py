"""Points in cells that follow their density, and searches that descend through them.

Space is halved again and again, each cell at the median of its longest side. The upper halvings come from a bounded sample,
the lower ones are made where the points of an upper cell meet, so a lowest cell holds a few points whatever their
density. A cell is named by its way down, a bit for each halving, and cells of all levels are one table of boxes.

A search goes down level by level for items (few points that lie together, with their box) in joins by the cell above. A
pair of item and cell stays while the boxes are no further apart than the item's bound, and bounds shrink as cells do: for
neighbours, the least distance within which cells hold enough points for sure; for ways out of a component, the least distance within which
some cell holds a foreign point for sure. So what remains are the cells that must be looked at, and lists from them are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crestline.operators.state import cut

DIMS = ("x", "y")
#: Points of an upper cell (aimed at), upper halvings, and sampled points for each upper cell.
UPPER_POINTS, MOST_UPPER, SAMPLED = 20_000, 13, 64
#: Halvings between two levels of a search.
STEP = 3
#: Points further from the middle of their cell than so many times the median are items of their own.
APART = 4.0
#: Cells or components whose table (under 10 MB) may be broadcast.
MOST_BROADCAST = 100_000
#: Lowest cells whose items one task takes down.
TASK_CELLS = 256
#: Rows of pairs that are compared at once.
ROWS = 1000


@dataclass(frozen=True)
class Pyramid:
    """rows: (rep, id, dims, code, apart, spare, near) of all points, each key rep in cells of its own; spare: as many coincident points of lesser id are there already as a search needs; near: squared distance
    within which the own lowest cell has enough points. bits: halvings, the last `lower` of them below the upper cells, whose sides and values `upper` holds, if there are any. keys: number of keys."""

    rows: DataFrame
    bits: int
    dims: tuple[str, ...]
    keys: int = 1
    lower: int = 0
    upper: tuple[np.ndarray, np.ndarray] | None = None

    @property
    def levels(self) -> list[int]:
        """Halvings down to each level below the root."""
        return [*range(self.bits % STEP or min(STEP, self.bits), self.bits, STEP), self.bits] if self.bits else [0]


def leaf_size(need: int) -> int:
    """Points of a lowest cell for searches that must find so many."""
    return max(16, min(64, 2 * need))


def upper_halvings(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Side and value of each halving, as a heap; the last side is a hash, for points that coincide."""
    side, value = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf)
    parts = {0: np.arange(len(sample))}
    for node in range(len(side)):
        own = parts.pop(node)
        right = np.zeros(len(own), bool)
        if len(own) > 1:
            x = sample[own]
            extent = x.max(0) - x.min(0)
            side[node] = int(extent[:-1].argmax()) if extent[:-1].any() else len(extent) - 1
            line = x[:, side[node]]
            middle = np.partition(line, len(line) // 2)[len(line) // 2]
            above = line[line > line.min()]
            value[node] = middle if middle > line.min() else above.min() if len(above) else np.inf
            right = line >= value[node]
        parts[2 * node + 1], parts[2 * node + 2] = own[~right], own[right]
    return side, value


def rim(x: np.ndarray, cell: int, side: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A distance that all points outside an upper cell keep at least from each of its points x."""
    node, out = cell + len(side), np.full(len(x), np.inf)
    while node:
        above = (node - 1) // 2
        if np.isfinite(value[above]):
            # halves by hash may hold coincident points
            out = np.minimum(out, np.abs(x[:, side[above]] - value[above]) if side[above] < x.shape[1] else 0.0)
        node = above
    return out


def lower_halvings(ids: np.ndarray, x: np.ndarray, depth: int) -> np.ndarray:
    """Way down of each point by halving the number of points, ties by id."""
    code = np.zeros(len(ids), np.int64)
    for _ in range(depth):
        order = np.argsort(code, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], np.diff(code[order]) > 0)))
        sizes = np.diff(np.append(starts, len(order)))
        extent = np.maximum.reduceat(x[order], starts) - np.minimum.reduceat(x[order], starts)
        side = np.empty(len(ids), np.int64)
        side[order] = np.repeat(extent.argmax(1), sizes)
        order = np.lexsort((ids, x[np.arange(len(ids)), side], code))
        place = np.arange(len(order)) - np.repeat(starts, sizes)
        right = np.empty(len(ids), bool)
        right[order] = place >= np.repeat((sizes + 1) // 2, sizes)
        code = 2 * code + right
    return code


def coincident_rank(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Place of each point among those of its position, by id."""
    order = np.lexsort((ids, *x.T))
    new = np.concatenate(([True], (x[order][1:] != x[order][:-1]).any(1)))
    starts = np.flatnonzero(new)
    out = np.empty(len(ids), np.int64)
    out[order] = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
    return out


def described(ids: np.ndarray, x: np.ndarray, code: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """apart and near of points, by their lowest cells."""
    apart, near = np.zeros(len(ids), bool), np.full(len(ids), np.inf)
    order = np.argsort(code, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
        if not len(own):
            continue
        p = x[own]
        far = ((p - np.median(p, 0)) ** 2).sum(1)
        apart[own] = far > APART * APART * np.median(far)
        if need and len(own) >= need:
            d2 = ((p[:, None] - p[None]) ** 2).sum(2)
            near[own] = np.partition(d2, need - 1, 1)[:, need - 1]
    return apart, near


def plant(points: DataFrame, n: int, *, id_col: str = "id", dims: Sequence[str] = DIMS, leaf: int = 16, need: int = 0, key: str | None = None, keys: int = 1) -> Pyramid:
    """The pyramid of n points, or of at most n for each value of key, of which there are about keys, whole numbers from 0 on (points with a null or non-finite coordinate take no part); lowest cells hold at most about leaf of them. need: points, with the own one, that a search must find."""
    finite = " and ".join(f"{d} is not null and not isnan({d}) and abs({d}) < double('infinity')" for d in dims)
    rep = (F.col(key) if key else F.lit(0)).cast("int").alias("rep")
    rows = points.where(finite).select(rep, F.col(id_col).cast("long").alias("id"), *[F.col(d).cast("double").alias(d) for d in dims])
    depth = min(MOST_UPPER, max(0, math.ceil(math.log2(max(n, 1) / UPPER_POINTS))))
    rows = rows.withColumn("hash", F.shiftrightunsigned(F.xxhash64("id"), 11) / float(1 << 53))
    names = [*dims, "hash"]
    upper = "rep int, id bigint, " + ", ".join(f"{d} double" for d in dims) + ", upper int"
    if depth:
        most = max(1, n * keys // (SAMPLED << depth))
        taken = rows.where(F.pmod(F.xxhash64("rep", "id", F.lit(17)), F.lit(most)) == 0).select(*names).toArrow()
        side, value = upper_halvings(np.stack([c.to_numpy() for c in taken.columns], 1), depth)

        def place(batches):
            for batch in batches:
                x = np.stack([c.to_numpy() for c in batch.columns[2:]], 1)
                node, every = np.zeros(len(x), np.int64), np.arange(len(x))
                for _ in range(depth):
                    node = 2 * node + 1 + (x[every, side[node]] >= value[node])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array((node - (1 << depth) + 1).astype(np.int32))], ["rep", "id", *dims, "upper"])

        placed = rows.select("rep", "id", *names).mapInArrow(place, upper)
    else:
        placed = rows.select("rep", "id", *dims, F.lit(0).alias("upper"))
    # sampled halves are uneven, so upper cells may hold about twice what is aimed at
    lower = max(0, math.ceil(math.log2(max(n, 1) * (2 if depth else 1) / (1 << depth) / leaf)))

    def settle(table: pa.Table) -> pa.Table:
        ids, *x = (table.column(c).to_numpy() for c in ("id", *dims))
        x = np.stack(x, 1)
        code = lower_halvings(ids, x, lower)
        apart, near = described(ids, x, code, need)
        own = table.column("rep")
        code += (own[0].as_py() << (depth + lower)) + (table.column("upper")[0].as_py() << lower)
        spare = coincident_rank(ids, x) >= need if need else np.zeros(len(ids), bool)
        return pa.table({"rep": own, "id": ids, **{d: x[:, j] for j, d in enumerate(dims)}, "code": code, "apart": apart, "spare": spare, "near": near})

    found = placed.groupBy("rep", "upper").applyInArrow(settle, "rep int, id bigint, " + ", ".join(f"{d} double" for d in dims) + ", code bigint, apart boolean, spare boolean, near double")
    return Pyramid(cut(found), depth + lower, tuple(dims), keys, lower, (side, value) if depth else None)


def box(dims: Sequence[str]) -> list[Column]:
    return [f(d).alias(f"{p}_{d}") for d in dims for p, f in (("lo", F.min), ("hi", F.max))]


def cells_of(pyramid: Pyramid, rows: DataFrame, sums: Sequence[Column], again: Sequence[Column]) -> DataFrame:
    """(level, cell, boxes, sums) of the cells of all levels that hold rows (a part of the pyramid's rows, perhaps with further columns); again: the sums from those of the level below."""
    dims = pyramid.dims
    level = cut(rows.groupBy(F.col("code").alias("cell")).agg(*box(dims), *sums))
    boxes = [f(f"{p}_{d}").alias(f"{p}_{d}") for d in dims for p, f in (("lo", F.min), ("hi", F.max))]
    out, depths = None, pyramid.levels
    for k in reversed(range(len(depths))):
        named = level.withColumn("level", F.lit(k))
        out = named if out is None else out.unionByName(named)
        if k:
            level = level.groupBy(F.expr(f"shiftright(cell, {depths[k] - depths[k - 1]})").alias("cell")).agg(*boxes, *again)
    return cut(out)


def gaps(dims: Sequence[str]) -> tuple[Column, Column]:
    """Squared least and largest distance between the boxes lo_d..hi_d and a_lo_d..a_hi_d."""
    zero = F.lit(0.0)
    least = [F.greatest(zero, F.col(f"lo_{d}") - F.col(f"a_hi_{d}"), F.col(f"a_lo_{d}") - F.col(f"hi_{d}")) for d in dims]
    most = [F.greatest(F.col(f"hi_{d}") - F.col(f"a_lo_{d}"), F.col(f"a_hi_{d}") - F.col(f"lo_{d}")) for d in dims]
    # a little less and more, so that rounding drops nothing
    return sum(x * x for x in least) * (1 - 1e-12), sum(x * x for x in most) * (1 + 1e-12)


def broadcast_small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MOST_BROADCAST else df


def below(pyramid: Pyramid, cells: DataFrame, pairs: DataFrame | None, items: DataFrame, k: int) -> DataFrame:
    """Pairs of items and the cells of level k under those that were left at the level above, with least and most."""
    depths = pyramid.levels
    here = cells.where(F.col("level") == k).drop("level")
    here = here.withColumn("above", F.expr(f"shiftright(cell, {depths[k] - (depths[k - 1] if k else 0)})"))
    # a level has at most 2 to its depth cells for each key; at the first all are under the root, which is named by the key
    here = broadcast_small(here, pyramid.keys << depths[k])
    now = items.withColumn("above", F.col("rep").cast("bigint")) if pairs is None else pairs
    least, most = gaps(pyramid.dims)
    return now.join(here, "above").withColumn("least", least).withColumn("most", most)


def dealt(pyramid: Pyramid, first: DataFrame) -> DataFrame:
    """Items dealt over tasks by the number of cells, as few bytes of items become many pairs in the same task."""
    least = first.sparkSession.sparkContext.defaultParallelism
    return first.repartition(max(least, (pyramid.keys << pyramid.bits) // TASK_CELLS), "item")


def boxed(dims: Sequence[str]) -> list[Column]:
    return [F.col(f"{p}_{d}").alias(f"a_{p}_{d}") for d in dims for p in ("lo", "hi")]


def item_key() -> Column:
    """Points that lie apart are items of their own."""
    return F.struct(F.col("rep"), F.col("apart"), F.when(F.col("apart"), F.col("id")).otherwise(F.col("code")).alias("key"))


def held(dims: Sequence[str], *more: str) -> Column:
    return F.collect_list(F.struct("id", *dims, *more))


def meet(pairs: DataFrame, items: DataFrame, leaves: DataFrame, on: Sequence[str]) -> DataFrame:
    """own (points of the item) and other (points of the cell) for each pair."""
    return pairs.join(items, list(on)).join(leaves, "cell")


def crossed(own: pa.ListArray, other: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of entries of lists in the same row: rows, and places in the flat values of both."""
    a, b = own.offsets.to_numpy(), other.offsets.to_numpy()
    m, n = np.diff(a), np.diff(b)
    size = m * n
    row = np.repeat(np.arange(len(m)), size)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return row, at // n[row] + a[row] - a[0], at % n[row] + b[row] - b[0]


def flat(lists: pa.ListArray, dims: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Ids, coordinates and further fields of the structs in lists."""
    fields = lists.flatten().flatten()
    return fields[0].to_numpy(), np.stack([f.to_numpy() for f in fields[1 : 1 + dims]], 1), [f.to_numpy() for f in fields[1 + dims :]]


def squared(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    total = np.zeros(len(p))
    for j in range(p.shape[1]):
        total += (p[:, j] - q[:, j]) ** 2
    return total


def looked_at(pairs: DataFrame, items: DataFrame, cells: DataFrame, on: Sequence[str], levels: int) -> int:
    """Pairs of points that the pairs of items and lowest cells stand for."""
    low = cells.where(F.col("level") == levels - 1).select("cell", "n")
    return pairs.join(items.select(*on, F.size("own").alias("m")), list(on)).join(low, "cell").agg(F.sum(F.col("m") * F.col("n")).alias("s")).first().s or 0


def nearest(queries: Pyramid, points: Pyramid, k: int, *, exclude_self: bool, looked: list[int] | None = None) -> DataFrame:
    """(rep, q_id, rank, p_id, d2): the k nearest points of the same key (all, where there are fewer) of each query, ties to the smaller id; the numbers of compared pairs are added to looked."""
    dims, need = points.dims, k + exclude_self
    cells = cells_of(points, points.rows.where("not spare"), [F.count("*").alias("n")], [F.sum("n").alias("n")])
    items = cut(queries.rows.groupBy(item_key().alias("item")).agg(*box(dims), F.max("near").alias("bound"), held(dims).alias("own")))
    first = dealt(points, items.select("item", "item.rep", "bound", *boxed(dims)))
    pairs = None
    order = Window.partitionBy("item").orderBy("most").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("item")
    levels = len(points.levels)
    for level in range(levels):
        pairs = below(points, cells, pairs, first, level)
        pairs = pairs.withColumn("upto", F.sum("n").over(order)).withColumn("sure", F.min(F.when(F.col("upto") >= need, F.col("most"))).over(whole))
        pairs = pairs.withColumn("bound", F.least("bound", F.coalesce("sure", F.lit(float("inf"))))).where("least <= bound")
        pairs = pairs.select("item", "bound", *[f"a_{p}_{d}" for d in dims for p in ("lo", "hi")], F.col("cell").alias("above"))
    pairs = cut(pairs.select("item", "bound", F.col("above").alias("cell")))
    if looked is not None:
        looked.append(looked_at(pairs, items, cells, ["item"], levels))
    leaves = points.rows.where("not spare").groupBy(F.col("code").alias("cell")).agg(held(dims).alias("other"))

    def compare(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                own, other = part.column(1), part.column(2)
                row, i, j = crossed(own, other)
                q, x, _ = flat(own, len(dims))
                p, y, _ = flat(other, len(dims))
                d2 = squared(x[i], y[j])
                kept = d2 <= part.column(0).to_numpy()[row]
                if exclude_self:
                    kept &= q[i] != p[j]
                yield pa.RecordBatch.from_arrays([pa.array(part.column(3).to_numpy()[row[kept]]), pa.array(q[i[kept]]), pa.array(p[j[kept]]), pa.array(d2[kept])], ["rep", "q_id", "p_id", "d2"])

    met = meet(pairs, items.select("item", "own"), leaves, ["item"]).select("bound", "own", "other", "item.rep")
    found = met.mapInArrow(compare, "rep int, q_id bigint, p_id bigint, d2 double")
    rank = F.row_number().over(Window.partitionBy("rep", "q_id").orderBy("d2", "p_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("rep", "q_id", F.col("rank").cast("int").alias("rank"), "p_id", "d2")


def ways_out(pyramid: Pyramid, label: DataFrame, seekers: DataFrame, *, looked: list[int] | None = None) -> DataFrame:
    """(comp, d2, src, dst): the shortest edge from the given nodes of each component to a node of another, ties by (src, dst); src < dst.

    label: (id, comp) of all nodes. seekers: (id, bound), bound a squared length that the component's way out has at most."""
    dims = pyramid.dims
    named = cut(pyramid.rows.where("not spare").select("rep", "id", *dims, "code", "apart").join(label, "id"))
    cells = cells_of(pyramid, named, [F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high")], [F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")])
    items = named.join(seekers, "id").groupBy("comp", item_key().alias("item")).agg(*box(dims), F.min("bound").alias("bound"), held(dims).alias("own"))
    items = cut(items)
    first = items.select("comp", "item", "item.rep", "bound", *boxed(dims))
    comps = items.select("comp").distinct().count()
    pairs = None
    levels = len(pyramid.levels)
    for level in range(levels):
        pairs = cut(below(pyramid, cells, pairs, first, level).where("low <> comp or high <> comp").where("least <= bound"))
        # any cell that is left holds a foreign node
        sure = broadcast_small(pairs.groupBy("comp").agg(F.min("most").alias("sure")), comps)
        pairs = pairs.join(sure, "comp").withColumn("bound", F.least("bound", "sure")).where("least <= bound")
        pairs = pairs.select("comp", "item", "bound", *[f"a_{p}_{d}" for d in dims for p in ("lo", "hi")], F.col("cell").alias("above"))
    pairs = cut(pairs.select("comp", "item", "bound", F.col("above").alias("cell")))
    if looked is not None:
        looked.append(looked_at(pairs, items, cells, ["comp", "item"], levels))
    leaves = named.groupBy(F.col("code").alias("cell")).agg(held(dims, "comp").alias("other"))

    def compare(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                comp, own, other = part.column(0).to_numpy(), part.column(2), part.column(3)
                row, i, j = crossed(own, other)
                q, x, _ = flat(own, len(dims))
                p, y, (foreign,) = flat(other, len(dims))
                d2 = squared(x[i], y[j])
                kept = (foreign[j] != comp[row]) & (d2 <= part.column(1).to_numpy()[row])
                c, d2, src, dst = comp[row[kept]], d2[kept], np.minimum(q[i], p[j])[kept], np.maximum(q[i], p[j])[kept]
                order = np.lexsort((dst, src, d2, c))
                best = order[np.concatenate(([True], np.diff(c[order]) != 0))] if len(order) else order
                yield pa.RecordBatch.from_arrays([pa.array(v[best]) for v in (c, d2, src, dst)], ["comp", "d2", "src", "dst"])

    met = meet(pairs, items.select("comp", "item", "own"), leaves, ["comp", "item"]).select("comp", "bound", "own", "other")
    found = met.mapInArrow(compare, "comp bigint, d2 double, src bigint, dst bigint")
    return found.groupBy("comp").agg(F.min(F.struct("d2", "src", "dst")).alias("e")).select("comp", "e.*")


def inside_spheres(pyramid: Pyramid, spheres: DataFrame, most: int, *, looked: list[int] | None = None) -> DataFrame:
    """(item, id, dims): up to `most` points strictly inside each of spheres(item, c_d, r2), those nearest to its centre; the number of points that were compared is added to looked."""
    dims = pyramid.dims
    cells = cells_of(pyramid, pyramid.rows, [F.count("*").alias("n")], [F.sum("n").alias("n")])
    centre = [F.col(f"c_{d}").alias(f"a_{p}_{d}") for d in dims for p in ("lo", "hi")]
    first = spheres.select("item", F.lit(0).alias("rep"), F.col("r2").alias("bound"), *centre)
    first = dealt(pyramid, first.withColumn("upto", F.lit(float("inf"))))
    order = Window.partitionBy("item").orderBy("most").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("item")
    pairs = None
    for level in range(len(pyramid.levels)):
        pairs = below(pyramid, cells, pairs, first, level).where("least < bound and least <= upto")
        # a wide sphere may hold most of the points; those that are wanted lie within the least distance where cells hold enough of them
        pairs = pairs.withColumn("sum", F.sum("n").over(order)).withColumn("sure", F.min(F.when(F.col("sum") >= most, F.col("most"))).over(whole))
        pairs = pairs.withColumn("upto", F.least("upto", F.coalesce("sure", F.lit(float("inf"))))).where("least <= upto")
        pairs = pairs.select("item", "bound", "upto", *[f"a_{p}_{d}" for d in dims for p in ("lo", "hi")], F.col("cell").alias("above"))
    leaves = pyramid.rows.groupBy(F.col("code").alias("cell")).agg(held(dims).alias("other"))
    met = pairs.withColumnRenamed("above", "cell").join(leaves, "cell").select("item", "bound", *[F.col(f"a_lo_{d}").alias(f"c_{d}") for d in dims], "other")
    spread = met.select("item", "bound", *[f"c_{d}" for d in dims], F.explode("other").alias("o")).select("item", "bound", *[f"c_{d}" for d in dims], "o.*")
    far2 = sum((F.col(d) - F.col(f"c_{d}")) * (F.col(d) - F.col(f"c_{d}")) for d in dims)
    if looked is not None:
        looked.append(spread.count())
    near = spread.withColumn("far2", far2).where("far2 < bound")
    rank = F.row_number().over(Window.partitionBy("item").orderBy("far2", "id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= most).select("item", "id", *dims)

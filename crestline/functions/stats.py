"""Summaries of point sets."""

from __future__ import annotations

from collections.abc import Sequence


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F




def bounding_box(points: DataFrame, dims: Sequence[str] = ("x", "y")) -> DataFrame:
    """One row: min_d and max_d of each dimension and shortest, the shortest range."""
    found = points.agg(*[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("min", F.min), ("max", F.max))])
    ranges = [F.col(f"max_{d}") - F.col(f"min_{d}") for d in dims]
    return found.withColumn("shortest", F.least(*ranges) if len(ranges) > 1 else ranges[0])


def bandwidth(points: DataFrame, a0: float = 0.1, dims: Sequence[str] = ("x", "y")) -> DataFrame:
    """One row: h = a0 (1 / (D + 2)) ** (1 / (D + 4)) N ** (-1 / (D + 4)) times the least non-zero standard deviation, and sig = h * h."""
    d = len(dims)
    spread = points.agg(F.count("*").alias("n"), *[F.stddev_pop(x).alias(x) for x in dims])
    given = [F.when(F.col(x) > 0, F.col(x)) for x in dims]
    least = F.least(*given) if d > 1 else given[0]
    h = F.lit(a0 * (1 / (d + 2)) ** (1 / (d + 4))) * F.pow(F.col("n"), F.lit(-1 / (d + 4))) * least
    return spread.select(h.alias("h"), (h * h).alias("sig"))


def summary(values: DataFrame, column: str) -> DataFrame:
    """One row: mean, max and min of a column, and its number of values."""
    return values.agg(F.avg(column).alias("mean"), F.max(column).alias("max"), F.min(column).alias("min"), F.count(column).alias("n"))


def running_sum(rows: DataFrame, order: Sequence[str], value: str, into: str, parts: int = 64) -> DataFrame:
    """rows with the running sum of value in the given order: ranges are summed apart, and only the sums
    of the ranges go through one task."""
    placed = rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    sums = placed.groupBy("_part").agg(F.sum(value).alias("_s"))
    before = sums.select("_part", F.coalesce(F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(into, F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")


def weighted_median(rows: DataFrame, value: str, weight: str, order: Sequence[str]) -> DataFrame:
    """One row, median: rows are taken in the given order (ascending values, as a rule). A weight above half of
    the sum wins outright; where the running weight meets half exactly, two values are averaged."""
    half = rows.agg((F.sum(weight) / 2).alias("half"), F.max(F.struct(F.col(weight), F.col(value))).alias("top")).first()
    if half is None or half["half"] is None:
        return rows.sparkSession.createDataFrame([], "median double")
    if half["top"][0] > half["half"]:
        wins = rows.where(F.col(weight) == half["top"][0]).orderBy(*order).limit(1)
        return wins.select(F.col(value).cast("double").alias("median"))
    cumulated = running_sum(rows, order, weight, "_c")
    at, before = F.col("_c"), F.col("_c") - F.col(weight)
    # the value that passes half, and the one that meets it exactly
    passing = cumulated.where((at > half["half"]) & (before <= half["half"])).orderBy("_c").limit(1).select(F.col(value).alias("v"), (before == half["half"]).alias("met"))
    meeting = cumulated.where(at == half["half"]).agg(F.max(value).alias("m"))
    return passing.crossJoin(F.broadcast(meeting)).select(F.when(F.col("met"), (F.col("v") + F.col("m")) / 2).otherwise(F.col("v")).cast("double").alias("median"))


def density_map(points: DataFrame, nx: int, ny: int, weight: str | None = None, x: str = "x", y: str = "y") -> DataFrame:
    """(ix, iy, density) of the cells with points: each point goes to the nearest grid point of the box widened by one on
    every side, half to even; density is weight per area."""
    box = points.agg(*[f(c).alias(n) for n, f, c in (("x0", F.min, x), ("x1", F.max, x), ("y0", F.min, y), ("y1", F.max, y))]).first()
    if box.x0 is None:
        return points.sparkSession.createDataFrame([], "ix long, iy long, density double")
    x0, y0 = box.x0 - 1, box.y0 - 1
    dx, dy = (box.x1 + 1 - x0) / nx, (box.y1 + 1 - y0) / ny

    def cell(c, low, step, n):
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.rint((F.col(c) - low) / step))).cast("long")

    amount = F.col(weight) if weight else F.lit(1.0)
    return points.groupBy(cell(x, x0, dx, nx).alias("ix"), cell(y, y0, dy, ny).alias("iy")).agg((F.sum(amount) / dx / dy).alias("density"))


def _gradient(grid: DataFrame, axis: str, others: Sequence[str], value: str, into: str) -> DataFrame:
    """Central differences along an axis of a full grid, one-sided at its ends."""
    w = Window.partitionBy(*others).orderBy(axis)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    own = F.col(value)
    slope = F.when(before.isNull(), after - own).when(after.isNull(), own - before).otherwise((after - before) / 2)
    return grid.withColumn(into, slope)


def hessian(grid: DataFrame, axes: Sequence[str] = ("ix", "iy"), value: str = "v") -> DataFrame:
    """grid with g_i, the first differences along each axis, and h_ij, those of g_i along axis j."""
    out = grid
    for i in axes:
        out = _gradient(out, i, [a for a in axes if a != i], value, f"g_{i}")
    for i in axes:
        for j in axes:
            out = _gradient(out, j, [a for a in axes if a != j], f"g_{i}", f"h_{i}_{j}")
    return out


def covariance(rows: DataFrame, by: Sequence[str], dims: Sequence[str]) -> DataFrame:
    """Sample covariance of each pair of dimensions by group, as c_de."""
    pairs = [(a, b) for i, a in enumerate(dims) for b in dims[i:]]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[(F.var_samp(a) if a == b else F.covar_samp(a, b)).alias(f"c_{a}{b}") for a, b in pairs])



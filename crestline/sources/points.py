"""Point sets from tables and NumPy files."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIMS = ("x", "y", "z")


def points_from_array(rows: DataFrame, id_col: str, array_col: str, dims: int = 2) -> DataFrame:
    """points(id, x, y[, z]) from the first elements of an array column."""
    v = F.col(array_col)
    return rows.select(F.col(id_col).cast("long").alias("id"), *[v[i].cast("double").alias(DIMS[i]) for i in range(dims)])


def points_from_columns(rows: DataFrame, id_col: str, *cols: str) -> DataFrame:
    """points from columns."""
    return rows.select(F.col(id_col).cast("long").alias("id"), *[F.col(c).cast("double").alias(DIMS[i]) for i, c in enumerate(cols)])


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """points from .npy files of shape (N, D), read by Spark's binary reader; a file is one task, and id is the row's place over the
    files in the order of their names (rows of a file are few enough for a task)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.load(io.BytesIO(content), allow_pickle=False).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(x)), pa.array(np.arange(len(x))), pa.array(list(x), pa.list_(pa.float64()))], ["path", "i", "v"])

    found = files.mapInArrow(rows, "path string, i bigint, v array<double>")
    sizes = sorted((r.path, r.n) for r in found.groupBy("path").agg(F.count("*").alias("n")).collect())
    starts, total = {}, 0
    for p, n in sizes:
        starts[p] = total
        total += n
    width = found.agg(F.max(F.size("v"))).first()[0] or 2
    start = F.create_map(*[F.lit(v) for kv in starts.items() for v in kv])[F.col("path")] if starts else F.lit(0)
    return found.select((start + F.col("i")).alias("id"), *[F.col("v")[d].alias(DIMS[d]) for d in range(width)])

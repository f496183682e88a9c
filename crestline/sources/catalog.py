"""A fitted graph with its points and filaments, as a folder of Parquet tables."""

from __future__ import annotations

import json
from dataclasses import asdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from crestline.operators.fit import FitParameters, GraphModel


def write_catalog(path: str, points: DataFrame, model: GraphModel, filaments: DataFrame, par: FitParameters, mode: str = "errorifexists") -> None:
    """points, nodes, edges, filaments, and one row of JSON with all parameters."""
    spark = points.sparkSession
    points.write.mode(mode).parquet(f"{path}/points")
    model.nodes(spark).coalesce(1).write.mode(mode).parquet(f"{path}/nodes")
    model.edge_table(spark).coalesce(1).write.mode(mode).parquet(f"{path}/edges")
    filaments.write.mode(mode).parquet(f"{path}/filaments")
    extra = {"alpha": model.alpha, "area": model.area, "background": model.background, "dims": list(model.dims), "movements": list(model.movements)}
    spark.createDataFrame([(json.dumps(asdict(par)), json.dumps(extra))], "parameters string, model string").coalesce(1).write.mode(mode).parquet(f"{path}/params")


def read_catalog(spark: SparkSession, path: str) -> tuple[DataFrame, GraphModel, DataFrame, FitParameters]:
    """(points, model, filaments, parameters); the topology comes back by its name."""
    row = spark.read.parquet(f"{path}/params").first()
    extra = json.loads(row["model"])
    dims = tuple(extra["dims"])
    nodes = spark.read.parquet(f"{path}/nodes").orderBy("node").collect()
    ids = np.array([r["node"] for r in nodes], np.int64)
    place = {int(i): k for k, i in enumerate(ids)}
    pairs = spark.read.parquet(f"{path}/edges").orderBy("edge_id").collect()
    model = GraphModel(
        ids,
        np.array([[r[d] for d in dims] for r in nodes], float),
        np.array([r["sig"] for r in nodes], float),
        np.array([r["pi"] for r in nodes], float),
        np.array([(place[r["src"]], place[r["dst"]]) for r in pairs], np.int64).reshape(-1, 2),
        extra["alpha"],
        extra["area"],
        extra["background"],
        dims,
        tuple(extra["movements"]),
    )
    return spark.read.parquet(f"{path}/points"), model, spark.read.parquet(f"{path}/filaments"), FitParameters(**json.loads(row["parameters"]))

"""Edges as text: one pair a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_edges(edges: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """src, a tab, dst."""
    edges.select("src", "dst").write.mode(mode).option("sep", "\t").csv(path)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of integers apart by any white space; lines without two are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(parts.alias("p")).where(F.size("p") >= 2)
    return rows.select(F.col("p")[0].cast("long").alias("src"), F.col("p")[1].cast("long").alias("dst"))

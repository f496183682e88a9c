"""Cutting lineage in storage that all executors share, and names for columns beside those of an input."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder of the cluster and go on from there."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        # on one machine its own folder will do
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="crestline-"))
    return df.checkpoint(eager=True)


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as make it no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name

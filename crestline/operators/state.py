"""What may be held in one place, storage that all executors share, and cutting the lineage of iterative operators there."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Limits:
    """Sizes up to which a loop runs over data held in one place (the driver, or each task); larger data goes through rounds
    of joins with the same result. Each is a few MB."""

    #: Distinct edges of a graph.
    edges: int = 200_000
    #: Points over which the driver makes the rounds of a fit.
    points: int = 200_000
    #: Points that go along with a task's function for nearest neighbours.
    neighbours: int = 20_000
    #: Nodes of a proximity graph or a replica in one task.
    nodes: int = 20_000
    #: Nodes of a spanning tree in one task, whose time is about in proportion to them.
    trees: int = 200_000


_limits: ContextVar[Limits] = ContextVar("limits", default=Limits())


def limits() -> Limits:
    return _limits.get()


@contextmanager
def limited(**sizes: int) -> Iterator[None]:
    """Use other limits while operators are called, trees that of nodes where it is not given; `limited(edges=-1, points=-1, neighbours=-1, nodes=-1)` takes the distributed way everywhere."""
    if "nodes" in sizes:
        sizes.setdefault("trees", sizes["nodes"])
    token = _limits.set(replace(limits(), **sizes))
    try:
        yield
    finally:
        _limits.reset(token)


def shared_path(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where none is named, on one machine a temporary one, and on a cluster an error."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="crestline-"))
    return context._jsc.sc().getCheckpointDir().get()


#: A loop's tables hold numbers that pack to a tenth, and Spark takes the size of their files for theirs. By its own threshold it would send tables of some 100 MB through the
#: driver in each round; larger ones than these few bytes are shuffled.
THRESHOLD, MOST_BROADCAST_BYTES = "spark.sql.autoBroadcastJoinThreshold", 256_000
#: For the same reason a task should not read as many bytes of them as Spark puts together by itself.
ADVISED, MOST_TASK_BYTES = "spark.sql.adaptive.advisoryPartitionSizeInBytes", 8_000_000


@contextmanager
def few_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Let Spark broadcast tables of MOST_BROADCAST_BYTES at most by itself, and put together MOST_TASK_BYTES for a task, for what is planned meanwhile."""
    held = {name: spark.conf.get(name) for name in (THRESHOLD, ADVISED)}
    spark.conf.set(THRESHOLD, str(MOST_BROADCAST_BYTES))
    spark.conf.set(ADVISED, str(MOST_TASK_BYTES))
    try:
        yield
    finally:
        for name, value in held.items():
            spark.conf.set(name, value)


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and go on from there, with a plan that knows nothing of the former one
    and with the true size at hand. Tables are removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_path(spark)}/cut-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove)
    _written.append((spark, path))
    with few_broadcasts(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_written: list[tuple[SparkSession, str]] = []


def _remove() -> None:
    for spark, path in _written:
        jvm, context = spark.sparkContext._jvm, spark.sparkContext._jsc
        if jvm is None or context is None or context.sc().isStopped():
            return
        there = jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(context.hadoopConfiguration()).delete(there, True)

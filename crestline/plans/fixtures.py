"""Point sets, seed nodes and graphs that the registered queries work on, as tables and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.operators.topology import knn_graph
from crestline.sources.points import points_from_array, points_from_columns

#: Variance of the seed nodes, the cutoff and the background of the mixture queries.
SIG, KSIG, ALPHA, AREA = 0.002, 5.0, 0.1, 1.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p2(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings by their first two dimensions."""
    return points_from_array(table(spark, d, "embeddings"), "vec_id", "embedding", 2)


def p3(spark: SparkSession, d: str) -> DataFrame:
    return points_from_array(table(spark, d, "embeddings"), "vec_id", "embedding", 3)


def parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts by size and price, with coincident points."""
    return points_from_columns(table(spark, d, "part"), "p_partkey", "p_size", "p_retailprice")


def events(spark: SparkSession, d: str) -> DataFrame:
    """Events by value and second of the day over 3600."""
    hours = (F.unix_timestamp("ts") % 86_400) / 3600
    return points_from_columns(table(spark, d, "events").withColumn("_h", hours), "event_id", "value", "_h")


def as_nodes(points: DataFrame) -> DataFrame:
    return points.withColumnRenamed("id", "node")


def seeds(spark: SparkSession, d: str, dims: int = 2) -> DataFrame:
    """Seed nodes: the mean of each label and quadrant of the first two dimensions."""
    rows = points_from_array(table(spark, d, "embeddings"), "vec_id", "embedding", dims).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id")
    place = F.col("label") * 4 + (F.col("x") > 0).cast("int") * 2 + (F.col("y") > 0).cast("int")
    names = ["x", "y", "z"][:dims]
    means = rows.groupBy(place.cast("long").alias("node")).agg(*[F.round(F.avg(c), 9).alias(c) for c in names])
    count = means.agg(F.count("*").alias("_k"))
    return means.join(F.broadcast(count)).select("node", *names, F.lit(SIG).alias("sig"), (1.0 / F.col("_k")).alias("pi"))


def neighbour_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of each point of P2 to its three nearest others."""
    return knn_graph(as_nodes(p2(spark, d)), 4)


#: The same in DuckDB SQL, as common table expressions.
CTE = {
    "p2": "p2 AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)",
    "p3": "p3 AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)",
    "parts": "parts AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, CAST(p_retailprice AS DOUBLE) AS y FROM part)",
    "ev": "ev AS (SELECT event_id AS id, CAST(value AS DOUBLE) AS x, (CAST(floor(epoch(ts)) AS BIGINT) % 86400) / 3600.0::DOUBLE AS y FROM events)",
    "seeds": f"""seed_means AS (SELECT CAST(label * 4 + CAST(embedding[1] > 0 AS INT) * 2 + CAST(embedding[2] > 0 AS INT) AS BIGINT) AS node,
        round(avg(CAST(embedding[1] AS DOUBLE)), 9) AS x, round(avg(CAST(embedding[2] AS DOUBLE)), 9) AS y FROM embeddings GROUP BY 1),
        seeds AS (SELECT node, x, y, {SIG}::DOUBLE AS sig, 1.0::DOUBLE / (SELECT count(*) FROM seed_means) AS pi FROM seed_means)""",
    "seeds3": f"""seed_means AS (SELECT CAST(label * 4 + CAST(embedding[1] > 0 AS INT) * 2 + CAST(embedding[2] > 0 AS INT) AS BIGINT) AS node,
        round(avg(CAST(embedding[1] AS DOUBLE)), 9) AS x, round(avg(CAST(embedding[2] AS DOUBLE)), 9) AS y, round(avg(CAST(embedding[3] AS DOUBLE)), 9) AS z FROM embeddings GROUP BY 1),
        seeds AS (SELECT node, x, y, z, {SIG}::DOUBLE AS sig, 1.0::DOUBLE / (SELECT count(*) FROM seed_means) AS pi FROM seed_means)""",
    "near": """ranked AS MATERIALIZED (SELECT a.id AS src, b.id AS dst, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2,
        row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.id) AS rank FROM p2 a JOIN p2 b ON a.id <> b.id)""",
    "edges": "edges AS (SELECT src, dst FROM ranked WHERE rank <= 3)",
    "flat": "flat AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM edges)",
    "resp": f"""pairs AS (SELECT p.id, s.node, s.pi * pow(2 * pi() * s.sig, -1.0) * exp(-((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)) / (2 * s.sig)) AS w
        FROM p2 p JOIN seeds s ON (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y) <= {KSIG} * {KSIG} * s.sig),
        weighed AS (SELECT * FROM pairs UNION ALL SELECT id, -1, {ALPHA} / {AREA} FROM p2),
        resp AS (SELECT id, node, w / sum(w) OVER (PARTITION BY id) AS r FROM weighed),
        resp_plain AS (SELECT id, node, w / sum(w) OVER (PARTITION BY id) AS r FROM pairs)""",
}


def ctes(*names: str) -> str:
    return "WITH " + ", ".join(CTE[n] for n in names)

"""What tables that cut the lineage of loops keep away from the driver."""

from pyspark.sql import functions as F

from crestline.operators.state import ADVISED, MOST_TASK_BYTES, THRESHOLD, cut, few_broadcasts


def test_packed_tables_of_loops_are_not_broadcast(spark):
    # 400,000 rows that pack to about a MB
    rows = cut(spark.range(400_000).select("id", (F.col("id") % 7).alias("comp")))
    before = spark.conf.get(THRESHOLD)
    plan = lambda: rows.join(rows.withColumnRenamed("comp", "other"), "id").groupBy("comp").count()._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan()
    with few_broadcasts(spark):
        assert "BroadcastHashJoin" not in plan()
    assert cut(rows.limit(3)).count() == 3 and spark.conf.get(THRESHOLD) == before


def test_tasks_of_loops_read_few_packed_bytes(spark):
    before = spark.conf.get(ADVISED)
    with few_broadcasts(spark):
        assert int(spark.conf.get(ADVISED)) == MOST_TASK_BYTES
    assert spark.conf.get(ADVISED) == before

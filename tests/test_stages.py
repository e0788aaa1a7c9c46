from pyspark.sql import functions as F

from nestflow.operators import graph
from nestflow.stages import Stages


def test_tables_small_in_files_are_not_broadcast(spark):
    """Edges of many small graphs take 20 times the room as rows that they take in files; broadcasts of them ended drivers."""
    n = spark.range(1_000_000)
    edges = n.select(F.concat(F.lit("click/"), F.expr("id div 12")).alias("g"), (F.col("id") % 12).alias("u"), (F.col("id") % 12 + 1 + F.col("id") % 7).alias("v"))
    edges = Stages(spark, "edges").keep(edges)
    plan = graph.triangles(edges)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_small_tables_are_broadcast(spark):
    few = Stages(spark, "few").keep(spark.range(100))
    many = Stages(spark, "many").keep(spark.range(3_000_000))
    assert "BroadcastHashJoin" in many.join(few, "id")._jdf.queryExecution().sparkPlan().toString()


def test_a_callers_own_factor_stays(spark):
    key = "spark.sql.sources.fileCompressionFactor"
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, "7.0")
        Stages(spark, "own")
        assert spark.conf.get(key) == "7.0"
    finally:
        spark.conf.set(key, old)

"""Inputs derived from the star-schema tables: interval diagrams, batches, graphs and labels; each as a DataFrame and as SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.seeds import character_bank
from ..operators.numbering import numbered

#: Written out in full in the SQL, so both sides see the same doubles.
BANK = [(i, *(round(x, 6) for x in w)) for i, *w in character_bank(16, 20240611)]
FEATURES = 16

ATOMS_SQL = "atoms AS (SELECT l_suppkey AS obs, l_discount AS birth, l_discount + l_quantity / 100 AS death, CAST(count(*) AS DOUBLE) AS coefficient FROM lineitem GROUP BY 1, 2, 3)"
BATCHES_SQL = "batches AS (SELECT s_nationkey AS batch, s_suppkey AS obs FROM supplier)"
_PAIRS_SQL = """pairs AS (SELECT event_type AS g, least(p, user_id) AS u, greatest(p, user_id) AS v, pos FROM (
  SELECT event_type, user_id, lag(user_id) OVER w AS p, row_number() OVER w - 1 AS pos FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))
  WHERE p IS NOT NULL AND p <> user_id)"""
EDGES_SQL = _PAIRS_SQL + ", edges AS (SELECT g, u, v, min(pos) AS formation, count(*) AS support FROM pairs GROUP BY 1, 2, 3)"
LABELS_SQL = """samples AS (SELECT c_custkey AS id, c_mktsegment AS label, c_nationkey AS stratum FROM customer),
predicted AS (SELECT a.id, a.label, a.stratum, CASE WHEN a.id % 3 = 0 THEN b.label ELSE a.label END AS prediction, CASE WHEN a.id % 4 = 0 THEN b.label ELSE a.label END AS second
  FROM samples a JOIN samples b ON b.id = a.id - a.id % 7 + 1)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs, birth, death, coefficient: one interval per discount and quantity of a supplier."""
    t = table(spark, sf_dir, "lineitem")
    return t.groupBy(F.col("l_suppkey").alias("obs"), F.col("l_discount").alias("birth"), (F.col("l_discount") + F.col("l_quantity") / 100).alias("death")).agg(F.count("*").cast("double").alias("coefficient"))


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("batch"), F.col("s_suppkey").alias("obs"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """g, u, v, formation, support: users of consecutive events of a type."""
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    t = table(spark, sf_dir, "events").select(F.col("event_type").alias("g"), F.col("user_id").alias("b"), F.lag("user_id").over(w).alias("a"), (F.row_number().over(w) - 1).cast("long").alias("pos"))
    t = t.where(F.col("a").isNotNull() & (F.col("a") != F.col("b")))
    return t.groupBy("g", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.min("pos").alias("formation"), F.count("*").alias("support"))


#: Events in a window, and the vertices that its users are counted to.
WINDOW, VERTICES = 20, 12


def window_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """g, label, number, u, v, formation, support: a graph for every ``WINDOW`` consecutive events of a type, which is its label; users of consecutive events are joined, by their numbers' remainders."""
    t = table(spark, sf_dir, "events").select(F.col("event_type").alias("label"), (F.col("user_id") % VERTICES).alias("b"), "ts", "event_id")
    t = numbered(t, ["label"], ["ts", "event_id"], "at").withColumn("number", F.floor((F.col("at") - 1) / WINDOW).cast("int"))
    w = Window.partitionBy("label", "number").orderBy("at")
    t = t.withColumn("a", F.lag("b").over(w)).withColumn("pos", (F.col("at") - 1) % WINDOW).where("a IS NOT NULL AND a <> b")
    return t.groupBy(F.concat_ws("/", "label", "number").alias("g"), "label", "number", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.min("pos").cast("long").alias("formation"), F.count("*").alias("support"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label"), F.col("c_nationkey").alias("stratum"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, stratum and two predictions that are wrong now and then."""
    a = samples(spark, sf_dir)
    b = a.select(F.col("id").alias("k"), F.col("label").alias("other"))
    j = a.join(b, F.col("k") == F.col("id") - F.col("id") % 7 + 1)
    return j.select("id", "label", "stratum", F.when(F.col("id") % 3 == 0, F.col("other")).otherwise(F.col("label")).alias("prediction"), F.when(F.col("id") % 4 == 0, F.col("other")).otherwise(F.col("label")).alias("second"))

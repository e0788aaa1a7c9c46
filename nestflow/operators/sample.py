"""Draws in proportion to weights, by running sums."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..stages import Stages


def weighted_pick(weights: DataFrame, draws: DataFrame) -> DataFrame:
    """draws (g, draw, u) with the item i of (g, i, w) at which the running sum of the group's weights passes u times their total; u is in [0, 1).

    Items and draws are put in one order of sums, so there is no join of ranges: a draw takes the first item that ends beyond it, the least of those that end alike. Both the sums and that order are made by ranges of
    (group, order), so a large group lies in many tasks; of each range only its sum and its ends are gathered, and every window has a frame that grows from its start.
    """
    stages = Stages(weights.sparkSession, "picks")
    before, upto = (Window.unboundedPreceding, -1), (Window.unboundedPreceding, 0)
    per_group = lambda *order: Window.partitionBy("_g").orderBy(*order)  # noqa: E731  a row for each range at most

    def ranged(df: DataFrame, *order: str) -> DataFrame:
        return stages.keep(df.repartitionByRange("g", *order).withColumn("_range", F.spark_partition_id()))  # which range a row is in must not change from here on

    def with_ranges(rows: DataFrame, per: DataFrame) -> DataFrame:
        return rows.join(per, rows["g"].eqNullSafe(per["_g"]) & (rows["_range"] == per["_r"])).drop("_g", "_r", "_range")

    within = Window.partitionBy("g", "_range")
    items = ranged(weights.select("g", "i", "w"), "i").withColumn("_sum", F.sum("w").over(within.orderBy("i").rowsBetween(*upto)))
    per = items.groupBy(F.col("g").alias("_g"), F.col("_range").alias("_r")).agg(F.max("_sum").alias("own"))
    per = per.select("_g", "_r", F.coalesce(F.sum("own").over(per_group("_r").rowsBetween(*before)), F.lit(0.0)).alias("_before"), F.sum("own").over(Window.partitionBy("_g")).alias("_total"))
    ends = with_ranges(items, per).select("g", ((F.col("_before") + F.col("_sum")) / F.col("_total")).alias("at"), F.lit(0).alias("kind"), "i")
    asks = draws.select("g", F.col("u").alias("at"), F.lit(1).alias("kind"), F.col("draw").cast("long").alias("draw"), "u")
    # at equal places the item comes first, so that a draw at its very end goes on to the next
    order = ["at", "kind", "i"]
    both = ranged(ends.unionByName(asks, allowMissingColumns=True), *order)
    down = [F.desc(c) for c in order]
    rows = both.withColumn("next", F.last("i", ignorenulls=True).over(within.orderBy(*down).rowsBetween(*before)))
    item = F.when(F.col("kind") == 0, F.struct("at", "i"))
    per = both.groupBy(F.col("g").alias("_g"), F.col("_range").alias("_r")).agg(F.min(item)["i"].alias("first"), F.max(item)["i"].alias("last"))
    beyond = F.last("first", ignorenulls=True).over(per_group(F.desc("_r")).rowsBetween(*before))
    end = F.max(F.when(F.col("last").isNotNull(), F.struct("_r", "last"))).over(Window.partitionBy("_g"))["last"]
    return with_ranges(rows.where("kind = 1"), per.select("_g", "_r", beyond.alias("_beyond"), end.alias("_end"))).select("g", "draw", "u", F.coalesce("next", "_beyond", "_end").alias("i"))

"""Checks of tables; each returns the rows that break a rule, so an empty result means that it holds."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df, if it has exactly these columns in this order and of these types."""
    want, have = [(f.name, f.dataType.simpleString()) for f in schema.fields], [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    if want != have:
        raise ValueError(f"columns are {have}, not {want}")
    return df


def wrong_version(df: DataFrame, version: int, column: str = "schema_version") -> DataFrame:
    return df.where(~F.col(column).eqNullSafe(F.lit(version)))


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """keys, n."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def gaps(df: DataFrame, index: str, *by: str) -> DataFrame:
    """by, index, why: what is missing from, or beyond, 0 to count - 1 in each group."""
    have = df.select(*by, index).distinct()
    n = df.groupBy(*by).agg(F.count("*").alias("_n"))
    want = n.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias(index))
    have = have.withColumn(index, F.col(index).cast("long"))
    return want.exceptAll(have).withColumn("why", F.lit("missing")).unionByName(have.exceptAll(want).withColumn("why", F.lit("extra")))


def key_differences(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """keys, why: in the first table only, or the second only."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    return x.exceptAll(y).withColumn("why", F.lit("first")).unionByName(y.exceptAll(x).withColumn("why", F.lit("second")))


def domain_differences(df: DataFrame, axes: list[DataFrame]) -> DataFrame:
    """columns, why: combinations of the axes' values that df lacks, and those it has beyond them."""
    want = axes[0].distinct()
    for a in axes[1:]:
        want = want.crossJoin(a.distinct())  # the combinations are what is asked for
    have = df.select(*want.columns).distinct()
    return want.exceptAll(have).withColumn("why", F.lit("missing")).unionByName(have.exceptAll(want).withColumn("why", F.lit("extra")))

"""Signed diagrams of intervals: rows (obs, birth, death, coefficient), unique on the first three.

Equality of intervals is exact. Coefficients within 1e-12 of zero and intervals of length 0 count as absent.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import ZERO, strictly_nested

KEY = ("obs", "birth", "death")


def add_up(atoms: DataFrame) -> DataFrame:
    """Merges equal intervals; what cancels out or has no length goes."""
    a = atoms.where("birth <> death").groupBy(*KEY).agg(F.sum("coefficient").alias("coefficient"))
    return a.where(F.abs("coefficient") > ZERO)


def clean(atoms: DataFrame, zero: float = ZERO) -> DataFrame:
    return atoms.where((F.abs("coefficient") > zero) & (F.col("birth") != F.col("death")))


def scale(atoms: DataFrame, by: float) -> DataFrame:
    return clean(atoms.withColumn("coefficient", F.col("coefficient") * F.lit(float(by))))


def add(*diagrams: DataFrame) -> DataFrame:
    return add_up(reduce(DataFrame.unionByName, (d.select(*KEY, "coefficient") for d in diagrams)))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return add(a, b.withColumn("coefficient", -F.col("coefficient")))


def prune(atoms: DataFrame, least: float) -> DataFrame:
    """Intervals of at least this length."""
    return atoms.where(F.col("death") - F.col("birth") >= F.lit(float(least)))


def expand(atoms: DataFrame) -> DataFrame:
    """Each interval as often as the whole part of its coefficient says."""
    n = F.col("coefficient").cast("int")
    return atoms.where(n >= 1).select(*KEY, F.explode(F.sequence(F.lit(1), n)).alias("copy"))


def totals(atoms: DataFrame) -> DataFrame:
    """obs, support, mass, absolute_mass, is_zero."""
    a = atoms.groupBy("obs").agg(F.count("*").alias("support"), F.sum("coefficient").alias("mass"), F.sum(F.abs("coefficient")).alias("absolute_mass"))
    return a.withColumn("is_zero", F.col("support") == 0)


def nested_pairs(atoms: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Pairs of a source s strictly inside a target t of the same observation, as s_* and t_* columns.

    An equi-join on the observation with the order as its condition; the number of pairs grows with the square of an observation's size.
    """
    s = atoms.select("obs", *[F.col(c).alias("s_" + c) for c in ("birth", "death", "coefficient")])
    t = (atoms if targets is None else targets).select(F.col("obs").alias("obs_t"), *[F.col(c).alias("t_" + c) for c in ("birth", "death", "coefficient")])
    inside = strictly_nested(F.col("s_birth"), F.col("s_death"), F.col("t_birth"), F.col("t_death"))
    return s.join(t, (F.col("obs") == F.col("obs_t")) & inside).drop("obs_t")


def second_order(atoms: DataFrame) -> DataFrame:
    """The diagram of pairs of comparable intervals: (obs, left interval inside right interval, product of coefficients)."""
    p = nested_pairs(atoms)
    return p.select("obs", F.col("s_birth").alias("left_birth"), F.col("s_death").alias("left_death"), F.col("t_birth").alias("right_birth"), F.col("t_death").alias("right_death"), (F.col("s_coefficient") * F.col("t_coefficient")).alias("coefficient"))


def violations(atoms: DataFrame) -> DataFrame:
    """Rows that are no interval of a diagram, with the reason."""
    why = F.when(F.col("birth").isNull() | F.col("death").isNull() | F.isnan("birth") | F.isnan("death") | (F.abs("birth") == float("inf")) | (F.abs("death") == float("inf")), "not finite").when(F.col("birth") >= F.col("death"), "not before")
    return atoms.withColumn("why", why).where("why IS NOT NULL")


def canonical(atoms: DataFrame) -> DataFrame:
    """With each interval's place in the order of birth, then death, within its observation."""
    from pyspark.sql import Window

    return atoms.withColumn("place", F.row_number().over(Window.partitionBy("obs").orderBy("birth", "death")) - 1)


def weight(c: Column, b: Column, d: Column) -> Column:
    """Coefficient times length."""
    return c * (d - b)

"""Numbers, dense ranks and sizes within groups of any size.

Rows are sorted by ranges of (group, order), so a large group lies in many tasks, and numbered within each range. Of each group and range only its size, its number of ranks and its first and last
order keys are gathered, and what lies before a range is added to the numbers in it.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..stages import Stages


def _sorts(order: list[str]) -> list[Column]:
    return [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order]


def numbered(df: DataFrame, by: list[str], order: list[str], number: str | None = None, rank: tuple[str, int] | None = None, last_rank: str | None = None, size: str | None = None, ranges: int | None = None) -> DataFrame:
    """Adds, of each row within its group, the columns that are named; a column of that name goes.

    order: columns, "-" before one sorts it downwards. number: place from 1. rank: (name, n), dense rank from 1 by the first n columns of order; last_rank: the largest one. size: rows of the group.
    Rows that are equal in all of order are numbered in any order. A range is a partition, of which there are as many as the session shuffles to, or ``ranges``.
    """
    stages, taken = Stages(df.sparkSession, "numbered"), {c.lower() for c in df.columns}

    def fresh(name: str) -> str:
        while name in taken:
            name += "_"
        taken.add(name)
        return name

    at, place, step = fresh("__range"), fresh("__place"), fresh("__step")
    keys = [F.col(b) for b in by] + _sorts(order)
    dealt = df.repartitionByRange(ranges, *keys) if ranges else df.repartitionByRange(*keys)
    rows = stages.keep(dealt.withColumn(at, F.spark_partition_id()))  # which range a row is in must not change from here on
    leading = order[: rank[1]] if rank else order[:1]
    within = Window.partitionBy(*by, at)
    rows = rows.withColumn(place, F.row_number().over(within.orderBy(*_sorts(order)))).withColumn(step, F.dense_rank().over(within.orderBy(*_sorts(leading))))
    key = F.struct(*[c.lstrip("-") for c in leading])
    per = rows.groupBy(*by, at).agg(F.max(place).alias("n"), F.max(step).alias("k"), F.min_by(key, place).alias("first"), F.max_by(key, place).alias("last"))
    group, upto = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(at)  # a row for each range at most
    new = F.col("k") - F.coalesce(F.lag("last").over(upto).eqNullSafe(F.col("first")).cast("int"), F.lit(0))
    per = per.withColumn("new", new).select(
        *[F.col(b).alias(f"__by{i}") for i, b in enumerate(by)], F.col(at).alias("__at"),
        (F.sum("n").over(upto) - F.col("n")).alias("__before"), (F.sum("new").over(upto) - F.col("k")).alias("__below"), F.sum("n").over(group).alias("__size"), F.sum("new").over(group).alias("__ranks"),
    )
    same = reduce(lambda a, b: a & b, [rows[b].eqNullSafe(per[f"__by{i}"]) for i, b in enumerate(by)], rows[at] == per["__at"])
    out = [rows[c] for c in df.columns if c not in (number, rank and rank[0], last_rank, size)]
    if number:
        out.append((rows[place] + per["__before"]).cast("int").alias(number))
    if rank:
        out.append((rows[step] + per["__below"]).cast("int").alias(rank[0]))
    if last_rank:
        out.append(per["__ranks"].alias(last_rank))
    if size:
        out.append(per["__size"].alias(size))
    return rows.join(per, same).select(*out)

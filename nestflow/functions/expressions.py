"""Column expressions: orders and distances on intervals, and numerically stable helpers. All stay inside code generation."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of a size up to this count as zero.
ZERO = 1e-12


def nested(b1: Column, d1: Column, b2: Column, d2: Column) -> Column:
    """Interval 1 lies inside interval 2; the preorder of intervals."""
    return (b2 <= b1) & (d1 <= d2)


def strictly_nested(b1: Column, d1: Column, b2: Column, d2: Column) -> Column:
    return nested(b1, d1, b2, d2) & ((b1 != b2) | (d1 != d2))


def equivalent(b1: Column, d1: Column, b2: Column, d2: Column) -> Column:
    return nested(b1, d1, b2, d2) & nested(b2, d2, b1, d1)


def pair_precedes(p: dict[str, Column], q: dict[str, Column]) -> Column:
    """Order on pairs of intervals: contravariant in the left interval, covariant in the right one. Keys: lb, ld, rb, rd."""
    return nested(q["lb"], q["ld"], p["lb"], p["ld"]) & nested(p["rb"], p["rd"], q["rb"], q["rd"])


def length(b: Column, d: Column) -> Column:
    return d - b


def chebyshev(b1: Column, d1: Column, b2: Column, d2: Column) -> Column:
    return F.greatest(F.abs(b1 - b2), F.abs(d1 - d2))


def to_diagonal(b: Column, d: Column) -> Column:
    return (d - b) / 2


def based(b1: Column, d1: Column, b2: Column, d2: Column) -> Column:
    """Distance once both intervals may go by way of the diagonal."""
    return F.least(chebyshev(b1, d1, b2, d2), to_diagonal(b1, d1) + to_diagonal(b2, d2))


def pair_product(p: dict[str, Column], q: dict[str, Column]) -> Column:
    return based(p["lb"], p["ld"], q["lb"], q["ld"]) + based(p["rb"], p["rd"], q["rb"], q["rd"])


def pair_to_diagonal(p: dict[str, Column]) -> Column:
    """Distance between a pair's two intervals: with none, the pair is as good as zero."""
    return based(p["lb"], p["ld"], p["rb"], p["rd"])


def pair_based(p: dict[str, Column], q: dict[str, Column]) -> Column:
    return F.least(pair_product(p, q), pair_to_diagonal(p) + pair_to_diagonal(q))


def logistic(x: Column) -> Column:
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def log_odds(p: Column) -> Column:
    return F.log(p) - F.log1p(-p)


def log_add_exp(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def power_law_weight(i: Column, n: Column, exponent: float) -> Column:
    return F.pow(n / (i + 0.5), F.lit(1.0 / (exponent - 1.0)))


def r6(c: Column) -> Column:
    """Rounded to six places; -0.0 becomes 0.0."""
    return F.round(c, 6) + F.lit(0.0)

import math

import numpy as np
import pytest

from nestflow.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, queries, k=5):
    ok = [(i, [math.floor(256.0 * float(np.float32(c))) for c in v]) for i, v, _ in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for q, x in ok:
        if q in queries:
            s = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in ok if i != q and len(y) == len(x))
            out += [(q, r, i, max(-(2**63), min(2**63 - 1, -n))) for r, (n, i) in enumerate(s[:k], 1)]
    return sorted(out)


def run(spark, rows, every=3, k=5):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ids", topk.F.col("label")).withColumn("data", topk.F.col("label"))
    return sorted(map(tuple, topk.search(df, df.where(f"vec_id % {every} = 0"), k).collect()))


@pytest.mark.parametrize("dim, scale", [(1, 1), (3, 1), (8, 1), (64, 1), (16, 1e-9)])
def test_against_all_pairs(spark, monkeypatch, dim, scale):
    monkeypatch.setattr(topk, "VECTORS", 40)
    monkeypatch.setattr(topk, "QUERIES", 16)
    rng = np.random.default_rng(dim)
    rows = [(i, [float(x) for x in rng.normal(size=dim) * scale], 0) for i in range(150)]
    rows += [(150 + i, rows[i][1], 0) for i in range(20)]  # ties
    assert run(spark, rows) == brute(rows, {r[0] for r in rows if r[0] % 3 == 0})


def test_odd_tables(spark):
    rows = [(0, None, 1), (3, [1.0, None], 1), (6, [1.0, math.nan], 1), (9, [1.0, math.inf], 1), (12, [1.0, 2.0], 1), (13, [1.0, 2.0], 1), (15, [-1.0, 0.5], None), (None, [1.0, 1.0], 1), (18, [], 1), (21, [1.0], 1), (24, [3e30, 1.0], 1)]
    assert run(spark, rows) == brute(rows, {12, 15, 18, 21, 24})
    assert run(spark, rows[:0]) == [] and run(spark, rows[:3]) == []


def test_bounds_hold():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(50, 32)), rng.normal(size=(60, 32))
    for k in topk.resolutions(32):
        assert (topk.statistics(x, k) @ topk.statistics(y, k).T >= x @ y.T - 1e-9).all()


@pytest.mark.parametrize("spread, stream, group", [(1, 1000, 1), (2, 2, 2), (64, 16, 8)])
def test_grids(spark, monkeypatch, spread, stream, group):
    for name, x in (("VECTORS", 16), ("QUERIES", 8), ("SPREAD", spread), ("STREAM", stream), ("GROUP", group)):
        monkeypatch.setattr(topk, name, x)
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=12)], 0) for i in range(200)] + [(i, [0.5], 0) for i in range(200, 260)]
    assert run(spark, rows) == brute(rows, {r[0] for r in rows if r[0] % 3 == 0})


def test_levels_prune(spark):
    """Vectors that are nearly constant in segments: most pairs go before their products are made, and the counts only fall."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.repeat(rng.normal(size=8) * 3, 8) + rng.normal(size=64) * 0.1], 0) for i in range(5000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = dict(map(tuple, topk.survivors(df, df.where("vec_id % 50 = 0")).collect()))
    n = [got[i] for i in sorted(got)]
    assert n[0] == 100 * 4999 and all(a >= b for a, b in zip(n, n[1:])) and n[-2] < 0.1 * n[0] and n[-1] >= 500


def test_work_is_below_brute_force(spark):
    """On vectors with structure at several scales a small part of the multiplications is left; without any structure at most what the coarsest level adds."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.repeat(rng.normal(size=8) * 3, 8) + rng.normal(size=64) * 0.1], 0) for i in range(5000)]
    plain = [(i, [float(x) for x in rng.normal(size=64)], 0) for i in range(5000)]
    for table, most in ((rows, 0.35), (plain, 1.15)):
        df = spark.createDataFrame(table, SCHEMA)
        got = dict(map(tuple, topk.multiplications(df, df.where("vec_id % 50 = 0")).collect()))
        assert got[0] == 0 and sum(got.values()) < most * 100 * 4999 * 64, got

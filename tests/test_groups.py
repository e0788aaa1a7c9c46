import pyarrow as pa
from pyspark.sql import functions as F

from nestflow.functions import seeds
from nestflow.operators import graph, groups, harmonic, homology, perturb

from .test_operators import random_edges

EDGES = "g string, u long, v long, time double"


def graphs(n=12):
    return [(f"g{k}", u, v, float(i % 5)) for k in range(n) for i, (_, u, v, *_) in enumerate(random_edges(k, 7 + k % 3, 0.7))]


def small_batches(spark, f):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "5")
    try:
        return f()
    finally:
        spark.conf.set(key, old)


def test_groups_cross_batches():
    keys = ["a", "a", None, None, "b", "b", "b", "c"]
    t = pa.table({"k": keys, "x": range(8)})
    for n in range(1, 9):
        got = [(k[0].as_py(), rows["x"].to_pylist()) for k, rows in groups.groups(t.to_batches(n)) if rows is not None]
        assert got == [("a", [0, 1]), (None, [2, 3]), ("b", [4, 5, 6]), ("c", [7])]


def test_many_graphs_of_a_task_are_swapped_each_for_itself(spark):
    """No call of Python for each graph; each graph gets the swaps that it gets alone, also where severity leaves it none."""
    rows = [*graphs(), ("few", 0, 1, 0.0)]
    want = set()
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[3], r[1], r[2]))
        new = perturb.swapped([r[1:3] for r in own], int(0.3 * len(own)), seeds.Twister(11))
        want |= {(g, *x, r[3]) for x, r in zip(new, own, strict=True)}
    out = perturb.swap_edges(spark.createDataFrame(rows, EDGES), 0.3, 11)
    got = small_batches(spark, lambda: out.select("g", "u", "v", "time").collect())
    assert set(map(tuple, got)) == want and len(got) == len(rows)


def test_many_graphs_of_a_task_are_reduced_each_for_itself(spark):
    rows = graphs()
    cx = graph.clique_complex(spark.createDataFrame([(g, u, v, t / 5) for g, u, v, t in rows], EDGES))
    h = homology.h1(cx, drop_empty=False)
    got = {tuple(r) for r in small_batches(spark, h.collect)}
    want = {tuple(r) for r in homology.h1_spread(cx, drop_empty=False).select(*h.columns).collect()}
    assert got == want and len(want) > 12
    assert "FlatMapGroups" not in h._jdf.queryExecution().sparkPlan().toString()


def test_many_observations_of_a_task_have_their_own_coordinates(spark):
    spec = seeds.feature_spec(seeds.character_bank(4, 3), 8)
    atoms = spark.range(60).select(F.concat(F.lit("o"), F.col("id") % 9).alias("obs"), (F.col("id") % 7 / 10).alias("birth"), (F.col("id") % 7 / 10 + F.col("id") % 5 / 7 + 0.1).alias("death"), (F.col("id") % 3 + 1.0).alias("coefficient"))
    a, b = (harmonic.coordinates(atoms, spec, s) for s in ("kernel", "join"))
    assert "FlatMapGroups" not in a._jdf.queryExecution().sparkPlan().toString()
    key = lambda rows: {(r.obs, r.idx): (round(r.re, 8), round(r.im, 8)) for r in rows}
    x, y = key(small_batches(spark, a.collect)), key(b.collect())
    assert x.keys() == y.keys() and all(abs(p - q) < 1e-6 for k in x for p, q in zip(x[k], y[k], strict=True))

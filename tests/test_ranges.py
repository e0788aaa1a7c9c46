"""Plans for groups that no task holds: numbering, dominance sums, persistence, perturbations, bootstraps; ranges are forced small and results held against kernels and definitions."""
import collections
import itertools
import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from nestflow.functions import seeds
from nestflow.operators import evaluate, graph, harmonic, homology, perturb, transport
from nestflow.operators.numbering import numbered
from nestflow.plans import fixtures as fx

SF = "/root/testdata/sf0.001"
SPEC = [(i, f, a, b) for i, (f, a, b) in enumerate([("linear", 1.0, 2.0), ("weighted_linear", -0.5, 1.0), ("relationship", 1.5, -2.0), ("weighted_relationship", 0.3, 0.7), ("relationship_mass", 0.0, 0.0), ("weighted_relationship_mass", 0.0, 0.0)])]


def collected(df):
    return collections.Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("ranges", [1, 7])
def test_numbers_are_those_of_windows(spark, ranges):
    """One hot group, ties that straddle ranges, null groups and null keys."""
    rng = np.random.default_rng(3)
    rows = [(None if i % 17 == 0 else "hot" if i % 3 else f"g{i % 5}", None if i % 29 == 0 else int(rng.integers(0, 4)), i) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, a int, b int")
    w = Window.partitionBy("g")
    want = df.select("g", "a", "b", F.row_number().over(w.orderBy(F.desc("a"), "b")).alias("n"), F.dense_rank().over(w.orderBy(F.desc("a"))).alias("k"), F.count("*").over(w).alias("s"))
    want = want.withColumn("m", F.max("k").over(w).cast("long")).select("g", "a", "b", "n", "k", "m", "s")
    assert collected(numbered(df, ["g"], ["-a", "b"], "n", ("k", 1), "m", "s", ranges)) == collected(want)


def test_a_hot_group_lies_in_many_ranges(spark):
    df = spark.range(10_000).select(F.lit("hot").alias("g"), F.col("id").alias("x"), F.lit(1).alias("__range"))
    got = numbered(df, ["g"], ["x"], "n", ranges=8)
    assert got.where("n <> x + 1").count() == 0 and got.columns == ["g", "x", "__range", "n"]
    dealt = df.repartitionByRange(8, "g", "x").groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) == 8 and max(r["count"] for r in dealt) < 2500


def test_numbers_of_nothing(spark):
    df = spark.createDataFrame([], "g string, a int")
    assert numbered(df, ["g"], ["a"], "n", ("k", 1), "m", "s").collect() == []


def spans(spark, n, seed=1):
    rng = np.random.default_rng(seed)
    b = rng.integers(0, 60, n)
    rows = {("big" if i % 4 else "small", float(x) / 60, float(x + d) / 60): float(c) for i, (x, d, c) in enumerate(zip(b, rng.integers(1, 60, n), rng.integers(-3, 4, n)))}
    return spark.createDataFrame([(*k, c) for k, c in rows.items()] + [("one", 0.0, 1.0, 2.0)], "obs string, birth double, death double, coefficient double")


@pytest.mark.parametrize("rows", [3, 50, 100_000])
def test_dominance_sums_by_ranges(spark, rows):
    a = spans(spark, 900)
    got = {(r.obs, r.idx): complex(r.re, r.im) for r in harmonic.coordinates(a, SPEC, "ranges", rows=rows).collect()}
    want = {(r.obs, r.idx): complex(r.re, r.im) for r in harmonic.coordinates(a, SPEC, "kernel").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 * max(1, abs(want[k])) for k in want)


def test_large_observations_take_ranges(spark):
    a = spans(spark, 600)
    plan = harmonic.coordinates(a, SPEC, most=200, rows=40)
    got = {(r.obs, r.idx): complex(r.re, r.im) for r in plan.collect()}
    want = {(r.obs, r.idx): complex(r.re, r.im) for r in harmonic.coordinates(a, SPEC, "join").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 * max(1, abs(want[k])) for k in want)
    assert "NestedLoopJoin" not in plan._jdf.queryExecution().toString()


def filtered(spark):
    return graph.rank_filtration(fx.edges(spark, SF))


def test_spanning_forest_is_kruskals(spark):
    e = filtered(spark).select("g", "u", "v", "step")
    want = set()
    for g, rows in itertools.groupby(sorted(e.collect(), key=lambda r: (r.g, r.step)), key=lambda r: r.g):
        part = {}
        for r in rows:
            a, b = part.setdefault(r.u, {r.u}), part.setdefault(r.v, {r.v})
            if a is not b:
                want.add((g, r.step))
                a |= b
                for x in a:
                    part[x] = a
    forest, label = homology.spanning_forest(e.withColumnRenamed("step", "place"))
    assert set(map(tuple, forest.collect())) == want
    assert homology.components(e).groupBy("g").agg(F.countDistinct("c").alias("k")).join(e.groupBy("g").agg(F.countDistinct("step").alias("m")), "g").count() == 5
    assert label.groupBy("g", "v").count().where("count > 1").count() == 0


def test_columns_leave_a_range_reduced():
    assert homology.reduce_range([(5, {1, 4, 9}), (3, {2, 9}), (8, {2, 9}), (9, {7})], 5) == [(3, [2, 9]), (5, [1, 2, 4]), (9, [7])]


@pytest.mark.parametrize("rows", [20, 10_000])
def test_persistence_by_ranges(spark, rows):
    c = graph.clique_complex(filtered(spark))
    for keep in (True, False):
        assert collected(homology.h1_spread(c, rows, drop_empty=keep).select("obs", "birth", "death", "coefficient")) == collected(homology.h1_kernel(c, keep).select("obs", "birth", "death", "coefficient"))


def test_large_graphs_take_ranges(spark):
    c = graph.clique_complex(filtered(spark))
    most = sorted(r["count"] for r in c.groupBy("g").count().collect())[2]
    assert collected(homology.h1(c, most=most)) == collected(homology.h1_kernel(c))


def test_trussness_takes_many_passes(spark):
    """A strip of triangles beside a clique unravels by an edge or two a pass; more than twenty passes, and the size switch is crossed."""
    strip = [("s", i, j) for i in range(60) for j in (i + 1, i + 2)] + [("s", i, j) for i, j in itertools.combinations(range(100, 106), 2)] + [("s", 0, 100), ("s", 1, 100), ("t", 1, 2), ("t", 1, 3), ("t", 2, 3)]
    fan = [("s", u, v) for u, v in [(i, i + 3) for i in range(0, 56)]]
    e = spark.createDataFrame(sorted(set(strip + fan)), "g string, u long, v long")
    want = collected(graph.trussness_kernel(e).select("g", "u", "v", "trussness"))
    assert collected(graph.trussness_spread(e).select("g", "u", "v", "trussness")) == want
    assert collected(graph.trussness(e, most=5).select("g", "u", "v", "trussness")) == want


def test_sampled_non_edges_have_the_law(spark):
    """Path of 5 vertices: every pair of its 6 non-edges is as likely as any other."""
    e = spark.createDataFrame([(g, 10 * i, 10 * i + 10) for g in range(1500) for i in range(4)], "g long, u long, v long")
    got = collections.defaultdict(set)
    for r in perturb.sample_non_edges(e, e.select("g", F.lit(2).alias("n")).distinct(), 5).collect():
        got[r.g].add((r.u, r.v))
    free = [p for p in itertools.combinations(range(0, 50, 10), 2) if p[1] - p[0] > 10]
    n = collections.Counter(tuple(sorted(x)) for x in got.values())
    assert set(n) == set(itertools.combinations(free, 2))
    assert sum((c - 100) ** 2 / 100 for c in n.values()) < 40  # chi-squared with 14 degrees of freedom


@pytest.mark.parametrize("n", [1, 3, 5, 100])
def test_sampled_non_edges_are_as_many_as_asked(spark, n):
    e = spark.createDataFrame([("path", i, i + 1) for i in range(4)] + [("full", 0, 1), ("full", 1, 2), ("full", 0, 2)] + [("star", 0, i) for i in range(1, 40)], "g string, u long, v long")
    rows = perturb.sample_non_edges(e, e.select("g", F.lit(n).alias("n")).distinct(), 1).collect()
    count = collections.Counter(r.g for r in rows)
    assert count == {k: v for k, v in {"path": min(n, 6), "star": min(n, 741)}.items() if v}
    assert len({(r.g, r.u, r.v) for r in rows}) == len(rows) and not {(r.g, r.u, r.v) for r in rows} & set(map(tuple, e.collect()))
    assert all(sorted(r.k for r in rows if r.g == g) == list(range(count[g])) for g in count)


def test_insertion_keeps_what_there_was(spark):
    e = filtered(spark)
    got = perturb.insert_random_edges(e, 0.3, 4)
    sizes = {r.g: r["count"] for r in e.groupBy("g").count().collect()}
    most = {r.g: math.comb(r["count"], 2) for r in graph.vertices(e).groupBy("g").count().collect()}
    assert {r.g: r["count"] for r in got.groupBy("g").count().collect()} == {g: min(most[g], n + math.floor(0.3 * n)) for g, n in sizes.items()}
    assert e.select("g", "u", "v", "time").exceptAll(got.select("g", "u", "v", "time")).count() == 0
    assert got.select("g", "time").distinct().exceptAll(e.select("g", "time").distinct()).count() == 0
    assert got.select("g", "u", "v").distinct().count() == got.count()


def test_swaps_in_rounds(spark):
    rng = np.random.default_rng(2)
    rows = {(g, *sorted(map(int, rng.choice(60, 2, replace=False)))): float(rng.integers(0, 9)) for g in "ab" for _ in range(300)}
    e = spark.createDataFrame([(*k, t / 9) for k, t in rows.items()], "g string, u long, v long, time double").persist()
    got = perturb.swap_edges_in_rounds(e, 0.7, 3).persist()
    assert collected(graph.degrees(got)) == collected(graph.degrees(e))
    assert got.where("u < v").select("g", "u", "v").distinct().count() == e.count()
    assert collected(got.select("g", "time")) == collected(e.select("g", "time"))
    assert e.select("g", "u", "v").exceptAll(got.select("g", "u", "v")).count() > 150


def test_large_graphs_are_swapped_in_rounds(spark):
    e = spark.createDataFrame([(g, 2 * i, 2 * i + 1, i / 10) for g, n in (("small", 5), ("large", 40)) for i in range(n)], "g string, u long, v long, time double")
    got = perturb.swap_edges(e, 0.2, 3, most=10)
    assert {r.g: r["count"] for r in e.select("g", "u", "v").exceptAll(got.select("g", "u", "v")).groupBy("g").count().collect()}["small"] == 2
    assert collected(graph.degrees(got)) == collected(graph.degrees(e))


def test_one_swap_moves_two_edges(spark):
    e = spark.createDataFrame([(g, 2 * i, 2 * i + 1, i / 10) for g in range(20) for i in range(10)], "g long, u long, v long, time double")
    got = perturb.swap_edges_in_rounds(e, 0.1, 9)
    assert all(r["count"] == 2 for r in e.select("g", "u", "v").exceptAll(got.select("g", "u", "v")).groupBy("g").count().collect()) and e.select("g", "u", "v").exceptAll(got.select("g", "u", "v")).count() == 40


def test_graphs_without_swaps_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(perturb, "BARREN", 2)
    star = spark.createDataFrame([(0, 0, i, 0.5) for i in range(1, 6)], "g long, u long, v long, time double")
    with pytest.raises(ValueError, match="no swap"):
        perturb.swap_edges_in_rounds(star, 0.5, 1)


@pytest.mark.parametrize("cells", [1000, 2])
def test_multinomial_draws_have_the_law_of_single_ones(spark, monkeypatch, cells):
    monkeypatch.setattr(evaluate, "CELLS", cells)
    monkeypatch.setattr(evaluate, "REPLICATES", 30)
    p = fx.predictions(spark, SF).where("stratum < 3")
    per = lambda d: d.groupBy("replicate", "label", "prediction").agg(F.sum("times").alias("t")).groupBy("label", "prediction").agg((F.sum("t") / 400).alias("m"), F.sum(F.col("t") * F.col("t")).alias("q"))
    many = evaluate.resampled_cells(p, ("label", "prediction"), 400, 7)
    assert many.groupBy("replicate").agg(F.sum("times").alias("t")).select("t").distinct().collect()[0].t == p.count()
    one = evaluate.resampled_cells(p, ("label", "prediction"), 400, 7, draw=evaluate.shared_draw)
    a, b = ({(r.label, r.prediction): (r.m, r.q / 400 - r.m**2) for r in per(x).collect()} for x in (many, one))
    size = {(r.label, r.prediction): r["count"] for r in p.groupBy("label", "prediction").count().collect()}
    for k, n in size.items():
        assert abs(a[k][0] - n) < 6 * math.sqrt(n / 400) and abs(b[k][0] - n) < 6 * math.sqrt(n / 400)  # the mean number of draws of a cell is its size
        assert a[k][1] < 1.6 * n + 0.5
    assert collected(many) == collected(evaluate.resampled_cells(p.repartition(3), ("label", "prediction"), 400, 7))


def test_feature_families_are_all_known():
    assert {s[1] for s in SPEC} <= set(seeds.FAMILIES) | set(seeds.STATISTICS)


def test_nearest_diagrams_are_those_of_all_pairs(spark):
    """Clusters of diagrams of several sizes, ties, a batch of one and an observation in two batches."""
    rng = np.random.default_rng(8)
    rows, members = [], []
    for obs in range(26):
        size = 1 + obs % 5
        for b, d in {tuple(x) for x in rng.integers(0, 8, (size, 2)).tolist()}:
            rows.append((obs, b / 8, (b + 1 + d * (1 + obs % 3)) / 8, float(1 + obs % 2)))
        members.append((obs % 2, obs))
    rows += [(26, b, d, c) for o, b, d, c in rows if o == 0] + [(27, 0.0, 1.0, 0.5)]
    members += [(0, 26), (1, 0), (5, 3), (0, 27)]
    atoms = spark.createDataFrame(rows, "obs long, birth double, death double, coefficient double")
    of = {o: transport.expand(np.array([r[1:3] for r in rows if r[0] == o]), np.array([r[3] for r in rows if r[0] == o])) for o in range(27)}
    want = {}
    for batch, obs in members:
        if obs == 27:  # no whole interval
            continue
        all_ = [(round(transport.w1(of[obs], of[o]), 9), o) for x, o in members if x == batch and o != obs and o != 27]
        if all_:
            want[batch, obs] = (min(all_)[1], min(all_)[0])
    got = transport.nearest(atoms, spark.createDataFrame(members, "batch int, obs long")).collect()
    assert {(r.batch, r.obs): (r.other, pytest.approx(r.w1, abs=1e-8)) for r in got} == want
    assert sum(r.solved for r in got) < 0.8 * sum(r.others for r in got)
    for p, q in itertools.combinations(of.values(), 2):
        assert transport.persistence_bound(p, q) <= transport.w1(p, q) + 1e-9


def test_partial_assignments_are_those_of_square_matrices():
    """Side by side, of several sizes; ties, rows that pay to stay and empty sides."""
    rng = np.random.default_rng(5)
    for whole in (True, False):
        problems = []
        for n, m in rng.integers(0, 14, (60, 2)).tolist():
            draw = lambda *shape: rng.integers(0, 6, shape) / 10 if whole else rng.random(shape)  # noqa: E731, B023
            problems.append((draw(n, m), draw(n) * 0.6, draw(m) * 0.6))
        want = [transport.assignment(transport.square_costs(*p))[0] if p[0].size else p[1].sum() + p[2].sum() for p in problems]
        assert transport.partial_assignments(problems) == pytest.approx(want, abs=1e-9)


def test_copies_of_diagrams_are_compared_once(spark):
    """Copies of three diagrams have a copy at distance 0, which takes no exact distances between copies."""
    shapes = [[(0.0, 0.5)], [(0.0, 0.5), (0.25, 1.0)], [(0.1, 0.9)]]
    atoms = spark.createDataFrame([(o, b, d, 1.0) for o in range(90) for b, d in shapes[o % 3]], "obs long, birth double, death double, coefficient double")
    got = {r.obs: (r.other, r.w1, r.solved) for r in transport.nearest(atoms, spark.range(90).select(F.lit(0).alias("batch"), F.col("id").alias("obs"))).collect()}
    assert {o: x[:2] for o, x in got.items()} == {o: (o % 3 if o > 2 else o + 3, 0.0) for o in range(90)}
    assert all(x[2] <= 2 for x in got.values())


def test_ranges_do_not_multiply_partitions(spark, monkeypatch):
    """Many ranges share a partition, and a level of the tree has sixteen to a node."""
    dealt = []
    carried = harmonic._carried
    monkeypatch.setattr(harmonic, "_carried", lambda rows, spec, ranges: dealt.append((rows.select("level").distinct().count(), ranges)) or carried(rows, spec, ranges))
    a = spans(spark, 900)
    got = {(r.obs, r.idx): complex(r.re, r.im) for r in harmonic.coordinates(a, SPEC, "ranges", rows=4).collect()}
    want = {(r.obs, r.idx): complex(r.re, r.im) for r in harmonic.coordinates(a, SPEC, "join").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 * max(1, abs(want[k])) for k in want)
    assert dealt == [(2, 4)]  # 225 ranges at most, the session's four partitions


def test_a_kernel_holds_few_bytes_of_a_simplex():
    """A long cycle with a chord to every vertex: one array entry for each end and side, and no object for each simplex."""
    n = 60_000
    ends = np.array([(0, i) for i in range(1, n)] + [(i, i + 1) for i in range(1, n - 1)])
    sides = np.array([(i - 1, i, n - 2 + i) for i in range(1, n - 1)])
    tracemalloc.start()
    got = homology.interval_arrays(np.linspace(0, 0.5, len(ends)), ends, np.linspace(0.6, 0.9, len(sides)), sides)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == n - 2 and (got[:, 1] < 1).all() and peak < 400 * (len(ends) + len(sides))


def test_few_partial_sums_without_order(spark):
    """An observation's intervals meet in a few tasks before they have a row for every feature; sums are those of the definition."""
    a = spans(spark, 300).repartition(3)
    plan = harmonic.no_order(a, SPEC)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in text and text.index("Join") < text.index("REPARTITION_BY_COL")
    rows = collections.defaultdict(list)
    for r in a.collect():
        rows[r.obs].append((r.birth, r.death, r.coefficient))
    for r in plan.collect():
        _, family, w0, w1 = SPEC[r.idx]
        z = [(c * (d - b) if family.startswith("weighted") else c) * np.exp(1j * (w0 * b + w1 * d)) for b, d, c in rows[r.obs]]
        want = sum(x * np.conj(y) for i, x in enumerate(z) for j, y in enumerate(z) if i != j) if "relationship" in family else sum(z)
        assert abs(complex(r.re, r.im) - want) < 1e-6 * max(1, abs(want))


def test_crossed_features_share_a_sweep(monkeypatch):
    """One sweep for all features of two observations, over several blocks; ties and equal intervals."""
    rng = np.random.default_rng(4)
    sides = []
    for n in (700, 500):
        b = rng.integers(0, 9, n) / 9
        sides.append((b, b + rng.integers(1, 9, n) / 9, rng.integers(-2, 4, n).astype(float)))
    (sb, sd, sc), (tb, td, tc) = sides
    inside = (tb[:, None] <= sb[None]) & (sd[None] <= td[:, None]) & ((tb[:, None] != sb[None]) | (sd[None] != td[:, None]))
    pairs = [s for s in SPEC if "relationship" in s[1]]
    calls, later = [], harmonic.later_sums
    monkeypatch.setattr(harmonic, "later_sums", lambda *x: calls.append(1) or later(*x))
    got = harmonic.cross_sums(*sides, pairs)
    for z, (_, family, w0, w1) in zip(got, pairs, strict=True):
        s, t = ((sc * (sd - sb), tc * (td - tb)) if family.startswith("weighted") else (sc, tc))
        want = (t * np.exp(1j * (w0 * tb + w1 * td)) * (inside @ (s * np.exp(-1j * (w0 * sb + w1 * sd))))).sum()
        assert abs(z - want) < 1e-8 * max(1, abs(want))
    assert len(calls) == 1


@pytest.mark.parametrize("points, block", [(4096, 512), (16, 3)])
def test_nearest_takes_as_many_passes_for_many_diagrams_as_for_few(spark, monkeypatch, points, block):
    """Two searches, however many diagrams differ; blocks of one and of many, diagrams of more points than are tried by sets, and a batch without a second diagram."""
    monkeypatch.setattr(transport, "POINTS", points, raising=False)
    monkeypatch.setattr(transport, "BLOCK", block, raising=False)
    rng = np.random.default_rng(3)
    made, keep = [], transport.Stages.keep
    monkeypatch.setattr(transport.Stages, "keep", lambda self, df: made.append(1) or keep(self, df))
    passes = []
    for n in (6, 70):
        rows = [(o, int(b) / 50, int(b + d) / 50, 1.0) for o in range(n) for b, d in {tuple(x) for x in rng.integers(1, 25, (1 + o % 11, 2)).tolist()}]
        of = {o: np.array([r[1:3] for r in rows if r[0] == o]) for o in range(n)}
        members = [(0, o) for o in range(n)] + [(1, 0)]
        made.clear()
        got = {(r.batch, r.obs): (r.other, r.w1) for r in transport.nearest(spark.createDataFrame(rows, "obs long, birth double, death double, coefficient double"), spark.createDataFrame(members, "batch int, obs long")).collect()}
        passes.append(len(made))
        for o in range(n):
            w, other = min((round(transport.w1(of[o], of[x]), 9), x) for x in range(n) if x != o)
            assert got[0, o] == (other, pytest.approx(w, abs=1e-8))
        assert len(got) == n
    assert passes[0] == passes[1]


def test_few_points_are_assigned_many_pairs_at_a_time():
    rng = np.random.default_rng(6)
    for n, m in ((1, 1), (1, 6), (3, 3), (4, 9), (7, 7)):
        p, q = (np.cumsum(rng.integers(1, 9, (40, k, 2)) / 10, axis=2) for k in (n, m))
        assert transport.few_points(p, q) == pytest.approx([transport.w1(x, y) for x, y in zip(p, q, strict=True)], abs=1e-9)


def test_triangles_are_found_once_for_their_sides(spark, monkeypatch):
    """What makes the edges runs once, and one search of triangles gives all three sides."""
    plans, keep = [], transport.Stages.keep
    monkeypatch.setattr(transport.Stages, "keep", lambda self, df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(self, df))
    rows = spark.range(40).select(F.lit("a").alias("g"), (F.col("id") % 8).alias("u"), (8 + F.col("id") % 5).alias("v")).unionByName(spark.range(7).select(F.lit("a").alias("g"), F.col("id").alias("u"), (F.col("id") + 1).alias("v")))
    got = {(r.u, r.v): r.trussness for r in graph.trussness_spread(rows).collect()}
    assert got == {(r.u, r.v): r.trussness for r in graph.trussness_kernel(rows).collect()}
    assert sum("Range (" in p for p in plans) == 1 and plans[1].count("Generate") == 1

"""Invariants and definitions of the DataFrame operators that SQL does not cover."""
import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestflow.functions import seeds
from nestflow.operators import diagrams, evaluate, generate, graph, harmonic, homology, perturb, quality, sample, svm, transport, vectorize
from nestflow.plans import catalog, studies
from nestflow.plans.config import StudyConfig
from nestflow.sources import tables, tu
from nestflow.streaming import diagram_stream

ATOM = "obs long, birth double, death double, coefficient double"
EDGE = "g string, u long, v long, formation long, support long"


def random_edges(seed, n=14, p=0.4, g="g"):
    r = random.Random(seed)
    e = [(u, v) for u, v in itertools.combinations(range(n), 2) if r.random() < p]
    r.shuffle(e)
    return [(g, u, v, i, r.randint(1, 4)) for i, (u, v) in enumerate(e)]


@pytest.fixture(scope="module")
def atoms(spark):
    r = random.Random(1)
    keys = {(r.randint(0, 3), r.randint(0, 9) / 10, 1 + r.randint(1, 9) / 10) for _ in range(80)}
    return spark.createDataFrame([(*k, float(r.randint(1, 3))) for k in sorted(keys)], ATOM).cache()


def test_plans_of_relationships_agree(spark, atoms):
    spec = seeds.feature_spec(seeds.character_bank(5, 2), 16)
    a, b = ({(r.obs, r.idx): (r.re, r.im) for r in harmonic.coordinates(atoms, spec, s).collect()} for s in ("join", "kernel"))
    mixed = {(r.obs, r.idx): (r.re, r.im) for r in harmonic.coordinates(atoms, spec, "auto", most=20).collect()}
    assert a.keys() == b.keys() == mixed.keys()
    assert all(a[k] == pytest.approx(b[k], abs=1e-9) and a[k] == pytest.approx(mixed[k], abs=1e-9) for k in a)
    with pytest.raises(ValueError):
        harmonic.coordinates(atoms, spec, "other")


def test_nested_mass_is_at_most_half_of_all_pairs(atoms):
    s = {r.obs: r for r in harmonic.statistics(atoms).collect()}
    q = {r.obs: r.q for r in atoms.groupBy("obs").agg(F.sum(F.col("coefficient") ** 2).alias("q")).collect()}
    assert all(r.relationship_mass <= (r.mass**2 - q[o]) / 2 + 1e-9 for o, r in s.items())


def test_empty_observations(spark, atoms):
    spec = seeds.feature_spec(seeds.character_bank(3, 2), 8)
    every = spark.createDataFrame([(0,), (99,)], "obs long")
    z = harmonic.with_empty(harmonic.coordinates(atoms, spec), every, spec)
    assert [(r.re, r.im) for r in z.where("obs = 99").collect()] == [(0.0, 0.0)] * 8
    m = harmonic.batch_mean(z, every.withColumn("batch", F.lit(1)))
    one = {r.idx: r.re for r in z.where("obs = 0").collect()}
    assert {r.idx: r.re for r in m.collect()} == pytest.approx({k: x / 2 for k, x in one.items()})
    assert diagrams.add(atoms, diagrams.scale(atoms, -1)).count() == 0
    assert diagrams.clean(spark.createDataFrame([(1, 0.3, 0.3, 1.0), (1, 0.1, 0.2, 1e-13), (1, 0.1, 0.2, 1.0)], ATOM)).count() == 1


def test_cliques_and_trussness(spark):
    rows = [x for i in range(3) for x in random_edges(i, g=f"g{i}")]
    e = spark.createDataFrame(rows, EDGE)
    got = {(r.g, r.u, r.v): r.trussness for r in graph.trussness(e).collect()}
    for g in ("g0", "g1", "g2"):
        pairs = {(u, v) for h, u, v, *_ in rows if h == g}
        k, level = 2, {}
        while pairs:
            level.update(dict.fromkeys(pairs, k))
            k += 1
            live = set(pairs)
            while True:
                near = {}
                for u, v in live:
                    near.setdefault(u, set()).add(v)
                    near.setdefault(v, set()).add(u)
                weak = {(u, v) for u, v in live if len(near[u] & near[v]) < k - 2}
                if not weak:
                    break
                live -= weak
            pairs = live
        assert level == {(u, v): t for (h, u, v), t in got.items() if h == g}
    tri = {(r.g, r.a, r.b, r.c) for r in graph.triangles(e).collect()}
    have = {(g, u, v) for g, u, v, *_ in rows}
    assert tri == {(g, a, b, c) for g in ("g0", "g1", "g2") for a, b, c in itertools.combinations(range(14), 3) if {(g, a, b), (g, a, c), (g, b, c)} <= have}
    f = studies.cohesion_filtered(e)
    assert f.count() == len(rows) and f.agg(F.max("time")).first()[0] < 1.0
    count = homology.class_count(e)
    d = homology.h1(graph.clique_complex(graph.rank_filtration(e)), drop_empty=False).groupBy("obs").agg(F.sum("coefficient"))
    assert {r.g: r.classes for r in count.collect()} == {r[0]: int(r[1]) for r in d.collect()}


def test_cohesion_times_by_hand(spark):
    """A clique of four with a tail of two edges: its six edges have trussness 4, and of the tail the inner edge, whose ends allow a common neighbour, is weaker than the outer one. So levels 1, 2, 3 come at 1/4, 2/4, 3/4."""
    e = spark.createDataFrame([("k", u, v, i, 1) for i, (u, v) in enumerate([(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3), (3, 4), (4, 5)])], EDGE)
    got = {(r.u, r.v): (r.step, r.time) for r in studies.cohesion_filtered(e).collect()}
    # clique edges: 2 common of 2 allowed, or of 2 by the end of lower degree; (4, 5) has 0 allowed, which counts as 1; (3, 4) has 0 of 1
    assert got == {**{(u, v): (1, 0.25) for u in range(4) for v in range(u + 1, 4)}, (4, 5): (2, 0.5), (3, 4): (3, 0.75)}
    # an essential class born at the last level keeps a length
    square = spark.createDataFrame([("s", 0, 1, 0, 1), ("s", 1, 2, 1, 1), ("s", 2, 3, 2, 1), ("s", 0, 3, 3, 1)], EDGE)
    assert [(r.birth, r.death) for r in homology.h1(graph.clique_complex(studies.cohesion_filtered(square))).collect()] == [(0.5, 1.0)]


def test_canonical_edges_and_statistics(spark):
    e = spark.createDataFrame([("g", 2, 1, 5, 1), ("g", 1, 2, 3, 7), ("g", 4, 4, 0, 1), ("h", 1, 2, 0, 2)], EDGE)
    assert sorted(map(tuple, graph.canonical(e).collect())) == [("g", 1, 2, 3, 7), ("h", 1, 2, 0, 2)]
    s = graph.graph_statistics(graph.canonical(e), spark.createDataFrame([("g", 4), ("z", 1)], "g string, n int"))
    got = {r.g: r for r in s.collect()}
    assert got["g"].density == pytest.approx(1 / 6) and got["g"].mean_degree == 0.5 and (got["z"].density, got["z"].edges) == (0.0, 0)


@pytest.mark.parametrize("model", sorted(catalog._MODELS))
def test_generated_graphs_are_simple_and_repeatable(spark, model):
    r = studies.requests(spark, model, 30, 60, {k: float(v) for k, v in catalog._MODELS[model].items()}, 2, 5)
    e = generate.generate(r).toPandas()
    assert not e.duplicated(["g", "u", "v"]).any() and (e.u < e.v).all() and e.v.max() < 30
    want = {"barabasi_albert": 10 + 25 * 2, "kleinberg": 49 + 11}.get(model, 60)
    assert (e.groupby("g").size() == want).all() and not e.duplicated(["g", "formation"]).any()
    pd.testing.assert_frame_equal(e, generate.generate(r).toPandas())
    if model == "configuration":
        assert (pd.concat([e[["g", "u"]].rename(columns={"u": "x"}), e[["g", "v"]].rename(columns={"v": "x"})]).groupby(["g", "x"]).size() == 4).all()


def test_perturbations(spark):
    e = graph.rank_filtration(spark.createDataFrame(random_edges(4, 10, 0.5), EDGE)).select("g", "u", "v", "step", "time")
    n = e.count()
    assert perturb.delete_edges(e, 0.3, perturb.draw(1, "u", "v")).count() == n - int(0.3 * n)
    pairs = graph.dyads(spark.createDataFrame([("g", 10)], "g string, n int"))
    more = perturb.insert_edges(e, pairs, 0.3, perturb.draw(2, "u", "v"), perturb.draw(3, "u", "v"))
    assert more.count() == n + int(0.3 * n) == more.select("u", "v").distinct().count()
    swapped = perturb.swap_edges(e, 0.3, 9)
    deg = lambda d: sorted(map(tuple, graph.degrees(d).collect()))
    assert deg(swapped) == deg(e) and swapped.join(e, ["u", "v"], "left_semi").count() < n == swapped.select("u", "v").distinct().count()
    j = perturb.jitter(e, 0.1, perturb.normal(4, "u", "v"))
    assert j.where("time between 0 and 1").count() == n and j.agg(F.max("step")).first()[0] <= n
    z = spark.range(20_000).select(perturb.normal(5, "id").alias("z")).agg(F.avg("z"), F.stddev("z")).first()
    assert abs(z[0]) < 0.03 and abs(z[1] - 1) < 0.03


def test_distances_between_tables(spark, atoms):
    p = spark.createDataFrame([(0, 1), (1, 0), (2, 2), (3, 77)], "first long, second long")
    w = {(r.first, r.second): r.w1 for r in transport.diagram_distance(atoms, p).collect()}
    assert w[0, 1] == pytest.approx(w[1, 0]) and w[2, 2] == pytest.approx(0) and w[3, 77] > 0
    a = diagrams.second_order(atoms.where("obs = 0")).limit(12)
    gone = transport.signed_distance(diagrams.second_order(atoms.where("obs = 0")).limit(12).withColumn("coefficient", F.lit(0.0)).unionByName(a.withColumn("coefficient", F.lit(1.0)))).first()
    assert gone.w1 > 0


def test_vectors(spark, atoms):
    box = vectorize.fit_image(spark.createDataFrame([(1, 0.0, 1.0, 1.0), (1, 0.0, 2.0, 1.0)], ATOM), 0.5)
    assert box == (-0.5, 0.5, 1.0, 2.0)
    every = spark.createDataFrame([(0,), (99,)], "obs long")
    z = vectorize.landscape(atoms, every, 2, vectorize.landscape_grid(*vectorize.fit_range(atoms), 5))
    assert z.count() == 20 and z.where("obs = 99").agg(F.sum("value")).first()[0] == 0
    assert z.groupBy("obs", "point").pivot("layer").agg(F.first("value")).where("`1` < `2`").count() == 0
    assert len(vectorize.landscape_names(2, 5)) == 10 and len(vectorize.image_names(3, 4)) == 12
    top = vectorize.forward(atoms, [vectorize.layer_landscape(1.0)], vectorize.weight_mixture([(0.5, 1.5, 1.0, 1.0)]), "topk", 3)
    assert top.groupBy("obs").count().where("count <> 3").count() == 0
    g = vectorize.forward(atoms, [vectorize.layer_landscape(1.0)], vectorize.weight_grid([[1.0, 2.0], [3.0, 4.0]], ((0, 1), (1, 2))), "max")
    assert g.count() == 4


def test_folds_and_resamples(spark):
    s = spark.range(103).select("id", (F.col("id") % 4).alias("stratum"), (F.col("id") % 3).alias("label"))
    f = evaluate.stratified_folds(s, 5, seed=3)
    assert evaluate.fold_violations(f.select("id"), s).count() == 0
    n = f.groupBy("stratum", "fold").count().groupBy("stratum").agg(F.max("count") - F.min("count")).collect()
    assert all(r[1] <= 1 for r in n)
    inner = evaluate.nested_folds(s, 4, 3, seed=1)
    assert inner.where("inner_fold is null").groupBy("id").count().where("count <> 1").count() == 0
    assert evaluate.small_strata(s, 26).count() == 1
    for draw in (None, evaluate.shared_draw):
        r = evaluate.resampled_cells(s, ("stratum", "label"), 6, 1, draw=draw).groupBy("replicate", "stratum").agg(F.sum("times").alias("n"))
        assert sorted((x.replicate, x.stratum, x.n) for x in r.collect()) == [(i, k, n) for i in range(6) for k, n in ((0, 26), (1, 26), (2, 26), (3, 25))]


def test_draws_follow_the_shares(spark):
    """Of 400 replicates the mean number of times that each cell is drawn is its size, and its spread that of a binomial."""
    s = spark.range(200).select("id", F.lit("s").alias("stratum"), F.when(F.col("id") < 20, "a").when(F.col("id") < 100, "b").otherwise("c").alias("label"))
    for draw in (None, evaluate.shared_draw):
        t = evaluate.resampled_cells(s, ("label",), 400, 7, draw=draw).groupBy("label").agg((F.sum("times") / 400).alias("mean"), F.stddev("times").alias("sd"))
        for x in t.collect():
            n = {"a": 20, "b": 80, "c": 100}[x.label]
            assert x["mean"] == pytest.approx(n, abs=4 * (n * (1 - n / 200) / 400) ** 0.5) and x.sd == pytest.approx((n * (1 - n / 200)) ** 0.5, rel=0.25)


def test_bootstraps_by_hand(spark):
    """With every sample of one kind in each stratum no replicate differs, so all values are those observed."""
    rows = [(i, s, s, 0 if s == "x" else r, "x" if r == 0 or s == "x" else "y", "y") for i, s in enumerate("xxyy") for r in range(2)]
    p = spark.createDataFrame([(i, s, s, r, pred, second) for (i, s, _, _, pred, second), r in zip(rows, [0, 1] * 4)], "id int, stratum string, label string, realization int, prediction string, second string")
    got = {x.metric: x for x in evaluate.hierarchical_bootstrap(p, 300, 3).collect()}
    # realization 0 says x always, realization 1 is right; the second method says y always
    assert got["accuracy first"].observed == 0.75 and got["accuracy second"].observed == got["accuracy second"].lower == got["accuracy second"].upper == 0.5
    assert (got["accuracy first"].lower, got["accuracy first"].upper) == (0.5, 1.0) and got["accuracy first"]["mean"] == pytest.approx(0.75, abs=0.05)
    assert got["macro_f1 second"].observed == pytest.approx(1 / 3) and got["accuracy difference"].observed == 0.25
    one = p.where("realization = 1")
    assert {(x.metric, x.observed, x.lower, x.upper, x.sd) for x in evaluate.bootstrap(one, 50, 3).collect()} == {("accuracy", 1.0, 1.0, 1.0, 0.0), ("macro_f1", 1.0, 1.0, 1.0, 0.0)}
    assert {x.metric: x.observed for x in evaluate.paired_bootstrap(one, 50, 3).collect()}["accuracy difference"] == 0.5
    with pytest.raises(ValueError):
        evaluate.bootstrap(one.where("label = 'x'"), 5, 1)


def test_truss_plans_agree(spark):
    e = spark.createDataFrame([x for i in range(3) for x in random_edges(i, g=f"g{i}")], EDGE)
    of = lambda d: sorted(map(tuple, d.collect()))
    want = of(graph.trussness_kernel(e))
    assert of(graph.trussness_spread(e)) == want and of(graph.trussness(e, 30)) == want


def test_metrics_of_a_missing_prediction(spark):
    p = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "z")], "label string, prediction string")
    m = evaluate.metrics(p).first()
    assert m.accuracy == 0.5 and m.macro_f1 == pytest.approx((2 / 3 + 2 / 3 + 0) / 3)


def test_machine_over_folds(spark):
    r = random.Random(1)
    rows = [(i, i % 4, i % 2, [r.gauss(3 * (i % 2), 1), r.gauss(0, 1), 1.0]) for i in range(120)]
    got = svm.cross_validate(spark.createDataFrame(rows, "id long, fold int, label int, vector array<double>")).toPandas()
    assert len(got) == 120 and (got.label == got.prediction).mean() > 0.85


def test_checks(spark):
    df = spark.createDataFrame([(1, 0), (1, 2), (2, 0)], "k int, i int")
    assert sorted(map(tuple, quality.gaps(df, "i", "k").collect())) == [(1, 1, "missing"), (1, 2, "extra")]
    quality.require_columns(df, T.StructType([T.StructField("k", T.IntegerType()), T.StructField("i", T.IntegerType())]))
    with pytest.raises(ValueError):
        quality.require_columns(df, T.StructType([T.StructField("k", T.LongType())]))
    assert quality.wrong_version(df, 1, "k").count() == 1


def test_graph_files(spark, tmp_path):
    (tmp_path / "X_A.txt").write_text("1, 2\n2, 1\n2,3\n3, 3\n4, 5\n")
    (tmp_path / "X_graph_indicator.txt").write_text("1\n1\n1\n2\n2\n")
    (tmp_path / "X_graph_labels.txt").write_text("7\n-1\n")
    t = tu.read(spark, str(tmp_path), "X")
    assert sorted(map(tuple, t["edges"].select("g", "u", "v").collect())) == [(1, 0, 1), (1, 1, 2), (2, 0, 1)]
    assert sorted(map(tuple, t["graphs"].collect())) == [(1, 7, 3), (2, -1, 2)]
    assert tu.violations(spark, str(tmp_path), "X").count() == 0
    assert tu.count_differences(t["edges"], t["vertices"], spark.createDataFrame([(1, 3, 2), (2, 2, 2)], "g int, n long, m long")).count() == 1
    (tmp_path / "X_A.txt").write_text("1, 2, 3\n\n9, 1\n1, 4\n")
    assert sorted((r.line, r.why) for r in tu.violations(spark, str(tmp_path), "X").collect()) == [(1, "form"), (2, "blank"), (3, "vertex"), (4, "graphs")]


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c\nd', -0.0), (1, "x", 2.5)], "schema_version int, name string, value double")
    p = str(tmp_path / "csv")
    tables.write_csv(df, p)
    assert sorted(map(tuple, tables.read_csv(spark, p, df.schema, 1).collect())) == sorted([(1, 'a "b", c\nd', 0.0), (1, "x", 2.5)])
    with pytest.raises(ValueError):
        tables.read_csv(spark, p, df.schema, 2)
    u = spark.createDataFrame([("graph", 1, 3, 2, None, None, None, None), ("edge", 1, None, None, 0, 1, 1, 0.5), ("edge", 2, None, None, 0, 1, 1, 0.5)], "record_type string, g int, n int, edge_count long, u int, v int, step int, time double")
    assert sorted(r.g for r in tables.union_violations(u).collect()) == [1, 2]
    wide = tables.wide_fields(spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0)], "g int, field_name string, value double"), ["a", "b"])
    assert sorted(map(tuple, wide.collect())) == [(1, 1.0, 2.0), (2, 3.0, None)] and tables.long_fields(wide, ["a", "b"]).count() == 3
    k = spark.createDataFrame([(1,), (2,)], "k int")
    assert tables.without_keys(k, k.limit(1), "k").count() == 1 and tables.unfinished(k, k.where("k = 1"), "k").first().k == 2
    out = str(tmp_path / "r")
    tables.write_result(k, out, 3, "k")
    assert spark.read.parquet(out).columns == ["schema_version", "k"] and tables.checksums(spark, out + "/*.parquet").count() >= 1
    with pytest.raises(ValueError):
        tables.write_result(k.union(k), out, 3, "k")
    m = str(tmp_path / "m.json")
    tables.write_metadata(spark, m, {"status": "complete", "n": 1})
    assert tables.read_metadata(spark, m, ("n",)) == {"status": "complete", "n": 1}
    with pytest.raises(ValueError):
        tables.read_metadata(spark, m, ("other",))
    lay = tables.Layout("/x/")
    assert lay.claim("a", "one", "two.csv") == "/x/one/two.csv"
    for bad in (("b", "one"), ("c", "..", "y"), ("d", "one", "two.csv")):
        with pytest.raises(ValueError):
            lay.claim(*bad)
    g = tables.with_edges(spark.createDataFrame([(1,), (2,)], "g int"), spark.createDataFrame([(1, 0.1, 0.2, 1.0)], "g int, birth double, death double, coefficient double"))
    assert {r.g: len(r.diagram) for r in g.collect()} == {1: 1, 2: 0}


def test_task_plans(spark):
    t = studies.tasks(spark, {"a": [1, 2], "b": [5, 6, 7]})
    assert t.count() == 6 and studies.remaining(t, t.where("task < 2")).count() == 4


def test_stream_matches_batch(spark, atoms, tmp_path):
    timed = atoms.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.floor(F.col("birth") * 10)))
    timed.repartition(3).write.parquet(str(tmp_path / "in"))
    src = lambda: spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    want = {r.obs: r for r in harmonic.statistics(atoms).collect()}

    def drain(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    m = {r.obs: r for r in drain(diagram_stream.masses(src(), "1 day"), "m", "complete").collect()}
    assert {o: (r.support, r.mass) for o, r in m.items()} == {o: (r.support, r.mass) for o, r in want.items()}
    spec = [(0, "linear", 0.7, -0.3)]
    z = {r.obs: (r.re, r.im) for r in drain(diagram_stream.linear(src(), spec, "1 day"), "z", "complete").collect()}
    assert z == {r.obs: pytest.approx((r.re, r.im)) for r in harmonic.coordinates(atoms, spec).collect()}
    rel = drain(diagram_stream.relationship_mass(src(), "1 day"), "rel", "update").groupBy("obs").agg(F.max_by("relationship_mass", "support").alias("x"))
    assert {r.obs: r.x for r in rel.collect()} == {o: pytest.approx(r.relationship_mass) for o, r in want.items()}


def test_nested_machine_and_settings(spark):
    r = random.Random(2)
    rows = [(i, i % 2, [r.gauss(3 * (i % 2), 1), 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, label int, vector array<double>")
    f = evaluate.nested_folds(df.withColumn("stratum", F.col("label")), 3, 2, seed=1)
    got = svm.nested_cross_validate(f.join(df, "id"), (0.1, 1.0)).toPandas()
    assert sorted(got.id) == list(range(60)) and (got.label == got.prediction).mean() > 0.85 and set(got.cost) <= {0.1, 1.0}
    with pytest.raises(ValueError, match="edges"):
        StudyConfig(vertices=4, edges=7)


def test_weighted_pick_proportions(spark):
    w = spark.createDataFrame([(1, 0, 1.0), (1, 1, 0.0), (1, 2, 3.0)], "g int, i int, w double")
    d = spark.createDataFrame([(1, k, k / 8) for k in range(8)], "g int, draw long, u double")
    assert sorted((r.draw, r.i) for r in sample.weighted_pick(w, d).collect()) == [(k, 0 if k < 2 else 2) for k in range(8)]


def test_swaps_as_if_all_were_listed_anew(spark):
    """The kept list of admissible swaps gives the swaps that a new list before each would."""

    rows = [("g", u, v, float(i % 4), 1) for i, (_, u, v, *_) in enumerate(random_edges(4))]
    e = [(u, v) for _, u, v, *_ in sorted(rows, key=lambda r: (r[3], r[1], r[2]))]
    have, t = set(e), seeds.Twister(11)
    for _ in range(int(0.5 * len(e))):
        fit = []
        for i, j in itertools.combinations(range(len(e)), 2):
            (a, b), (c, d) = e[i], e[j]
            for x, y in (((a, c), (b, d)), ((a, d), (b, c))):
                p, q = tuple(sorted(x)), tuple(sorted(y))
                if len({a, b, c, d}) == 4 and p not in have and q not in have:
                    fit.append((i, j, p, q))
        if not fit:
            break
        i, j, p, q = fit[t.below(len(fit))]
        have = have - {e[i], e[j]} | {p, q}
        e[i], e[j] = p, q
    got = perturb.swap_edges(spark.createDataFrame([(g, u, v, x) for g, u, v, x, _ in rows], "g string, u long, v long, time double"), 0.5, 11)
    assert {(r.u, r.v) for r in got.collect()} == have


def test_text_collections(spark, tmp_path):
    """Numbers of lines over several blocks of a file, and lines that a strict reader refuses."""

    (tmp_path / "N_x.txt").write_text("\n".join(f"line {i}" for i in range(1, 5001)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        d = tu.numbered_lines(spark, str(tmp_path / "N_x.txt"))
        assert d.where("value <> concat('line ', line)").count() == 0 and d.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for part, text in (("A", "1, 2\n2, 1\n3\n1, 4\n"), ("graph_indicator", "1\n1\n2\n2\n"), ("graph_labels", "7\n8\n")):
        (tmp_path / f"T_{part}.txt").write_text(text)
    assert [tuple(r) for r in tu.read(spark, str(tmp_path), "T")["edges"].select("g", "u", "v", "formation").collect()] == [(1, 0, 1, 1)]
    with pytest.raises(ValueError):
        tu.read(spark, str(tmp_path), "T", strict=True)


def test_resumed_and_cut_csv(spark, tmp_path):

    df = spark.createDataFrame([(i, f'a "{i}", b\nc') for i in range(20)], "k int, x string")
    path = str(tmp_path / "out")
    assert tables.append_csv(df.where("k < 7"), path, "k").count() == 7
    assert tables.append_csv(df, path, "k").count() == 13 and tables.append_csv(df, path, "k").count() == 0
    assert sorted(map(tuple, tables.read_csv(spark, path, df.schema).collect())) == sorted(map(tuple, df.collect()))
    for name, text in (("whole", "k,x\n1,a\n"), ("cut", 'k,x\n1,"a'), ("short", "k,x\n1")):
        (tmp_path / f"{name}.csv").write_text(text)
    assert sorted(r.path.split("/")[-1] for r in tables.incomplete_tails(spark, str(tmp_path) + "/*.csv").collect()) == ["cut.csv", "short.csv"]


def test_partners_and_empty_batches(spark):
    m = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 4)], "batch int, obs int")
    assert sorted(map(tuple, harmonic.cyclic_partners(m).collect())) == [(1, 1, 2), (1, 2, 3), (1, 3, 1)]
    atoms = spark.createDataFrame([(1, 0.0, 1.0, 2.0), (1, 0.2, 0.4, 1.0), (2, 0.1, 0.9, 3.0), (2, 0.2, 0.4, 1.0), (3, 5.0, 6.0, 1.0)], ATOM)
    p, spec = harmonic.cyclic_partners(m).select("obs", "other"), [(0, "relationship_mass", 0.0, 0.0), (1, "weighted_relationship", 0.3, -0.7)]
    got = {(r.obs, r.idx): r.re for r in harmonic.cross_observation(atoms, p, spec).collect()}
    # of 1 only (.2, .4) lies inside one of 2, and is equal to the other; 2 has none in 3, 3 none in 1
    assert (got[1, 0], got[2, 0], got[3, 0]) == (3.0, 0.0, 0.0)
    big = {(r.obs, r.idx): r.re for r in harmonic.cross_observation(atoms, p, spec, most=0).collect()}
    assert big == {k: pytest.approx(v, abs=1e-12) for k, v in got.items()}
    z = harmonic.coordinates(atoms, spec)
    with pytest.raises(Exception, match="no features"):
        harmonic.batch_mean(z, m).collect()

"""Queries see every row, on tables large enough that a cap would show."""
import os

import duckdb
import pytest

from nestflow.operators import diagrams, graph, transport
from nestflow.plans import catalog
from nestflow.plans import fixtures as fx
from nestflow.plans import studies

from .test_queries import TABLES, cell

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["clique_complex", "h1_class_count", "union_records"])
def test_whole_graphs(spark, name):
    """The rows of the registered SQL, which reads whole tables too."""
    assert "formation <=" not in catalog.ORACLE[name]
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.sql(catalog.ORACLE[name])
    df = catalog.QUERIES[name](spark, SF)
    at = [rel.columns.index(c) for c in df.columns]
    got = sorted((tuple(map(cell, r)) for r in df.collect()), key=str)
    assert got == sorted((tuple(cell(r[i]) for i in at) for r in rel.fetchall()), key=str)


def test_whole_persistence(spark):
    """Against the textbook reduction of the whole matrix, without union-find."""
    e = graph.rank_filtration(fx.edges(spark, SF).where("g = 'click'"))
    rows = [(tuple(r["vertices"]), r["filtration"]) for r in graph.clique_complex(e).orderBy("place").collect()]
    at, lows, paired, want = {v: i for i, (v, _) in enumerate(rows)}, {}, set(), {}
    for i, (v, f) in enumerate(rows):
        col = {at[v[:k] + v[k + 1 :]] for k in range(len(v))} if len(v) > 1 else set()
        while col and max(col) in lows:
            col ^= lows[max(col)]
        if col:
            lows[max(col)] = col
            paired |= {i, max(col)}
            if len(v) == 3 and rows[max(col)][1] < f:
                key = (round(rows[max(col)][1], 6), round(f, 6))
                want[key] = want.get(key, 0) + 1
    for i, (v, f) in enumerate(rows):
        if len(v) == 2 and i not in paired and f < 1:
            want[round(f, 6), 1.0] = want.get((round(f, 6), 1.0), 0) + 1
    got = catalog.QUERIES["h1_persistence"](spark, SF).where("obs = 'click'").collect()
    assert {(r["birth"], r["death"]): r["coefficient"] for r in got} == want


def test_whole_cohesion(spark):
    """The coordinates are those of the whole graphs."""
    want = studies.interval_features(studies.cohesion_filtered(fx.edges(spark, SF)), catalog.SPEC).collect()
    got = catalog.QUERIES["clique_cohesion_graphs"](spark, SF).collect()
    of = lambda rows: {(r["obs"], r["idx"]): pytest.approx((r["re"], r["im"]), abs=2e-6) for r in rows}
    assert len(got) == len(want) == 5 * len(catalog.SPEC)
    assert {(r["obs"], r["idx"]): (r["re"], r["im"]) for r in got} == of(want)


def test_whole_transport(spark):
    """w1 of two whole diagrams against an assignment of all their points; short intervals count too."""
    a = fx.atoms(spark, "/root/testdata/sf0.001").where("obs IN (1, 2)").toPandas()
    p, q = (transport.expand(x[["birth", "death"]].to_numpy(float), x["coefficient"].to_numpy()) for x in (a[a["obs"] == 1], a[a["obs"] == 2]))
    want, _ = transport.assignment(transport.square_costs(transport.far(p, q), transport.half(p), transport.half(q)))
    got = catalog.QUERIES["w1_pd1"](spark, "/root/testdata/sf0.001").where("first = 1 AND second = 2").collect()
    assert [r["w1"] for r in got] == [pytest.approx(want, abs=1e-5)]


def test_pruned_transport(spark):
    """Points that two diagrams share change nothing."""
    a = diagrams.prune(fx.atoms(spark, "/root/testdata/sf0.001"), 0.45).toPandas()
    of = {k: transport.expand(x[["birth", "death"]].to_numpy(float), x["coefficient"].to_numpy()) for k, x in a.groupby("obs")}
    shared = 0
    for k in sorted(of)[:-1]:
        p, q = of[k], of[k + 1]
        shared += len(p) - len(transport.apart(p, q)[0])
        want, _ = transport.assignment(transport.square_costs(transport.far(p, q), transport.half(p), transport.half(q)))
        assert transport.w1(p, q) == pytest.approx(want, abs=1e-9)
    assert shared


def test_swaps_in_every_graph(spark):
    """Swaps keep the number of edges, in all nations' graphs."""
    _, e = catalog._local(spark, SF)
    got = catalog.QUERIES["edge_swaps"](spark, SF)
    count = lambda d: {r["g"]: r["count"] for r in d.groupBy("g").count().collect()}
    assert count(got) == count(e)
    assert max(count(got)) == 24

"""The engine's queries over the test tables, each with the SQL of the same result where SQL can say it. Every query reads whole tables.

Computed doubles are rounded to six places on both sides.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions import seeds
from ..functions.expressions import r6
from ..operators import diagrams, evaluate, generate, graph, harmonic, homology, perturb, quality, sample, svm, transport, vectorize
from ..sources import records, tables, tu
from . import fixtures as fx
from . import studies
from .config import StudyConfig

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SPEC = seeds.feature_spec(fx.BANK, fx.FEATURES)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(F.col(c)) for c in cols})


def _values(spec: list[tuple]) -> str:
    return "spec(idx, family, w0, w1) AS (VALUES " + ", ".join(f"({i}, '{f}', {a!r}::DOUBLE, {b!r}::DOUBLE)" for i, f, a, b in spec) + ")"


A, B, E, L = "WITH " + fx.ATOMS_SQL, "WITH " + fx.ATOMS_SQL + ", " + fx.BATCHES_SQL, "WITH " + fx.EDGES_SQL, "WITH " + fx.LABELS_SQL
_NESTED = "t.birth <= s.birth AND s.death <= t.death AND (s.birth <> t.birth OR s.death <> t.death)"

# ---- diagrams


@query(f"""{A}, own AS (SELECT obs, count(*) AS support, sum(coefficient) AS mass, round(sum(coefficient * (death - birth)), 6) AS weighted_mass FROM atoms GROUP BY 1),
pair AS (SELECT s.obs, sum(s.coefficient * t.coefficient) AS m, round(sum(s.coefficient * t.coefficient * (s.death - s.birth) * (t.death - t.birth)), 6) AS w FROM atoms s JOIN atoms t ON s.obs = t.obs AND {_NESTED} GROUP BY 1)
SELECT obs, support, mass, weighted_mass, coalesce(m, 0) AS relationship_mass, coalesce(w, 0) AS weighted_relationship_mass FROM own LEFT JOIN pair USING (obs)""")
def diagram_stats(spark, sf):
    return _round(harmonic.statistics(fx.atoms(spark, sf)), "mass", "weighted_mass", "relationship_mass", "weighted_relationship_mass")


@query(f"{A} SELECT obs, count(*) AS support, sum(coefficient) AS mass, sum(abs(coefficient)) AS absolute_mass, count(*) = 0 AS is_zero FROM atoms GROUP BY 1")
def diagram_totals(spark, sf):
    return diagrams.totals(fx.atoms(spark, sf))


@query(f"{A} SELECT obs, birth, round(death, 6) AS death, sum(c) AS coefficient FROM (SELECT obs, birth, death, coefficient AS c FROM atoms UNION ALL SELECT obs, birth, death, 2 * coefficient FROM atoms WHERE birth >= 0.05) GROUP BY obs, birth, death HAVING abs(sum(c)) > 1e-12")
def diagram_add(spark, sf):
    a = fx.atoms(spark, sf)
    return _round(diagrams.add(a, diagrams.scale(a.where("birth >= 0.05"), 2)), "death")


@query(f"{A} SELECT obs, birth, round(death, 6) AS death, sum(c) AS coefficient FROM (SELECT obs, birth, death, coefficient AS c FROM atoms UNION ALL SELECT obs, birth, death, -coefficient FROM atoms WHERE birth >= 0.05) GROUP BY obs, birth, death HAVING abs(sum(c)) > 1e-12")
def diagram_subtract(spark, sf):
    a = fx.atoms(spark, sf)
    return _round(diagrams.subtract(a, a.where("birth >= 0.05")), "death")


@query(f"{A} SELECT obs, birth, round(death, 6) AS death, coefficient * -1.5 AS coefficient FROM atoms")
def diagram_scale(spark, sf):
    return _round(diagrams.scale(fx.atoms(spark, sf), -1.5), "death")


@query(f"{A} SELECT obs, birth, round(death, 6) AS death, coefficient FROM atoms WHERE death - birth >= 0.25")
def diagram_prune(spark, sf):
    return _round(diagrams.prune(fx.atoms(spark, sf), 0.25), "death")


@query(f"{A} SELECT obs, birth, round(death, 6) AS death, coefficient - 1 AS coefficient FROM atoms WHERE abs(coefficient - 1) > 1e-12 AND birth <> death")
def diagram_clean(spark, sf):
    return _round(diagrams.clean(fx.atoms(spark, sf).withColumn("coefficient", F.col("coefficient") - 1)), "death")


@query(f"{A} SELECT obs, birth, round(death, 6) AS death, CAST(unnest(range(1, CAST(coefficient AS INT) + 1)) AS INT) AS copy FROM atoms")
def expand_multiplicity(spark, sf):
    return _round(diagrams.expand(fx.atoms(spark, sf)), "death")


@query(f"{A} SELECT s.obs, count(*) AS pairs, sum(s.coefficient * t.coefficient) AS mass, round(sum(s.birth + 2 * s.death + 3 * t.birth + 5 * t.death), 4) AS trace FROM atoms s JOIN atoms t ON s.obs = t.obs AND {_NESTED} GROUP BY 1")
def order2_pairs(spark, sf):
    """All pairs are made; the digest of each observation keeps the result small."""
    p = diagrams.second_order(fx.atoms(spark, sf))
    trace = F.col("left_birth") + 2 * F.col("left_death") + 3 * F.col("right_birth") + 5 * F.col("right_death")
    return p.groupBy("obs").agg(F.count("*").alias("pairs"), F.sum("coefficient").alias("mass"), (F.round(F.sum(trace), 4) + 0.0).alias("trace"))


@query(f"{A} SELECT obs, birth, round(death, 6) AS death, coefficient, CAST(row_number() OVER (PARTITION BY obs ORDER BY birth, atoms.death) - 1 AS INT) AS place FROM atoms")
def canonical_diagram(spark, sf):
    return _round(diagrams.canonical(fx.atoms(spark, sf)), "death")


@query(f"{A} SELECT obs, birth, round(death, 6) AS death, coefficient, 'not before' AS why FROM (SELECT obs, birth, death - 0.1 AS death, coefficient FROM atoms) WHERE birth >= death")
def diagram_violations(spark, sf):
    return _round(diagrams.violations(fx.atoms(spark, sf).withColumn("death", F.col("death") - 0.1)), "death")


_PQ = """p AS (SELECT obs, birth AS b, death AS d, row_number() OVER (PARTITION BY obs ORDER BY birth, death) AS k FROM atoms)"""


def _neighbours(spark, sf):
    """Each interval beside the next of its observation, and the two after that."""
    p = diagrams.canonical(fx.atoms(spark, sf)).select("obs", F.col("birth").alias("b"), F.col("death").alias("d"), F.col("place").alias("k"))
    out = p.select("obs", "k", F.col("b").alias("b1"), F.col("d").alias("d1"))
    for i in (2, 3, 4):
        out = out.join(p.select("obs", (F.col("k") - i + 1).alias("k"), F.col("b").alias(f"b{i}"), F.col("d").alias(f"d{i}")), ["obs", "k"])
    return out


_NEXT = A + ", " + _PQ + ", n AS (SELECT p.obs, p.k - 1 AS k, p.b AS b1, p.d AS d1, q.b AS b2, q.d AS d2, r.b AS b3, r.d AS d3, s.b AS b4, s.d AS d4 FROM p JOIN p q ON p.obs = q.obs AND q.k = p.k + 1 JOIN p r ON p.obs = r.obs AND r.k = p.k + 2 JOIN p s ON p.obs = s.obs AND s.k = p.k + 3)"


def _sql_far(i, j):
    return f"greatest(abs(b{i} - b{j}), abs(d{i} - d{j}))"


def _sql_based(i, j):
    return f"least({_sql_far(i, j)}, (d{i} - b{i}) / 2 + (d{j} - b{j}) / 2)"


_SQL_PRODUCT, _SQL_ZERO = f"({_sql_based(1, 3)} + {_sql_based(2, 4)})", f"({_sql_based(1, 2)} + {_sql_based(3, 4)})"


@query(f"{_NEXT} SELECT obs, CAST(k AS INT) AS k, round({_sql_far(1, 2)}, 6) AS far, round((d1 - b1) / 2, 6) AS diagonal, round({_sql_based(1, 2)}, 6) AS based, round(least({_SQL_PRODUCT}, {_SQL_ZERO}), 6) AS pair_based, round({_sql_based(1, 2)}, 6) AS pair_zero FROM n")
def atom_distances(spark, sf):
    c = {i: (F.col(f"b{i}"), F.col(f"d{i}")) for i in (1, 2, 3, 4)}
    p = {"lb": c[1][0], "ld": c[1][1], "rb": c[2][0], "rd": c[2][1]}
    q = {"lb": c[3][0], "ld": c[3][1], "rb": c[4][0], "rd": c[4][1]}
    return _neighbours(spark, sf).select("obs", "k", r6(X.chebyshev(*c[1], *c[2])).alias("far"), r6(X.to_diagonal(*c[1])).alias("diagonal"), r6(X.based(*c[1], *c[2])).alias("based"), r6(X.pair_based(p, q)).alias("pair_based"), r6(X.pair_to_diagonal(p)).alias("pair_zero"))


@query(f"{_NEXT} SELECT obs, CAST(k AS INT) AS k, (b2 <= b1 AND d1 <= d2) AS inside, (b2 <= b1 AND d1 <= d2 AND b1 <= b2 AND d2 <= d1) AS same, (b1 <= b3 AND d3 <= d1 AND b4 <= b2 AND d2 <= d4) AS before FROM n")
def preorders(spark, sf):
    c = [F.col(x) for x in ("b1", "d1", "b2", "d2", "b3", "d3", "b4", "d4")]
    p, q = dict(zip(("lb", "ld", "rb", "rd"), c[:4], strict=True)), dict(zip(("lb", "ld", "rb", "rd"), c[4:], strict=True))
    return _neighbours(spark, sf).select("obs", "k", X.nested(*c[:4]).alias("inside"), X.equivalent(*c[:4]).alias("same"), X.pair_precedes(p, q).alias("before"))


# ---- harmonic coordinates

_SINGLE = "SELECT obs, idx, {re} AS re, {im} AS im FROM atoms, spec WHERE family IN ({f}) GROUP BY obs, idx"
_COEF = "CASE WHEN family LIKE 'weighted%' THEN coefficient * (death - birth) ELSE coefficient END"
_OWN = f"SELECT obs, idx, sum({_COEF} * cos(w0 * birth + w1 * death)) AS re, sum({_COEF} * sin(w0 * birth + w1 * death)) AS im FROM atoms, spec WHERE family NOT LIKE '%relationship%' GROUP BY obs, idx"
_PCOEF = "s.coefficient * t.coefficient * CASE WHEN family LIKE 'weighted%' THEN (s.death - s.birth) * (t.death - t.birth) ELSE 1 END"
_PARG = "w0 * (t.birth - s.birth) + w1 * (t.death - s.death)"
_PAIR = f"SELECT s.obs, idx, sum({_PCOEF} * cos({_PARG})) AS re, sum({_PCOEF} * sin({_PARG})) AS im FROM atoms s JOIN atoms t ON s.obs = t.obs AND {_NESTED}, spec WHERE family LIKE '%relationship%' GROUP BY s.obs, idx"
_ALL = f"z AS ({_OWN} UNION ALL {_PAIR}), f AS (SELECT o.obs, spec.idx, coalesce(re, 0) AS re, coalesce(im, 0) AS im FROM (SELECT DISTINCT obs FROM atoms) o CROSS JOIN spec LEFT JOIN z ON z.obs = o.obs AND z.idx = spec.idx)"
_OUT = "SELECT obs, CAST(idx AS INT) AS idx, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM f"


def _family(name: str):
    own = [(i, *x[1:]) for i, x in enumerate([s for s in SPEC if s[1] == name])]

    def run(spark, sf):
        return _round(harmonic.coordinates(fx.atoms(spark, sf), own), "re", "im")

    return run, f"{A}, {_values(own)}, {_ALL} {_OUT}"


for _n in seeds.FAMILIES:
    QUERIES["ha_" + _n], ORACLE["ha_" + _n] = _family(_n)


@query(f"{A}, {_values(SPEC)}, {_ALL} {_OUT}")
def ha_features(spark, sf):
    return _round(harmonic.coordinates(fx.atoms(spark, sf), SPEC), "re", "im")


@query(f"{B}, {_values(SPEC)}, {_ALL} SELECT batch, CAST(idx AS INT) AS idx, round(avg(re), 6) + 0.0 AS re, round(avg(im), 6) + 0.0 AS im FROM batches JOIN f USING (obs) GROUP BY 1, 2")
def ha_batch_mean(spark, sf):
    z = harmonic.with_empty(harmonic.coordinates(fx.atoms(spark, sf), SPEC), fx.batches(spark, sf), SPEC)
    return _round(harmonic.batch_mean(z, fx.batches(spark, sf)), "re", "im")


_LIN = seeds.linear_spec(fx.BANK, 10)


@query(f"{B}, {_values(_LIN)}, f AS ({_OWN}), k AS (SELECT batch, obs, row_number() OVER (PARTITION BY batch ORDER BY obs) AS place FROM batches), n AS (SELECT unnest([1, 2, 4]) AS size) SELECT batch, CAST(size AS INT) AS size, CAST(idx AS INT) AS idx, round(avg(re), 6) + 0.0 AS re, round(avg(im), 6) + 0.0 AS im FROM k JOIN n ON place <= size JOIN f USING (obs) GROUP BY 1, 2, 3")
def batch_size_means(spark, sf):
    z = harmonic.coordinates(fx.atoms(spark, sf), _LIN)
    return _round(harmonic.by_prefix(z, fx.batches(spark, sf), [1, 2, 4]), "re", "im")


@query(f"{A}, {_values(_LIN)}, f AS ({_OWN}) {_OUT}")
def ablation_linear(spark, sf):
    return _round(harmonic.coordinates(fx.atoms(spark, sf), _LIN), "re", "im")


@query(f"""{A}, {_values(SPEC)}, q AS (SELECT obs, idx, family, sum({_COEF} * cos(w0 * birth + w1 * death)) AS x, sum({_COEF} * sin(w0 * birth + w1 * death)) AS y, sum(({_COEF}) * ({_COEF})) AS q FROM atoms, spec GROUP BY ALL),
f AS (SELECT obs, idx, CASE WHEN family LIKE '%relationship%' THEN x * x + y * y - q ELSE x END AS re, CASE WHEN family LIKE '%relationship%' THEN 0 ELSE y END AS im FROM q) SELECT obs, CAST(idx AS INT) AS idx, round(re, 4) + 0.0 AS re, round(im, 4) + 0.0 AS im FROM f""")
def ablation_no_preorder(spark, sf):
    return harmonic.no_order(fx.atoms(spark, sf), SPEC).withColumns({c: F.round(c, 4) + F.lit(0.0) for c in ("re", "im")})


_CROSS = [s for s in SPEC if s[1] in ("linear", "mass", "relationship", "relationship_mass")]


_CROSS_SQL = f"own AS ({_OWN}), crossed AS (SELECT m.obs, idx, sum({_PCOEF} * cos({_PARG})) AS re, sum({_PCOEF} * sin({_PARG})) AS im FROM m JOIN atoms s ON s.obs = m.obs JOIN atoms t ON t.obs = m.other AND {_NESTED}, spec WHERE family LIKE '%relationship%' GROUP BY m.obs, idx), f AS (SELECT own.* FROM own SEMI JOIN m USING (obs) UNION ALL SELECT m.obs, spec.idx, coalesce(re, 0), coalesce(im, 0) FROM m CROSS JOIN spec LEFT JOIN crossed ON crossed.obs = m.obs AND crossed.idx = spec.idx WHERE family LIKE '%relationship%')"


@query(f"{A}, {_values(_CROSS)}, o AS (SELECT DISTINCT obs FROM atoms), m AS (SELECT obs, coalesce(lead(obs) OVER (ORDER BY obs), min(obs) OVER ()) AS other FROM o), {_CROSS_SQL} {_OUT}")
def ablation_cross_observation(spark, sf):
    a = fx.atoms(spark, sf)
    return _round(harmonic.cross_observation(a, _partners(a), _CROSS), "re", "im")


@query(f"{B}, {_values(_CROSS)}, o AS (SELECT batch, obs, count(*) OVER (PARTITION BY batch) AS n FROM batches SEMI JOIN atoms USING (obs)), m AS (SELECT batch, obs, coalesce(lead(obs) OVER (PARTITION BY batch ORDER BY obs), min(obs) OVER (PARTITION BY batch)) AS other FROM o WHERE n > 1), {_CROSS_SQL} SELECT batch, CAST(idx AS INT) AS idx, round(avg(re), 6) + 0.0 AS re, round(avg(im), 6) + 0.0 AS im FROM m JOIN f USING (obs) GROUP BY 1, 2")
def ablation_cross_batch(spark, sf):
    """Partners within a batch, and the batch's mean."""
    a = fx.atoms(spark, sf)
    members = fx.batches(spark, sf).join(a.select("obs").distinct(), "obs", "left_semi")
    m = harmonic.cyclic_partners(members)
    return _round(harmonic.batch_mean(harmonic.cross_observation(a, m.select("obs", "other"), _CROSS), m.select("batch", "obs")), "re", "im")


_SPANS = "spans AS (SELECT o_orderpriority AS obs, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) / 2500 AS birth, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) / 2500 + round(o_totalprice) / 1000000 AS death, CAST(count(*) AS DOUBLE) AS coefficient FROM orders GROUP BY 1, 2, 3)"
_WIDE = [(0, "relationship_mass", 0.0, 0.0), (1, "relationship", 1.5, -2.5), (2, "weighted_relationship", 0.75, 3.25), (3, "weighted_linear", 1.25, 0.5)]


def _wide_sql() -> str:
    s, t = "s.coefficient * t.coefficient", "(s.death - s.birth) * (t.death - t.birth)"
    arg = lambda a, b: f"{a}::DOUBLE * (t.birth - s.birth) + {b}::DOUBLE * (t.death - s.death)"
    pair = f"SELECT s.obs, sum({s}) AS m, sum({s} * cos({arg(1.5, -2.5)})) AS r1, sum({s} * sin({arg(1.5, -2.5)})) AS i1, sum({s} * {t} * cos({arg(0.75, 3.25)})) AS r2, sum({s} * {t} * sin({arg(0.75, 3.25)})) AS i2 FROM spans s JOIN spans t ON s.obs = t.obs AND {_NESTED} GROUP BY 1"
    own = "SELECT obs, sum(coefficient * (death - birth) * cos(1.25::DOUBLE * birth + 0.5::DOUBLE * death)) AS re, sum(coefficient * (death - birth) * sin(1.25::DOUBLE * birth + 0.5::DOUBLE * death)) AS im FROM spans GROUP BY 1"
    rows = "SELECT obs, 0 AS idx, m AS re, 0.0 AS im FROM pair UNION ALL SELECT obs, 1, r1, i1 FROM pair UNION ALL SELECT obs, 2, r2, i2 FROM pair UNION ALL SELECT obs, 3, re, im FROM own"
    return f"WITH {_SPANS}, pair AS ({pair}), own AS ({own}) SELECT obs, CAST(idx AS INT) AS idx, round(re, 3) + 0.0 AS re, round(im, 3) + 0.0 AS im FROM ({rows})"


@query(_wide_sql())
def ha_relationship_by_ranges(spark, sf):
    """Observations of many intervals, an order being one from its day on, by the plan for those that no task holds."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")) / 2500
    o = fx.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("obs"), day.alias("birth"), (day + F.round("o_totalprice") / 1000000).alias("death")).agg(F.count("*").cast("double").alias("coefficient"))
    z = harmonic.coordinates(o, _WIDE, "ranges", rows=2000)
    return z.withColumns({c: F.round(c, 3) + 0.0 for c in ("re", "im")})


def _partners(a: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    o = a.select("obs").distinct()
    w = Window.orderBy("obs")
    return o.select("obs", F.coalesce(F.lead("obs").over(w), F.min("obs").over(Window.partitionBy())).alias("other"))


@query(f"{A}, o AS (SELECT DISTINCT obs FROM atoms), m AS (SELECT obs, CASE WHEN obs % 7 = 0 THEN obs ELSE obs + 1 END AS other FROM o) SELECT obs, 'fixed point' AS why FROM m WHERE obs = other UNION ALL SELECT other, 'repeated' FROM m GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT other, 'unknown' FROM m WHERE other NOT IN (SELECT obs FROM o)")
def derangement_check(spark, sf):
    o = fx.atoms(spark, sf).select("obs").distinct()
    return harmonic.derangement_violations(o.select("obs", F.when(F.col("obs") % 7 == 0, F.col("obs")).otherwise(F.col("obs") + 1).alias("other")), o)


@query(f"{A}, {_values([(0, 'linear', fx.BANK[0][1], fx.BANK[0][2]), (1, 'linear', fx.BANK[0][3], fx.BANK[0][4])])}, f AS ({_OWN}) SELECT obs, round(sum(re) / 2, 6) + 0.0 AS re, round(sum(im) / 2, 6) + 0.0 AS im FROM f GROUP BY 1")
def one_character(spark, sf):
    return _round(harmonic.one_character(fx.atoms(spark, sf), fx.BANK[0]), "re", "im")


@query(f"{A}, {_values(_LIN)}, f AS ({_OWN}), v AS (SELECT obs, flatten(list([round(re, 6) + 0.0, round(im, 6) + 0.0] ORDER BY idx)) AS vector FROM f GROUP BY 1) SELECT obs, vector FROM v")
def feature_vectors(spark, sf):
    return harmonic.vectors(_round(harmonic.coordinates(fx.atoms(spark, sf), _LIN), "re", "im"))


@query(f"{_values(SPEC).replace('spec(', 'WITH spec(', 1)} SELECT CAST(idx AS INT) AS idx, family, w0, w1 FROM spec")
def feature_layout(spark, sf):
    return harmonic.spec_frame(spark, SPEC)


# ---- graphs


@query(f"{E} SELECT g, u, v, formation, support FROM edges")
def canonical_edges(spark, sf):
    return fx.edges(spark, sf)


_PROBE = "probe AS (SELECT o_orderkey % 50 AS u, o_custkey % 50 AS v, 'click' AS g FROM orders)"


@query(f"{E}, {_PROBE} SELECT u, v, g FROM probe WHERE EXISTS (SELECT 1 FROM edges e WHERE e.g = probe.g AND e.u = least(probe.u, probe.v) AND e.v = greatest(probe.u, probe.v))")
def edge_probe(spark, sf):
    p = fx.table(spark, sf, "orders").select((F.col("o_orderkey") % 50).alias("u"), (F.col("o_custkey") % 50).alias("v"), F.lit("click").alias("g"))
    return graph.has_edge(p, fx.edges(spark, sf))


_SIZES = "sizes AS (SELECT n_nationkey AS g, CAST(n_nationkey + 2 AS BIGINT) AS n FROM nation)"


def _sizes(spark, sf):
    return fx.table(spark, sf, "nation").select(F.col("n_nationkey").alias("g"), (F.col("n_nationkey") + 2).cast("long").alias("n"))


@query(f"WITH {_SIZES} SELECT g, u.range AS u, v.range AS v FROM sizes, range(0, 60) u, range(0, 60) v WHERE u.range < v.range AND v.range < n")
def dyads(spark, sf):
    return graph.dyads(_sizes(spark, sf))


@query(f"WITH {_SIZES}, d AS (SELECT g, u.range AS u, v.range AS v FROM sizes, range(0, 60) u, range(0, 60) v WHERE u.range < v.range AND v.range < n) SELECT g, u, v FROM d WHERE (u * 7 + v * 3) % 4 <> 0")
def nonedges(spark, sf):
    d = graph.dyads(_sizes(spark, sf))
    return graph.non_edges(d, d.where((F.col("u") * 7 + F.col("v") * 3) % 4 == 0))


_RANK = "rk AS (SELECT g, u, v, formation, support, row_number() OVER (PARTITION BY g ORDER BY support DESC, formation, u, v) AS step, count(*) OVER (PARTITION BY g) AS n FROM {t}), fl AS (SELECT g, u, v, formation, support, step, CAST(step - 1 AS DOUBLE) / greatest(n - 1, 1) AS time FROM rk)"


@query(f"{E}, {_RANK.format(t='edges')} SELECT g, u, v, formation, support, CAST(step AS INT) AS step, round(time, 6) AS time FROM fl")
def filtration_rank(spark, sf):
    return _round(graph.rank_filtration(fx.edges(spark, sf)), "time")


@query(f"{E} SELECT g, u, v, CAST(support AS DOUBLE) AS time, CAST(dense_rank() OVER (PARTITION BY g ORDER BY support) AS INT) AS step FROM edges")
def dense_steps(spark, sf):
    return graph.dense_steps(fx.edges(spark, sf).select("g", "u", "v", F.col("support").cast("double").alias("time")))


@query(f"{E}, {_RANK.format(t='edges')} SELECT g, CAST(step AS INT) AS step, CAST(formation AS DOUBLE) AS value FROM fl")
def ordered_edge_field(spark, sf):
    e = fx.edges(spark, sf)
    return graph.ordered_field(graph.rank_filtration(e), e.select("g", "u", "v", F.col("formation").cast("double").alias("value")))


@query(f"{E} SELECT g, x AS vertex, list(DISTINCT y ORDER BY y) AS neighbours FROM (SELECT g, u AS x, v AS y FROM edges UNION ALL SELECT g, v, u FROM edges) GROUP BY 1, 2")
def adjacency(spark, sf):
    return graph.adjacency(fx.edges(spark, sf))


@query(f"{E} SELECT g, u, v, CAST(row_number() OVER (PARTITION BY g ORDER BY u, v) - 1 AS INT) AS index FROM edges")
def edge_index(spark, sf):
    return graph.edge_index(fx.edges(spark, sf).select("g", "u", "v"))


_TRI = "tri AS (SELECT x.g, x.u AS a, x.v AS b, y.v AS c FROM {t} x JOIN {t} y ON x.g = y.g AND x.v = y.u JOIN {t} z ON z.g = x.g AND z.u = x.u AND z.v = y.v)"


@query(f"{E}, {_TRI.format(t='edges')} SELECT g, a, b, c FROM tri")
def triangles(spark, sf):
    return graph.triangles(fx.edges(spark, sf))


_SUP = "sup AS (SELECT e.g, e.u, e.v, count(k.g) AS triangles FROM {t} e LEFT JOIN (SELECT g, a AS u, b AS v FROM tri UNION ALL SELECT g, a, c FROM tri UNION ALL SELECT g, b, c FROM tri) k USING (g, u, v) GROUP BY 1, 2, 3)"


@query(f"{E}, {_TRI.format(t='edges')}, {_SUP.format(t='edges')} SELECT g, u, v, triangles FROM sup")
def triangle_support(spark, sf):
    return graph.triangle_support(fx.edges(spark, sf))


_DEG = "deg AS (SELECT g, x, count(*) AS d FROM (SELECT g, u AS x FROM {t} UNION ALL SELECT g, v FROM {t}) GROUP BY 1, 2)"


@query(f"{E}, {_TRI.format(t='edges')}, {_DEG.format(t='edges')}, cor AS (SELECT g, x, count(*) AS t FROM (SELECT g, unnest([a, b, c]) AS x FROM tri) GROUP BY 1, 2) SELECT g, count(*) AS vertices, CAST(sum(d) // 2 AS BIGINT) AS edges, round(sum(d) / (count(*) * (count(*) - 1)), 6) AS density, round(sum(d) / count(*), 6) AS mean_degree, round(avg(CASE WHEN d >= 2 THEN 2 * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END), 6) AS clustering FROM deg LEFT JOIN cor USING (g, x) GROUP BY 1")
def graph_statistics(spark, sf):
    return _round(graph.graph_statistics(fx.edges(spark, sf)), "density", "mean_degree", "clustering")


@query(f"{E}, {_DEG.format(t='edges')}, st AS (SELECT g, sum(d) / (count(*) * (count(*) - 1)) AS density, sum(d) / count(*) AS mean_degree FROM deg GROUP BY 1) SELECT length(g) AS batch, round(avg(density), 6) AS density, round(avg(mean_degree), 6) AS mean_degree FROM st GROUP BY 1")
def graph_statistics_batch(spark, sf):
    s = graph.graph_statistics(fx.edges(spark, sf))
    return _round(graph.mean_statistics(s, s.select("g", F.length("g").cast("long").alias("batch"))).drop("clustering"), "density", "mean_degree")


@query(f"{E}, bad AS (SELECT g, u, v FROM edges UNION ALL SELECT g, v, u FROM edges WHERE formation % 5 = 0 UNION ALL SELECT g, u, u FROM edges WHERE formation % 11 = 0), n AS (SELECT g, median(v) AS n FROM edges WHERE g <> 'click' GROUP BY 1), c AS (SELECT *, count(*) OVER (PARTITION BY bad.g, least(u, v), greatest(u, v)) AS k FROM bad LEFT JOIN n USING (g)) SELECT g, u, v, CASE WHEN n IS NULL THEN 'unknown graph' WHEN u = v THEN 'loop' WHEN greatest(u, v) >= n THEN 'range' ELSE 'duplicate' END AS why FROM c WHERE n IS NULL OR u = v OR greatest(u, v) >= n OR k > 1")
def edge_violations(spark, sf):
    e = fx.edges(spark, sf)
    bad = e.select("g", "u", "v").unionByName(e.where("formation % 5 = 0").select("g", F.col("v").alias("u"), F.col("u").alias("v"))).unionByName(e.where("formation % 11 = 0").select("g", "u", F.col("u").alias("v")))
    return graph.edge_violations(bad, e.where("g <> 'click'").groupBy("g").agg(F.median("v").alias("n")))


_CPX = f"{E}, {_RANK.format(t='edges')}, {_TRI.format(t='edges')}"


@query(f"{_CPX}, s AS (SELECT DISTINCT g, [x] AS vertices, 0 AS dim, 0.0::DOUBLE AS filtration FROM (SELECT g, u AS x FROM fl UNION ALL SELECT g, v FROM fl) UNION ALL SELECT g, [u, v], 1, time FROM fl UNION ALL SELECT t.g, [a, b, c], 2, greatest(p.time, q.time, r.time) FROM tri t JOIN fl p ON p.g = t.g AND p.u = a AND p.v = b JOIN fl q ON q.g = t.g AND q.u = a AND q.v = c JOIN fl r ON r.g = t.g AND r.u = b AND r.v = c) SELECT g, vertices, dim, round(filtration, 6) AS filtration, CAST(row_number() OVER (PARTITION BY g ORDER BY s.filtration, dim, vertices) - 1 AS INT) AS place FROM s")
def clique_complex(spark, sf):
    return _round(graph.clique_complex(graph.rank_filtration(fx.edges(spark, sf))), "filtration")


@query()
def h1_persistence(spark, sf):
    return _round(homology.h1(graph.clique_complex(graph.rank_filtration(fx.edges(spark, sf)))), "birth", "death")


@query()
def h1_persistence_by_ranges(spark, sf):
    """The plan for graphs that no task holds: the rows of ``h1_persistence``."""
    return _round(homology.h1_spread(graph.clique_complex(graph.rank_filtration(fx.edges(spark, sf)))), "birth", "death")


@query(f"""{E}, nb AS (SELECT g, u AS x, v AS y FROM edges UNION ALL SELECT g, v, u FROM edges), comp AS (WITH RECURSIVE r(g, x, c) AS (SELECT DISTINCT g, x, x FROM nb UNION SELECT nb.g, nb.y, r.c FROM r JOIN nb ON nb.g = r.g AND nb.x = r.x) SELECT g, x, min(c) AS c FROM r GROUP BY 1, 2)
SELECT g, (SELECT count(*) FROM edges s WHERE s.g = comp.g) - count(*) + count(DISTINCT c) AS classes FROM comp GROUP BY g""")
def h1_class_count(spark, sf):
    """The coefficients of an uncleaned diagram add up to edges - vertices + components."""
    d = homology.h1(graph.clique_complex(graph.rank_filtration(fx.edges(spark, sf))), drop_empty=False)
    return d.groupBy(F.col("obs").alias("g")).agg(F.sum("coefficient").cast("long").alias("classes"))


# all edges whose triangles no longer suffice leave at once; a graph without such edges rises by a level
_TRUSS = """peel(g, u, v, k, gone) AS (
  SELECT g, u, v, 2, false FROM edges
  UNION ALL (
  WITH live AS (SELECT g, u, v, k FROM peel WHERE NOT gone),
  side AS (SELECT x.g, x.u AS a, x.v AS b, y.v AS c FROM live x JOIN live y ON x.g = y.g AND x.v = y.u JOIN live z ON z.g = x.g AND z.u = x.u AND z.v = y.v),
  cnt AS (SELECT g, u, v, count(*) AS n FROM (SELECT g, a AS u, b AS v FROM side UNION ALL SELECT g, a, c FROM side UNION ALL SELECT g, b, c FROM side) GROUP BY 1, 2, 3),
  now AS (SELECT live.*, coalesce(n, 0) <= k - 2 AS weak, bool_or(coalesce(n, 0) <= k - 2) OVER (PARTITION BY live.g) AS any_weak FROM live LEFT JOIN cnt USING (g, u, v))
  SELECT g, u, v, CASE WHEN any_weak THEN k ELSE k + 1 END, weak FROM now)),
truss AS (SELECT g, u, v, CAST(k AS INT) AS trussness FROM peel WHERE gone)"""
_RE = E.replace("WITH ", "WITH RECURSIVE ", 1)


@query(f"{_RE}, {_TRUSS} SELECT g, u, v, trussness FROM truss")
def trussness(spark, sf):
    return graph.trussness(fx.edges(spark, sf))


@query(f"{_RE}, {_TRUSS} SELECT g, u, v, trussness FROM truss")
def trussness_by_joins(spark, sf):
    """The plan for graphs that no task holds."""
    return graph.trussness_spread(fx.edges(spark, sf))


@query(f"{E}, {_TRI.format(t='edges')}, {_SUP.format(t='edges')}, {_DEG.format(t='edges')}, k AS (SELECT s.g, u, v, triangles AS common, least(a.d, b.d) - 1 AS available FROM sup s JOIN deg a ON a.g = s.g AND a.x = u JOIN deg b ON b.g = s.g AND b.x = v) SELECT g, u, v, CAST(2 AS INT) AS trussness, common, available, CASE WHEN available = 0 THEN 1 ELSE common END AS num, CASE WHEN available = 0 THEN 1 ELSE available END AS den FROM k")
def cohesion_key(spark, sf):
    e = fx.edges(spark, sf)
    return graph.cohesion(e, e.select("g", "u", "v", F.lit(2).alias("trussness")))


@query(f"{E}, {_TRI.format(t='edges')}, {_SUP.format(t='edges')}, {_DEG.format(t='edges')}, k AS (SELECT s.g, u, v, 2 + triangles AS truss, triangles AS common, least(a.d, b.d) - 1 AS available FROM sup s JOIN deg a ON a.g = s.g AND a.x = u JOIN deg b ON b.g = s.g AND b.x = v), l AS (SELECT g, u, v, dense_rank() OVER (PARTITION BY g ORDER BY truss DESC, CASE WHEN available = 0 THEN 1.0::DOUBLE ELSE common / available END DESC) AS step FROM k) SELECT g, u, v, CAST(step AS INT) AS step, round(step / (max(step) OVER (PARTITION BY g) + 1), 6) AS time FROM l")
def cohesion_filtration(spark, sf):
    e = fx.edges(spark, sf)
    keys = graph.cohesion(e, graph.triangle_support(e).select("g", "u", "v", (F.col("triangles") + 2).cast("int").alias("trussness")))
    return _round(graph.cohesion_filtration(keys).select("g", "u", "v", "step", "time"), "time")


@query(f"{_RE}, {_TRUSS}, {_TRI.format(t='edges')}, {_SUP.format(t='edges')}, {_DEG.format(t='edges')}, k AS (SELECT s.g, u, v, triangles AS common, least(a.d, b.d) - 1 AS available FROM sup s JOIN deg a ON a.g = s.g AND a.x = u JOIN deg b ON b.g = s.g AND b.x = v), l AS (SELECT g, u, v, trussness, dense_rank() OVER (PARTITION BY g ORDER BY trussness DESC, CASE WHEN available = 0 THEN 1.0::DOUBLE ELSE common / available END DESC) AS step FROM k JOIN truss USING (g, u, v)) SELECT g, u, v, trussness, CAST(step AS INT) AS step, round(step / (max(step) OVER (PARTITION BY g) + 1), 6) AS time FROM l")
def clique_cohesion_times(spark, sf):
    """The filtration that ``clique_cohesion_graphs`` starts from."""
    return _round(studies.cohesion_filtered(fx.edges(spark, sf)).select("g", "u", "v", "trussness", "step", "time"), "time")


@query()
def clique_cohesion_graphs(spark, sf):
    """Edges to features: trussness, cohesion, filtration, complex, persistence and harmonic coordinates."""
    e = studies.cohesion_filtered(fx.edges(spark, sf))
    return _round(studies.interval_features(e, SPEC), "re", "im")


# ---- transport


@query()
def w1_pd1(spark, sf):
    a = fx.atoms(spark, sf)
    return _round(transport.diagram_distance(a, _partners(a).select(F.col("obs").alias("first"), F.col("other").alias("second"))), "w1")


@query()
def nearest_diagrams(spark, sf):
    """Each window's nearest by transport of diagrams, among those of its type of event."""
    e, members = studies.labelled_graphs(fx.window_graphs(spark, sf))
    near = transport.nearest(homology.h1(graph.clique_complex(e)), members.select(F.col("label").alias("batch"), "obs"))
    return _round(near.select("batch", "obs", "other", "w1", "others"), "w1")


def _small_diagrams(spark, sf):
    """Diagrams of the nations' graphs, whole; two passes of levels give them classes of several lengths."""
    _, e = _local(spark, sf)
    return homology.h1(graph.clique_complex(e))


@query()
def w1_pd2(spark, sf):
    """Distances between the second-order diagrams of the nations' graphs, each with the next."""
    a = _small_diagrams(spark, sf)
    return _round(transport.pair_diagram_distance(diagrams.second_order(a), _partners(a).select(F.col("obs").alias("first"), F.col("other").alias("second"))), "w1")


@query()
def w1_signed_pairs(spark, sf):
    """Signed second-order diagrams of the nations' graphs: pairs of a long outer interval count against the others."""
    p = diagrams.second_order(_small_diagrams(spark, sf))
    sign = F.when(F.col("right_death") - F.col("right_birth") > 0.5, -F.col("coefficient")).otherwise(F.col("coefficient"))
    return _round(transport.signed_distance(p.withColumn("coefficient", sign)), "w1")


# ---- perturbations

_KEY = "(u * 7919 + v * 104729) % 10007"


def _key():
    return (F.col("u") * 7919 + F.col("v") * 104729) % 10007


@query(f"{E}, {_RANK.format(t='edges')}, d AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY {_KEY}, u, v) AS k, count(*) OVER (PARTITION BY g) AS n FROM fl) SELECT g, u, v, CAST(step AS INT) AS step, round(time, 6) AS time FROM d WHERE k > floor(0.1::DOUBLE * n)")
def edge_deletion(spark, sf):
    return _round(perturb.delete_edges(graph.rank_filtration(fx.edges(spark, sf)), 0.1, _key()).select("g", "u", "v", "step", "time"), "time")


_LOCAL = "loc AS (SELECT n_nationkey AS g, n_nationkey + 2 AS n FROM nation), dy AS (SELECT g, u.range AS u, v.range AS v FROM loc, range(0, 60) u, range(0, 60) v WHERE u.range < v.range AND v.range < n), ed AS (SELECT g, u, v, ((u * 7 + v * 3) % 5)::DOUBLE / 4 AS time FROM dy WHERE (u * 5 + v * 3) % 3 = 0)"


def _local(spark, sf):
    d = graph.dyads(_sizes(spark, sf))
    return d, d.where((F.col("u") * 5 + F.col("v") * 3) % 3 == 0).withColumn("time", ((F.col("u") * 7 + F.col("v") * 3) % 5).cast("double") / 4)


@query(f"""WITH {_LOCAL}, c AS (SELECT g, floor(0.3::DOUBLE * count(*)) AS n FROM ed GROUP BY 1),
nw AS (SELECT dy.g, dy.u, dy.v, row_number() OVER (PARTITION BY dy.g ORDER BY (dy.u * 7919 + dy.v * 104729) % 10007, dy.u, dy.v) AS k FROM dy LEFT JOIN ed USING (g, u, v) WHERE ed.time IS NULL),
tm AS (SELECT g, time, row_number() OVER (PARTITION BY g ORDER BY v % 3, u, v) AS k FROM ed),
al AS (SELECT g, u, v, time FROM ed UNION ALL SELECT nw.g, nw.u, nw.v, tm.time FROM nw JOIN c ON c.g = nw.g AND nw.k <= c.n JOIN tm ON tm.g = nw.g AND tm.k = nw.k)
SELECT g, u, v, time, CAST(dense_rank() OVER (PARTITION BY g ORDER BY time) AS INT) AS step FROM al""")
def edge_insertion(spark, sf):
    d, e = _local(spark, sf)
    return perturb.insert_edges(e, d, 0.3, _key(), F.col("v") % 3)


@query(f"WITH {_LOCAL}, j AS (SELECT g, u, v, least(1.0, greatest(0.0, time + 0.2::DOUBLE * (((u * 13 + v * 29) % 41)::DOUBLE / 10 - 2))) AS time FROM ed) SELECT g, u, v, round(time, 6) AS time, CAST(dense_rank() OVER (PARTITION BY g ORDER BY j.time) AS INT) AS step FROM j")
def filtration_noise(spark, sf):
    _, e = _local(spark, sf)
    return _round(perturb.jitter(e, 0.2, ((F.col("u") * 13 + F.col("v") * 29) % 41).cast("double") / 10 - 2), "time")


@query()
def edge_swaps(spark, sf):
    _, e = _local(spark, sf)
    return perturb.swap_edges(e, 0.2, 7)


@query(f"WITH {_LOCAL}, {_DEG.format(t='ed')} SELECT g, x AS vertex, d AS degree FROM deg")
def edge_swap_degrees(spark, sf):
    """Swaps leave all degrees as they were, so the SQL has those of the graphs before."""
    _, e = _local(spark, sf)
    return graph.degrees(perturb.swap_edges(e, 0.2, 7))


@query()
def edge_insertion_random(spark, sf):
    """A tenth more edges in the events' graphs, drawn from all pairs of users that have none."""
    return _round(perturb.insert_random_edges(graph.rank_filtration(fx.edges(spark, sf)), 0.1, 11), "time")


@query(f"{E}, {_DEG.format(t='edges')}, c AS (SELECT g, count(*) AS n FROM edges GROUP BY 1), x AS (SELECT g, count(*) AS s FROM deg GROUP BY 1) SELECT g, n, s AS vertices, CAST(least(floor(0.1::DOUBLE * n), s * (s - 1) // 2 - n) AS BIGINT) AS added, CAST(0 AS BIGINT) AS lost FROM c JOIN x USING (g)")
def edge_insertion_counts(spark, sf):
    """What any draw must keep to: all edges stay, as many come as are asked for, none twice, all between vertices there were."""
    e = graph.rank_filtration(fx.edges(spark, sf))
    new = perturb.insert_random_edges(e, 0.1, 11).select("g", "u", "v").where("u < v").distinct()
    j = new.withColumn("after", F.lit(1)).join(e.select("g", "u", "v", F.lit(1).alias("before")), ["g", "u", "v"], "full")
    n = j.groupBy("g").agg(F.count("before").alias("n"), F.sum(F.expr("CASE WHEN before IS NULL THEN 1 ELSE 0 END")).alias("added"), F.sum(F.expr("CASE WHEN after IS NULL THEN 1 ELSE 0 END")).alias("lost"))
    return n.join(graph.vertices(new).groupBy("g").agg(F.count("*").alias("vertices")), "g").select("g", "n", "vertices", "added", "lost")


@query()
def edge_swaps_whole(spark, sf):
    """A fifth of the edges of the events' graphs."""
    return _round(perturb.swap_edges(graph.rank_filtration(fx.edges(spark, sf)), 0.2, 7), "time")


@query(f"{E}, {_DEG.format(t='edges')} SELECT g, x AS vertex, d AS degree FROM deg")
def edge_swaps_whole_degrees(spark, sf):
    """Swaps leave all degrees as they were, so the SQL has those of the graphs before."""
    return graph.degrees(perturb.swap_edges(graph.rank_filtration(fx.edges(spark, sf)), 0.2, 7).select("g", "u", "v").distinct())


# ---- generators

_MODELS = {
    "erdos_renyi": {}, "watts_strogatz": {"degree": 4, "rewiring_probability": 0.2}, "barabasi_albert": {"initial_clique_size": 5, "attachment_count": 2}, "configuration": {"degree": 4},
    "block_model": {"block_count": 4, "log_odds_contrast": 2.5}, "chung_lu": {"degree_exponent": 2.8}, "kleinberg": {"rows": 5, "columns": 6, "long_range_edge_count": 11, "distance_exponent": 2.0},
    "girg": {"degree_exponent": 2.8, "connection_exponent": 2.0}, "hyperbolic": {"degree_exponent": 2.8, "temperature": 0.4, "curvature": -1.0, "radius": 6.0}, "gwesp": {"gwesp_decay": 0.5, "gwesp_coefficient": 0.8, "burn_in_sweeps": 2, "sampling_sweeps": 2},
}


@query()
def random_graphs(spark, sf):
    """Two graphs of each model, 30 vertices and 60 edges."""
    out = None
    for i, (m, p) in enumerate(_MODELS.items()):
        r = studies.requests(spark, m, 30, 60, {k: float(v) for k, v in p.items()}, 2, 100 + i)
        out = r if out is None else out.unionByName(r)
    return _round(generate.generate(out), "support")


@query("WITH m AS (SELECT unnest([" + ", ".join(f"'{m}'" for m in _MODELS) + "]) AS model) SELECT model, 2 AS graphs, CASE model WHEN 'barabasi_albert' THEN 2 * (5 * 4 // 2 + (30 - 5) * 2) WHEN 'kleinberg' THEN 2 * (5 * (6 - 1) + (5 - 1) * 6 + 11) ELSE 2 * 60 END ::INT AS edges, 0 AS loops, 0 AS repeats, 0 AS outside FROM m")
def random_graph_counts(spark, sf):
    """What every model must keep to: graphs and edges, no loop, no repeated edge, no vertex outside."""
    e = random_graphs(spark, sf).withColumn("model", F.regexp_replace("g", "-[0-9]+$", ""))
    edge, bad = F.struct("g", F.least("u", "v"), F.greatest("u", "v")), lambda c: F.count(F.when(c, 1))
    r = e.groupBy("model").agg(F.countDistinct("g").alias("graphs"), F.count("*").alias("edges"), bad(F.col("u") == F.col("v")).alias("loops"), (F.count("*") - F.countDistinct(edge)).alias("repeats"), bad((F.least("u", "v") < 0) | (F.greatest("u", "v") >= 30)).alias("outside"))
    return r.select("model", *[F.col(c).cast("int").alias(c) for c in r.columns[1:]])


@query(f"WITH {_SIZES}, d AS (SELECT g, u.range AS u, v.range AS v, n FROM sizes, range(0, 60) u, range(0, 60) v WHERE u.range < v.range AND v.range < n) SELECT g, count(*) AS dyads, least(count(*), any_value(n)) AS edges FROM d GROUP BY 1")
def uniform_graphs(spark, sf):
    s = _sizes(spark, sf)
    e = generate.uniform_graph(s.withColumn("m", F.col("n")), 5).groupBy("g").agg(F.count("*").alias("edges"))
    return graph.dyads(s).groupBy("g").agg(F.count("*").alias("dyads")).join(e, "g")


@query("WITH c AS (SELECT c_custkey AS i, count(*) OVER () AS n FROM customer) SELECT i, round(pow(n / (i + 0.5::DOUBLE), 1 / (2.5::DOUBLE - 1)), 6) AS weight FROM c")
def power_law_profile(spark, sf):
    """The weights of as many vertices as there are customers."""
    c = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("i"))
    n = c.agg(F.count("*").alias("n"))
    return c.join(F.broadcast(n)).select("i", r6(X.power_law_weight(F.col("i"), F.col("n"), 2.5)).alias("weight"))  # a row


@query("WITH x AS (SELECT n_nationkey AS i, (n_nationkey - 12)::DOUBLE AS x FROM nation) SELECT i, round(1 / (1 + exp(-x)), 6) AS logistic, round(ln((i + 1) / 27.0::DOUBLE) - ln(1 - (i + 1) / 27.0::DOUBLE), 6) AS log_odds, round(ln(exp(x) + exp(2.0::DOUBLE)), 6) AS log_add FROM x")
def numeric_helpers(spark, sf):
    x = fx.table(spark, sf, "nation").select(F.col("n_nationkey").alias("i"), (F.col("n_nationkey") - 12).cast("double").alias("x"))
    return x.select("i", r6(X.logistic(F.col("x"))).alias("logistic"), r6(X.log_odds((F.col("i") + 1) / 27.0)).alias("log_odds"), r6(X.log_add_exp(F.col("x"), F.lit(2.0))).alias("log_add"))


# ---- vectors

_GRID = vectorize.landscape_grid(0.0, 0.6, 12)
_PIX = vectorize.image_pixels((0.0, 0.1, 0.0, 0.5), 5, 4)
_SQL_GRID = "grid(point, x) AS (VALUES " + ", ".join(f"({i}, {x!r}::DOUBLE)" for i, x in _GRID) + ")"
_SQL_PIX = "pix(pixel, x, y) AS (VALUES " + ", ".join(f"({i}, {x!r}::DOUBLE, {y!r}::DOUBLE)" for i, x, y in _PIX) + ")"
_SQL_LAND = f"{_SQL_GRID}, ex AS (SELECT obs, birth, death, unnest(range(CAST(coefficient AS INT))) AS copy FROM atoms), tn AS (SELECT obs, point, least(x - birth, death - x) AS y FROM ex, grid WHERE x > birth AND x < death), rk AS (SELECT *, row_number() OVER (PARTITION BY obs, point ORDER BY y DESC) AS layer FROM tn), land AS (SELECT o.obs, k.range AS layer, point, sqrt(2::DOUBLE) * coalesce(y, 0) AS value FROM (SELECT DISTINCT obs FROM atoms) o CROSS JOIN grid CROSS JOIN range(1, 4) k LEFT JOIN rk ON rk.obs = o.obs AND rk.point = grid.point AND rk.layer = k.range)".replace("o.obs, k.range AS layer, point,", "o.obs, k.range AS layer, grid.point,")


@query(f"{A}, {_SQL_LAND} SELECT obs, CAST(layer AS INT) AS layer, CAST(point AS INT) AS point, round(value, 6) AS value FROM land")
def landscape(spark, sf):
    a = fx.atoms(spark, sf)
    return _round(vectorize.landscape(a, a, 3, _GRID), "value")


@query(f"{B}, {_SQL_LAND} SELECT batch, CAST(layer AS INT) AS layer, CAST(point AS INT) AS point, round(avg(value), 6) AS value FROM batches JOIN land USING (obs) GROUP BY 1, 2, 3")
def landscape_batch(spark, sf):
    a = fx.atoms(spark, sf)
    return _round(vectorize.batch_mean(vectorize.landscape(a, a, 3, _GRID), fx.batches(spark, sf), "layer", "point"), "value")


_SQL_IMG = f"{_SQL_PIX}, img AS (SELECT obs, pixel, sum(CAST(coefficient AS INT) * (death - birth) * exp(-(pow(birth - x, 2) + pow(death - birth - y, 2)) / (2 * 0.05::DOUBLE * 0.05)) / (2 * pi() * 0.05::DOUBLE * 0.05)) AS value FROM atoms, pix GROUP BY 1, 2)"


@query(f"{A}, {_SQL_IMG} SELECT obs, CAST(pixel AS INT) AS pixel, round(value, 6) AS value FROM img")
def persistence_image(spark, sf):
    a = fx.atoms(spark, sf)
    return _round(vectorize.image(a, a, _PIX, 0.05), "value")


@query(f"{B}, {_SQL_IMG} SELECT batch, CAST(pixel AS INT) AS pixel, round(avg(value), 6) AS value FROM batches JOIN img USING (obs) GROUP BY 1, 2")
def persistence_image_batch(spark, sf):
    a = fx.atoms(spark, sf)
    return _round(vectorize.batch_mean(vectorize.image(a, a, _PIX, 0.05), fx.batches(spark, sf), "pixel"), "value")


@query(f"{A} SELECT min(birth) AS lo, round(max(death), 6) AS hi FROM atoms")
def landscape_range(spark, sf):
    lo, hi = vectorize.fit_range(fx.atoms(spark, sf))
    return spark.createDataFrame([(lo, round(hi, 6))], "lo double, hi double")


_TENT = "(0.5 * (death - birth) - abs(0.3::DOUBLE - 0.5 * (birth + death)))"


@query(f"""{A}, ex AS (SELECT obs, birth, death, unnest(range(CAST(coefficient AS INT))) AS c FROM atoms), sh AS (SELECT *, (death - birth) / sum(death - birth) OVER (PARTITION BY obs) AS q FROM ex),
v AS (SELECT obs, pow(abs(death - birth), 2) AS w, greatest({_TENT}, 0) AS v0, 1 / (1 + exp(-10 * {_TENT})) AS v1, -q * ln(q) / (1 + exp(-10 * {_TENT})) AS v2, exp(-pow(birth - 0.05, 2) * 9 - pow(death - 0.3, 2) * 4) AS v3, 1 / pow(1 + abs(birth - 0.05) * 3 + abs(death - 0.3) * 2, 1.5) AS v4,
  1 / (1 + sqrt(pow(birth - 0.05, 2) + pow(death - 0.3, 2))) - 1 / (1 + abs(0.1 - sqrt(pow(birth - 0.05, 2) + pow(death - 0.3, 2)))) AS v5, exp(-(pow(birth - 0.05, 2) + pow(death - birth - 0.2, 2)) / (2 * 0.01::DOUBLE)) / (2 * pi() * 0.01::DOUBLE) AS v6, birth * 0.5173 + death * 2.0319 - 0.1234567 - (max(birth) OVER (PARTITION BY obs) * 0.2071 + max(death) OVER (PARTITION BY obs) * 0.3019) AS v7 FROM sh),
u AS (SELECT obs, unnest(range(8)) AS idx, w * unnest([v0, v1, v2, v3, v4, v5, v6, v7]) AS x FROM v) SELECT obs, CAST(idx AS INT) AS idx, round(sum(x), 6) + 0.0 AS value FROM u GROUP BY 1, 2""")
def layer_forward(spark, sf):
    mu = (0.05, 0.3)
    layers = [vectorize.layer_landscape(0.3), vectorize.layer_betti(0.3, 10.0), vectorize.layer_entropy(0.3, 10.0), vectorize.layer_exponential(mu, (3.0, 2.0)), vectorize.layer_rational(mu, (3.0, 2.0), 1.5), vectorize.layer_hat(2.0, mu, 0.1), vectorize.layer_image(0.05, 0.2, 0.1), vectorize.layer_linear(0.5173, 2.0319, -0.1234567, "max", 0.2071, 0.3019)]
    return _round(vectorize.forward(fx.atoms(spark, sf), layers, vectorize.weight_power(1.0, 2.0)), "value")


# ---- evaluation


@query(f"{L} SELECT id, label, stratum, CAST((row_number() OVER (PARTITION BY stratum ORDER BY id) - 1) % 5 AS INT) AS fold FROM samples")
def strat_folds(spark, sf):
    return evaluate.stratified_folds(fx.samples(spark, sf), 5)


@query(f"{L}, o AS (SELECT id, stratum, (row_number() OVER (PARTITION BY stratum ORDER BY id) - 1) % 4 AS own FROM samples), x AS (SELECT o.*, k.range AS outer_fold FROM o, range(4) k) SELECT id, CAST(outer_fold AS INT) AS outer_fold, CAST(CASE WHEN own <> outer_fold THEN (row_number() OVER (PARTITION BY outer_fold, stratum, own = outer_fold ORDER BY id) - 1) % 3 ELSE -1 END AS INT) AS inner_fold FROM x")
def nested_folds(spark, sf):
    return evaluate.nested_folds(fx.samples(spark, sf), 4, 3).withColumn("inner_fold", F.coalesce("inner_fold", F.lit(-1)))


@query(f"{L} SELECT id, 'missing' AS why FROM samples WHERE id % 10 = 3 UNION ALL SELECT id, 'repeated' FROM samples WHERE id % 10 = 4 UNION ALL SELECT id - 1000000, 'unknown' FROM samples WHERE id % 10 = 5")
def fold_check(spark, sf):
    s = fx.samples(spark, sf).select("id")
    f = s.where("id % 10 <> 3").unionByName(s.where("id % 10 = 4")).unionByName(s.where("id % 10 = 5").select((F.col("id") - 1000000).alias("id")))
    return evaluate.fold_violations(f, s)


@query("WITH c AS (SELECT l_linenumber AS outer_fold, l_suppkey % 3 AS inner_fold, CAST(l_partkey % 6 AS INT) AS candidate, round(l_discount * 4) / 4 AS score FROM lineitem), m AS (SELECT outer_fold, candidate, avg(score) AS s FROM c GROUP BY 1, 2) SELECT outer_fold, candidate, round(s, 6) AS mean_score FROM m QUALIFY row_number() OVER (PARTITION BY outer_fold ORDER BY s DESC, candidate) = 1")
def select_candidate(spark, sf):
    c = fx.table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("outer_fold"), (F.col("l_suppkey") % 3).alias("inner_fold"), (F.col("l_partkey") % 6).cast("int").alias("candidate"), (F.round(F.col("l_discount") * 4) / 4).alias("score"))
    return _round(evaluate.select_candidate(c), "mean_score")


_FEATS = "feats AS (SELECT vec_id AS id, label, unnest(range(len(embedding))) AS idx, unnest(embedding)::DOUBLE AS value FROM embeddings)"


def _feats(spark, sf):
    return fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("idx", "value"))


@query(f"WITH {_FEATS} SELECT CAST(idx AS INT) AS idx FROM feats GROUP BY 1 HAVING var_pop(value) > 0.0155")
def low_variance(spark, sf):
    return evaluate.low_variance(_feats(spark, sf), 0.0155)


@query(f"WITH {_FEATS}, m AS (SELECT idx, avg(value) AS a, stddev_pop(value) AS s FROM feats WHERE id % 3 <> 0 GROUP BY 1) SELECT id, label, CAST(idx AS INT) AS idx, round((value - a) / s, 6) + 0.0 AS value FROM feats JOIN m USING (idx)")
def standardize(spark, sf):
    f = _feats(spark, sf)
    return _round(evaluate.standardize(f.where("id % 3 <> 0"), f).select("id", "label", "idx", "value"), "value")


@query(f"{L}, c AS (SELECT stratum, label, count(*) AS n FROM samples GROUP BY 1, 2) SELECT stratum, label FROM c QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY n DESC, label) = 1")
def majority_class(spark, sf):
    return evaluate.majority(fx.samples(spark, sf))


_BAGS = "bg AS (SELECT id, label, (row_number() OVER (PARTITION BY label ORDER BY id) - 1) // {k} AS bag, count(*) OVER (PARTITION BY label) // {k} AS n FROM {t})"


@query(f"{L}, {_BAGS.format(k=7, t='samples')} SELECT id, label, CAST(bag AS INT) AS bag FROM bg WHERE bag < n")
def bags(spark, sf):
    return evaluate.bags(fx.samples(spark, sf), 7)


@query(f"WITH {_FEATS}, {_BAGS.format(k=4, t='(SELECT vec_id AS id, label FROM embeddings)')} SELECT bg.label, CAST(bag AS INT) AS bag, CAST(idx AS INT) AS idx, round(avg(value), 6) + 0.0 AS value FROM bg JOIN feats USING (id) WHERE bag < n GROUP BY ALL")
def bag_means(spark, sf):
    f = _feats(spark, sf)
    b = evaluate.bags(fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label"), 4)
    return _round(evaluate.bag_means(b, f.drop("label")), "value")


def _sql_metrics(by: str, source: str, p: str = "prediction", mark: str = "", n: str = "1") -> str:
    """mt with accuracy and macro_f1 of the rows of source, each counted n times, by the columns in by; its tables' names end in mark."""
    k = by + ", " if by else ""
    return f"""tr{mark} AS (SELECT {k}label, sum({n}) AS n, coalesce(sum({n}) FILTER (label = {p}), 0) AS tp FROM {source} GROUP BY ALL), sd{mark} AS (SELECT {k}{p} AS label, sum({n}) AS said FROM {source} GROUP BY ALL),
mt{mark} AS (SELECT {k}sum(tp) / sum(n) AS accuracy, avg(2 * tp / (n + coalesce(said, 0))) AS macro_f1 FROM tr{mark} LEFT JOIN sd{mark} USING ({k}label) {'GROUP BY ' + by if by else ''})"""


@query(f"{L}, {_sql_metrics('', 'predicted')} SELECT round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1 FROM mt")
def confusion_metrics(spark, sf):
    return _round(evaluate.metrics(fx.predictions(spark, sf)), "accuracy", "macro_f1")


@query(f"{L}, pf AS (SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY id) - 1) % 5 AS fold FROM predicted), {_sql_metrics('fold', 'pf')} SELECT round(avg(accuracy), 6) AS mean, round(stddev_samp(accuracy), 6) AS sd, round(min(accuracy), 6) AS min, round(max(accuracy), 6) AS max FROM mt")
def fold_metrics(spark, sf):
    f = evaluate.stratified_folds(fx.predictions(spark, sf), 5)
    return _round(evaluate.fold_summary(evaluate.metrics(f, ("fold",)), "accuracy"), "mean", "sd", "min", "max")


@query(f"{L} SELECT stratum, round(a - b, 6) + 0.0 AS difference FROM (SELECT stratum, avg(CASE WHEN label = prediction THEN 1.0::DOUBLE ELSE 0 END) AS a, avg(CASE WHEN label = second THEN 1.0::DOUBLE ELSE 0 END) AS b FROM predicted GROUP BY 1)")
def paired_difference(spark, sf):
    p = fx.predictions(spark, sf)
    acc = lambda c: p.groupBy("stratum").agg(F.avg(F.when(F.col(c) == F.col("label"), 1.0).otherwise(0.0)).alias("a"))
    return _round(evaluate.paired_difference(acc("prediction"), acc("second"), "stratum", "a"), "difference")


REPLICATES = 10_000
#: Replicates of the queries whose single draws SQL repeats.
REPEATED = 40


def _sql_draws(source: str, cells: str) -> str:
    """rs (replicate, stratum, cells, c): how often each replicate draws each cell; a stratum's samples are drawn from in order of their cells, by numbers that both engines compute alike."""
    return f"""sizes AS (SELECT stratum, count(*) AS n, CAST('0x' || substr(md5('17:' || stratum), 1, 8) AS BIGINT) % 2147483647 AS key FROM {source} GROUP BY 1),
mix AS (SELECT r.range AS replicate, stratum, n, ((key + (r.range * 1000003) % 2147483647 + (i.i * 7919) % 2147483647) % 2147483647 * 48271 + 11) % 2147483647 AS a FROM (SELECT *, unnest(range(n)) AS i FROM sizes) i, range({REPEATED}) r),
ask AS (SELECT replicate, stratum, ((xor(a, a >> 13) * 69621 + 7) % 2147483647) % n AS pick, count(*) AS times FROM mix GROUP BY ALL),
cells AS (SELECT stratum, {cells}, count(*) AS k FROM {source} GROUP BY ALL), edges AS (SELECT *, sum(k) OVER (PARTITION BY stratum ORDER BY {cells}) AS upto FROM cells),
places AS (SELECT stratum, {cells}, unnest(range(CAST(upto - k AS BIGINT), CAST(upto AS BIGINT))) AS pick FROM edges),
rs AS (SELECT replicate, {cells}, CAST(sum(times) AS BIGINT) AS c FROM ask JOIN places USING (stratum, pick) GROUP BY ALL)"""


def _sql_intervals(values: str, observed: str, what: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS metric, round((SELECT {c} FROM {observed}), 6) + 0.0 AS observed, round(avg({c}), 6) + 0.0 AS mean, round(stddev_samp({c}), 6) AS sd, round(quantile_cont({c}, 0.025), 6) + 0.0 AS lower, round(quantile_cont({c}, 0.975), 6) + 0.0 AS upper FROM {values}" for name, c in what)


_PAIR_OF = "SELECT {k}x.accuracy AS a1, y.accuracy AS a2, x.accuracy - y.accuracy AS a3, x.macro_f1 AS f1, y.macro_f1 AS f2, x.macro_f1 - y.macro_f1 AS f3 FROM {x} x {y}"
_SIX = [("accuracy first", "a1"), ("accuracy second", "a2"), ("accuracy difference", "a3"), ("macro_f1 first", "f1"), ("macro_f1 second", "f2"), ("macro_f1 difference", "f3")]
_RANGES = ("observed", "mean", "sd", "lower", "upper")


@query(f"{L}, {_sql_draws('predicted', 'label, prediction')}, {_sql_metrics('replicate', 'rs', n='c')}, {_sql_metrics('', 'predicted', mark='0')} " + _sql_intervals("mt", "mt0", [("accuracy", "accuracy"), ("macro_f1", "macro_f1")]))
def bootstrap_ci_repeatable(spark, sf):
    """Every draw by itself, as SQL makes it; ``bootstrap_ci`` is the production form."""
    return _round(evaluate.bootstrap(fx.predictions(spark, sf), REPEATED, 17, draw=evaluate.shared_draw), *_RANGES)


@query()
def bootstrap_ci(spark, sf):
    return _round(evaluate.bootstrap(fx.predictions(spark, sf), REPLICATES, 17), *_RANGES)


@query(f"{L}, {_sql_draws('predicted', 'label, prediction, second')}, {_sql_metrics('replicate', 'rs', n='c')}, {_sql_metrics('replicate', 'rs', 'second', '2', 'c')}, {_sql_metrics('', 'predicted', mark='3')}, {_sql_metrics('', 'predicted', 'second', '4')}, df AS ({_PAIR_OF.format(k='', x='mt', y='JOIN mt2 y USING (replicate)')}), ob AS ({_PAIR_OF.format(k='', x='mt3', y=', mt4 y')}) " + _sql_intervals("df", "ob", _SIX))
def paired_bootstrap_ci_repeatable(spark, sf):
    return _round(evaluate.paired_bootstrap(fx.predictions(spark, sf), REPEATED, 17, draw=evaluate.shared_draw), *_RANGES)


@query()
def paired_bootstrap_ci(spark, sf):
    return _round(evaluate.paired_bootstrap(fx.predictions(spark, sf), REPLICATES, 17), *_RANGES)


_MORE = "many AS (SELECT *, prediction AS p0, CASE WHEN id % 5 = 0 THEN second ELSE prediction END AS p1, CASE WHEN id % 11 = 0 THEN second ELSE prediction END AS p2 FROM predicted)"
_EACH = ", ".join(_sql_metrics("replicate", "rs", f"p{i}", f"r{i}", "c") + ", " + _sql_metrics("", "many", f"p{i}", f"o{i}") for i in range(3))
_ROUNDS = f"""rk AS (SELECT CAST('0x' || substr(md5('17:realization'), 1, 8) AS BIGINT) % 2147483647 AS key), rm AS (SELECT r.range AS replicate, ((key + (r.range * 1000003) % 2147483647 + (i.range * 7919) % 2147483647) % 2147483647 * 48271 + 11) % 2147483647 AS a FROM rk, range(3) i, range({REPEATED}) r),
rw AS (SELECT replicate, ((xor(a, a >> 13) * 69621 + 7) % 2147483647) % 3 AS pick, count(*) AS w FROM rm GROUP BY ALL)"""


@query(f"{L}, {_MORE}, {_sql_draws('many', 'label, p0, p1, p2, second')}, {_EACH}, {_sql_metrics('replicate', 'rs', 'second', '2', 'c')}, {_sql_metrics('', 'many', 'second', '4')}, {_ROUNDS}, al AS (" + " UNION ALL ".join(f"SELECT replicate, {i} AS pick, accuracy, macro_f1 FROM mtr{i}" for i in range(3)) + f"), ms AS (SELECT replicate, sum(w * accuracy) / 3 AS accuracy, sum(w * macro_f1) / 3 AS macro_f1 FROM al JOIN rw USING (replicate, pick) GROUP BY 1), mo AS (SELECT avg(accuracy) AS accuracy, avg(macro_f1) AS macro_f1 FROM (" + " UNION ALL ".join(f"SELECT * FROM mto{i}" for i in range(3)) + f")), df AS ({_PAIR_OF.format(k='', x='ms', y='JOIN mt2 y USING (replicate)')}), ob AS ({_PAIR_OF.format(k='', x='mo', y=', mt4 y')}) " + _sql_intervals("df", "ob", _SIX))
def hierarchical_bootstrap_ci_repeatable(spark, sf):
    return _round(evaluate.hierarchical_bootstrap(_realizations(spark, sf), REPEATED, 17, draw=evaluate.shared_draw), *_RANGES)


def _realizations(spark, sf):
    p = fx.predictions(spark, sf)
    other = lambda k: F.when(F.col("id") % k == 0, F.col("second")).otherwise(F.col("prediction"))
    return p.select("id", "stratum", "label", "second", F.posexplode(F.array("prediction", other(5), other(11))).alias("realization", "prediction"))


@query()
def hierarchical_bootstrap_ci(spark, sf):
    return _round(evaluate.hierarchical_bootstrap(_realizations(spark, sf), REPLICATES, 17), *_RANGES)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS mean, median(l_quantity) AS median, round(stddev_samp(l_quantity), 6) AS sd FROM lineitem GROUP BY 1, 2")
def timing_summary(spark, sf):
    return _round(evaluate.timing_summary(fx.table(spark, sf, "lineitem"), ("l_returnflag", "l_linestatus"), "l_quantity"), "mean", "sd")


@query()
def kernel_svm(spark, sf):
    e = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("label"), F.col("label").alias("stratum"), F.col("embedding").cast("array<double>").alias("vector"))
    return svm.cross_validate(evaluate.stratified_folds(e, 4).drop("stratum"))


_STUDY = StudyConfig(characters=8, features=24, graphs_per_class=3, outer_folds=3, inner_folds=2, costs=(1.0, 10.0), replicates=1000, resolution=8, image_size=(5, 5))
_RATES = ("accuracy", "macro_f1", "lower", "upper")


@query()
def classification_study(spark, sf):
    """Graphs of windows of events, told apart by type with four kinds of vectors and nested cross-validation."""
    return _round(studies.vector_study(*studies.labelled_graphs(fx.window_graphs(spark, sf)), _STUDY), *_RATES)


@query()
def ablation_study(spark, sf):
    return _round(studies.ablation_study(*studies.labelled_graphs(fx.window_graphs(spark, sf), 2), _STUDY), *_RATES)


@query()
def batch_size_study(spark, sf):
    return _round(studies.batch_size_study(*studies.labelled_graphs(fx.window_graphs(spark, sf), 3), _STUDY, (1, 2, 3)), *_RATES)


@query()
def character_study(spark, sf):
    return _round(studies.character_study(*studies.labelled_graphs(fx.window_graphs(spark, sf), 2), _STUDY, (8, 16, 24)), *_RATES)


@query()
def robustness_study(spark, sf):
    return _round(studies.robustness_study(*studies.labelled_graphs(fx.window_graphs(spark, sf), 2), _STUDY), *_RANGES)


@query()
def collection_study(spark, sf):
    """The graphs of windows as a labelled collection, filtered by clique cohesion."""
    e = fx.window_graphs(spark, sf)
    return _round(studies.collection_study(e.select("g", "label").distinct(), e.select("g", "u", "v"), _STUDY), *_RATES)


@query("WITH w AS (SELECT o_custkey % 20 AS g, o_orderkey AS i, o_totalprice AS w FROM orders), e AS (SELECT g, i, sum(w) OVER (PARTITION BY g ORDER BY i) / sum(w) OVER (PARTITION BY g) AS at FROM w), d AS (SELECT c_custkey AS draw, c_custkey % 20 AS g, (c_custkey * 37 % 101) / 101.0::DOUBLE AS u FROM customer) SELECT d.g, draw, round(u, 6) AS u, min(i) AS i FROM d JOIN e ON e.g = d.g AND d.u < e.at GROUP BY 1, 2, 3")
def weighted_pick(spark, sf):
    w = fx.table(spark, sf, "orders").select((F.col("o_custkey") % 20).alias("g"), F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("w"))
    d = fx.table(spark, sf, "customer").select((F.col("c_custkey") % 20).alias("g"), F.col("c_custkey").alias("draw"), ((F.col("c_custkey") * 37 % 101) / 101.0).alias("u"))
    return _round(sample.weighted_pick(w, d), "u")


# ---- tables that runs leave


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0)")
def filtered_rewrite(spark, sf):
    gone = fx.table(spark, sf, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return tables.without_keys(fx.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey")


@query("SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0)")
def unfinished_keys(spark, sf):
    done = fx.table(spark, sf, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"))
    return tables.unfinished(fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")), done, "k")


@query("SELECT c_custkey AS g, c_acctbal AS balance, CAST(c_nationkey AS DOUBLE) AS nation FROM customer")
def wide_fields(spark, sf):
    c = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("g"), F.col("c_acctbal").cast("double").alias("balance"), F.col("c_nationkey").cast("double").alias("nation"))
    return tables.wide_fields(tables.long_fields(c, ["balance", "nation"]), ["balance", "nation"])


@query(f"{A}, o AS (SELECT s_suppkey AS g FROM supplier) SELECT o.g, count(atoms.obs) AS n, coalesce(round(min(birth), 6), -1) AS first FROM o LEFT JOIN atoms ON atoms.obs = o.g AND o.g % 3 <> 0 GROUP BY 1")
def graph_diagrams(spark, sf):
    g = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("g"))
    d = tables.with_edges(g, fx.atoms(spark, sf).where("obs % 3 <> 0").withColumnRenamed("obs", "g"))
    return d.select("g", F.size("diagram").cast("long").alias("n"), F.coalesce(r6(F.get("diagram", F.lit(0))["birth"]), F.lit(-1.0)).alias("first"))


@query(f"{E}, {_RANK.format(t='edges')}, r AS (SELECT g, count(*) AS edge_count FROM fl GROUP BY 1) SELECT g, CASE WHEN g = 'click' THEN edge_count + 1 ELSE edge_count END AS edge_count, edge_count AS found FROM r WHERE g = 'click'")
def union_records(spark, sf):
    e = graph.rank_filtration(fx.edges(spark, sf)).select("g", F.lit("edge").alias("record_type"), "u", "v", "step", "time")
    n = e.groupBy("g").agg(F.count("*").alias("c")).select("g", F.lit("graph").alias("record_type"), F.lit(0).alias("n"), F.when(F.col("g") == "click", F.col("c") + 1).otherwise(F.col("c")).alias("edge_count"))
    return tables.union_violations(n.unionByName(e, allowMissingColumns=True))


_TU = """gr AS (SELECT g, row_number() OVER (ORDER BY g) AS number, length(g) AS label FROM (SELECT DISTINCT g FROM edges)),
vx AS (SELECT g, v, row_number() OVER (PARTITION BY g ORDER BY v) - 1 AS local FROM (SELECT g, u AS v FROM edges UNION SELECT g, v FROM edges))"""


def _collection(spark, sf):
    """The events' graphs as a text collection, read again."""
    e, folder = fx.edges(spark, sf), tables.scratch(spark, "collection")
    tu.write(e.select("g").distinct().withColumn("label", F.length("g")), graph.vertices(e), e.select("g", "u", "v", "formation"), folder, "EVENTS")
    return tu.read(spark, folder, "EVENTS", strict=True)


@query(f"{E}, {_TU} SELECT CAST(number AS BIGINT) AS g, label::INT AS label, count(*) AS n FROM gr JOIN vx USING (g) GROUP BY 1, 2")
def collection_graphs(spark, sf):
    return _collection(spark, sf)["graphs"]


@query(f"{E}, {_TU} SELECT CAST(number AS INT) AS g, CAST(least(a.local, b.local) AS INT) AS u, CAST(greatest(a.local, b.local) AS INT) AS v, CAST(2 * (row_number() OVER (ORDER BY number, formation) - 1) + 1 AS BIGINT) AS formation FROM edges JOIN gr USING (g) JOIN vx a ON a.g = edges.g AND a.v = edges.u JOIN vx b ON b.g = edges.g AND b.v = edges.v")
def collection_edges(spark, sf):
    return _collection(spark, sf)["edges"].select("g", "u", "v", "formation")


@query("SELECT o_orderkey, o_custkey, o_orderstatus || '\"' || chr(10) || ',' AS note, round(o_totalprice, 2) + 0.0 AS price FROM orders")
def csv_round_trip(spark, sf):
    """Quotes, commas and line breaks; a third of the rows is written first, the rest by a run that resumes."""
    o = fx.table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.concat("o_orderstatus", F.lit('"\n,')).alias("note"), (F.round("o_totalprice", 2) + F.lit(0.0)).alias("price"))
    path = tables.scratch(spark, "csv")
    tables.append_csv(o.where("o_orderkey % 3 = 0"), path, "o_orderkey")
    tables.append_csv(o, path, "o_orderkey")
    return tables.read_csv(spark, path, o.schema)


@query("SELECT o_orderkey, o_custkey, o_orderstatus || '\"' || chr(10) || ',' AS note, round(o_totalprice, 2) + 0.0 AS price FROM orders")
def csv_by_splits(spark, sf):
    """The same written as CSV in files without a marker, read by splits, and published in two runs of which the second offers all rows again."""
    o = fx.table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.concat("o_orderstatus", F.lit('"\n,')).alias("note"), (F.round("o_totalprice", 2) + F.lit(0.0)).alias("price"))
    path = tables.scratch(spark, "csv")
    tables.write_csv(o, path)
    rows = records.read_csv(spark, path, o.schema)
    records.append(rows.where("o_orderkey % 3 = 0"), path + "-published", "o_orderkey")
    records.append(rows, path + "-published", "o_orderkey")
    return records.read(spark, path + "-published", o.schema)


@query("SELECT CAST(3 AS INT) AS schema_version, s_nationkey, s_suppkey, CAST(row_number() OVER (ORDER BY s_nationkey, s_suppkey) - 1 AS INT) AS place FROM supplier")
def result_round_trip(spark, sf):
    path = tables.scratch(spark, "result")
    tables.write_result(fx.table(spark, sf, "supplier").select("s_nationkey", "s_suppkey"), path, 3, "s_nationkey", "s_suppkey")
    return tables.ranked(spark.read.parquet(path), "s_nationkey", "s_suppkey")


# ---- quality


@query("SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return quality.duplicate_keys(fx.table(spark, sf, "lineitem"), "l_orderkey", "l_suppkey")


@query("WITH h AS (SELECT DISTINCT l_orderkey, CAST(l_linenumber * 2 - 2 AS BIGINT) AS i FROM lineitem), w AS (SELECT l_orderkey, unnest(range(count(*))) AS i FROM lineitem GROUP BY 1) SELECT l_orderkey, i, 'missing' AS why FROM (SELECT * FROM w EXCEPT SELECT * FROM h) UNION ALL SELECT l_orderkey, i, 'extra' FROM (SELECT * FROM h EXCEPT SELECT * FROM w)")
def contiguous_check(spark, sf):
    return quality.gaps(fx.table(spark, sf, "lineitem").withColumn("i", F.col("l_linenumber") * 2 - 2), "i", "l_orderkey")


@query("SELECT c_custkey AS k, 'first' AS why FROM (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0 EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 5 = 0) UNION ALL SELECT o_custkey, 'second' FROM (SELECT o_custkey FROM orders WHERE o_orderkey % 5 = 0 EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)")
def key_set_check(spark, sf):
    return quality.key_differences(fx.table(spark, sf, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k")), fx.table(spark, sf, "orders").where("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("k")), "k")


@query("WITH a AS (SELECT DISTINCT s_suppkey AS l_suppkey FROM supplier), b AS (SELECT DISTINCT l_discount FROM lineitem), c AS (SELECT DISTINCT l_linenumber FROM lineitem), h AS (SELECT DISTINCT l_suppkey, l_discount, l_linenumber FROM lineitem), w AS (SELECT l_suppkey, l_discount, l_linenumber FROM a, b, c) SELECT *, 'missing' AS why FROM (SELECT * FROM w EXCEPT SELECT * FROM h) UNION ALL SELECT *, 'extra' FROM (SELECT * FROM h EXCEPT SELECT * FROM w)")
def cartesian_check(spark, sf):
    """Whether every supplier has sold at every discount on every line number."""
    t = fx.table(spark, sf, "lineitem")
    return quality.domain_differences(t, [fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey")), t.select("l_discount"), t.select("l_linenumber")])

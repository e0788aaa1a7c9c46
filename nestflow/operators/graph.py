"""Simple undirected graphs as edge rows (g, u, v, ...), u < v, and their filtrations. Built-in functions only, but for the truss kernel."""
from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..stages import Stages
from .numbering import numbered


def canonical(edges: DataFrame, order: str = "formation") -> DataFrame:
    """(least, greatest) pairs without loops; of equal edges of a graph the first in ``order`` stays."""
    e = edges.where("u <> v").withColumn("a", F.least("u", "v")).withColumn("b", F.greatest("u", "v"))
    rest = [c for c in edges.columns if c not in ("g", "u", "v")]
    first = e.groupBy("g", "a", "b").agg(F.min_by(F.struct(*rest), order).alias("x"))
    return first.select("g", F.col("a").alias("u"), F.col("b").alias("v"), *[F.col("x." + c).alias(c) for c in rest])


def has_edge(probes: DataFrame, edges: DataFrame) -> DataFrame:
    """Those probes (g, u, v) that are edges, in either direction."""
    p = probes.withColumn("a", F.least("u", "v")).withColumn("b", F.greatest("u", "v"))
    e = edges.select("g", F.col("u").alias("a"), F.col("v").alias("b"))
    return p.join(e, ["g", "a", "b"], "left_semi").select(*probes.columns)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("g", "u", "v").unionByName(edges.select("g", F.col("v").alias("u"), F.col("u").alias("v")))


def vertices(edges: DataFrame) -> DataFrame:
    return both_ways(edges).select("g", "u").distinct().withColumnRenamed("u", "v")


def dyads(graphs: DataFrame) -> DataFrame:
    """All pairs u < v of the vertices 0 to n - 1 of (g, n); made by sequences, not by a join."""
    u = graphs.select("g", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n") - 2, F.lit(0)).cast("long"))).alias("u"))
    return u.where("u + 1 < n").select("g", "u", F.explode(F.sequence(F.col("u") + 1, F.col("n").cast("long") - 1)).alias("v"))


def non_edges(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    return pairs.join(edges.select("g", "u", "v"), ["g", "u", "v"], "left_anti")


def rank_filtration(edges: DataFrame) -> DataFrame:
    """Adds step (from 1) and time in [0, 1]: support falling, then formation, then the pair."""
    e = numbered(edges, ["g"], ["-support", "formation", "u", "v"], "step", size="_n")
    return e.withColumn("time", (F.col("step") - 1) / F.greatest(F.col("_n") - 1, F.lit(1))).drop("_n")


def dense_steps(edges: DataFrame) -> DataFrame:
    """Adds step by time; edges of one time share it."""
    return numbered(edges, ["g"], ["time", "u", "v"], rank=("step", 1))


def ordered_field(edges: DataFrame, fields: DataFrame) -> DataFrame:
    """g, step, value: a field of (g, u, v, value) in filtration order."""
    return edges.join(fields, ["g", "u", "v"]).select("g", "step", "value")


def adjacency(edges: DataFrame) -> DataFrame:
    """g, v, neighbours in ascending order."""
    return both_ways(edges).groupBy("g", F.col("u").alias("vertex")).agg(F.sort_array(F.collect_set("v")).alias("neighbours"))


def edge_index(edges: DataFrame) -> DataFrame:
    """Adds the edge's place in the order of pairs, from 0."""
    return numbered(edges, ["g"], ["u", "v"], "index").withColumn("index", F.col("index") - 1)


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("g", F.col("u").alias("vertex")).agg(F.count("*").alias("degree"))


def triangles(edges: DataFrame) -> DataFrame:
    """g, a, b, c with a < b < c.

    Each edge points from its end of lower degree to the other, so no vertex has many successors, and two successors of a vertex are looked up among the edges.
    """
    d = degrees(edges)
    e = edges.select("g", "u", "v")
    e = e.join(d.select("g", F.col("vertex").alias("u"), F.col("degree").alias("du")), ["g", "u"]).join(d.select("g", F.col("vertex").alias("v"), F.col("degree").alias("dv")), ["g", "v"])
    up = F.struct("du", "u") < F.struct("dv", "v")
    o = e.select("g", F.when(up, F.col("u")).otherwise(F.col("v")).alias("x"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("y"))
    wedge = o.join(o.withColumnRenamed("y", "z"), ["g", "x"]).where("y < z")
    found = wedge.join(edges.select("g", F.col("u").alias("y"), F.col("v").alias("z")), ["g", "y", "z"])
    t = F.array_sort(F.array("x", "y", "z"))
    return found.select("g", t[0].alias("a"), t[1].alias("b"), t[2].alias("c"))


def triangle_support(edges: DataFrame) -> DataFrame:
    """g, u, v, triangles: how many triangles hold each edge."""
    t = triangles(edges)
    sides = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("a").alias("u"), F.col("c").alias("v")), F.struct(F.col("b").alias("u"), F.col("c").alias("v"))))
    n = t.select("g", sides.alias("s")).groupBy("g", "s.u", "s.v").agg(F.count("*").alias("n"))
    return edges.select("g", "u", "v").join(n, ["g", "u", "v"], "left").select("g", "u", "v", F.coalesce("n", F.lit(0)).alias("triangles"))


#: Edges of a graph up to which one task peels it.
KERNEL_EDGES = 1_000_000


def trussness(edges: DataFrame, most: int = KERNEL_EDGES) -> DataFrame:
    """g, u, v, trussness: the largest k for which the edge lies in k - 2 triangles of a subgraph of such edges. Graphs of up to ``most`` edges are peeled in a task each, larger ones by ``trussness_spread``."""
    sizes = edges.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > most).select("g")
    if not sizes.limit(1).count():
        return trussness_kernel(edges)
    return trussness_kernel(edges.join(sizes, "g", "left_anti")).unionByName(trussness_spread(edges.join(sizes, "g", "left_semi")))


def trussness_spread(edges: DataFrame) -> DataFrame:
    """The same by joins and aggregates alone: an edge's level starts as its number of triangles and falls to the h-index of what its triangles' other two edges allow, until none falls.

    Each pass is written to the shared folder and read again: the plan of a pass, and what the optimizer makes of its size, does not grow with their number.
    """
    stages = Stages(edges.sparkSession, "trussness")
    edges = stages.keep(edges.select("g", "u", "v"))  # read many times below
    side = lambda x, y: F.struct(F.col(x).alias("u"), F.col(y).alias("v"))
    ab, ac, bc = side("a", "b"), side("a", "c"), side("b", "c")
    three = F.array(*[F.struct(e.alias("e"), f.alias("f"), h.alias("h")) for e, f, h in ((ab, ac, bc), (ac, ab, bc), (bc, ab, ac))])
    sides = stages.keep(triangles(edges).select("g", F.explode(three).alias("x")).select("g", "x.e", "x.f", "x.h"))
    level = stages.keep(sides.groupBy("g", "e").agg(F.count("*").cast("int").alias("level")))
    while True:
        of = lambda name, as_: level.select("g", F.col("e").alias(name), F.col("level").alias(as_))
        least = sides.join(of("f", "l1"), ["g", "f"]).join(of("h", "l2"), ["g", "h"]).groupBy("g", "e").agg(F.sort_array(F.collect_list(F.least("l1", "l2")), False).alias("x"))
        new = stages.keep(least.join(level, ["g", "e"]).select("g", "e", F.least("level", F.size(F.filter("x", lambda x, i: x > i))).alias("level"), F.col("level").alias("old")))
        stages.drop(level)
        level = new
        if not new.where("level < old").limit(1).count():
            break
    found = level.select("g", "e.u", "e.v", (F.col("level") + 2).cast("int").alias("trussness"))
    return edges.select("g", "u", "v").join(found, ["g", "u", "v"], "left").select("g", "u", "v", F.coalesce("trussness", F.lit(2)).alias("trussness"))


def trussness_kernel(edges: DataFrame) -> DataFrame:
    """The same, each graph peeled in one task from the weakest edge on."""
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = list(zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True))
        near: dict = {}
        for a, b in pairs:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        left = {e: len(near[e[0]] & near[e[1]]) for e in pairs}
        heap, out, k = [(n, e) for e, n in left.items()], {}, 0
        heapq.heapify(heap)
        while heap:
            n, e = heapq.heappop(heap)
            if e in out or n != left[e]:
                continue
            k = max(k, n)
            out[e] = k + 2
            a, b = e
            for c in near[a] & near[b]:
                for f in ((min(a, c), max(a, c)), (min(b, c), max(b, c))):
                    left[f] -= 1
                    heapq.heappush(heap, (left[f], f))
            near[a].discard(b)
            near[b].discard(a)
        return pdf.assign(g=pdf["g"].to_numpy(object), trussness=[out[e] for e in pairs])

    return edges.select("g", "u", "v").groupBy("g").applyInPandas(run, f"g {kinds['g']}, u {kinds['u']}, v {kinds['v']}, trussness int")


def cohesion(edges: DataFrame, truss: DataFrame) -> DataFrame:
    """g, u, v, trussness, common, available, num, den: common neighbours over what the smaller degree allows, as a reduced fraction (1 if nothing is allowed)."""
    d = degrees(edges)
    s = triangle_support(edges).join(truss, ["g", "u", "v"])
    s = s.join(d.select("g", F.col("vertex").alias("u"), F.col("degree").alias("du")), ["g", "u"]).join(d.select("g", F.col("vertex").alias("v"), F.col("degree").alias("dv")), ["g", "v"])
    s = s.withColumn("available", F.least(F.col("du") - 1, F.col("dv") - 1)).withColumnRenamed("triangles", "common")
    num = F.when(F.col("available") == 0, 1).otherwise(F.col("common"))
    den = F.when(F.col("available") == 0, 1).otherwise(F.col("available"))
    return s.select("g", "u", "v", "trussness", "common", "available", num.cast("long").alias("num"), den.cast("long").alias("den"))


def cohesion_filtration(keys: DataFrame) -> DataFrame:
    """Adds step and time = step / (steps + 1), below 1: strongest first by trussness, then by ratio; equal keys share a step.

    Two different ratios of graphs of up to 9 x 10^7 neighbours differ in the 16 decimals that are compared, and equal ones have equal decimals.
    """
    ratio = F.floor(F.col("num").cast("decimal(19,0)") * F.lit(10**16).cast("decimal(18,0)") / F.col("den").cast("decimal(19,0)"))
    k = numbered(keys.withColumn("ratio", ratio), ["g"], ["-trussness", "-ratio", "u", "v"], rank=("step", 2), last_rank="_n")
    return k.withColumn("time", F.col("step") / (F.col("_n") + 1)).drop("ratio", "_n")


def clique_complex(edges: DataFrame) -> DataFrame:
    """g, vertices, dim, filtration, place: vertices at 0, edges at their time, triangles at the latest time of their edges.

    place counts from 0 in order of filtration, dimension and vertices.
    """
    v = vertices(edges).select("g", F.array("v").alias("vertices"), F.lit(0).alias("dim"), F.lit(0.0).alias("filtration"))
    e = edges.select("g", F.array("u", "v").alias("vertices"), F.lit(1).alias("dim"), F.col("time").alias("filtration"))
    t = triangles(edges)
    for i, (x, y) in enumerate((("a", "b"), ("a", "c"), ("b", "c"))):
        t = t.join(edges.select("g", F.col("u").alias(x), F.col("v").alias(y), F.col("time").alias(f"t{i}")), ["g", x, y])
    t = t.select("g", F.array("a", "b", "c").alias("vertices"), F.lit(2).alias("dim"), F.greatest("t0", "t1", "t2").alias("filtration"))
    return numbered(v.unionByName(e).unionByName(t), ["g"], ["filtration", "dim", "vertices"], "place").withColumn("place", F.col("place") - 1)


def graph_statistics(edges: DataFrame, graphs: DataFrame | None = None) -> DataFrame:
    """g, vertices, edges, density, mean_degree, clustering. graphs: (g, n) where vertices without an edge count too."""
    d = degrees(edges)
    t = triangles(edges)
    corner = t.select("g", F.explode(F.array("a", "b", "c")).alias("vertex")).groupBy("g", "vertex").agg(F.count("*").alias("t"))
    c = F.when(F.col("degree") >= 2, 2 * F.coalesce("t", F.lit(0)) / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0)
    per = d.join(corner, ["g", "vertex"], "left").groupBy("g").agg(F.count("*").alias("seen"), F.sum("degree").alias("total"), F.sum(c).alias("c"))
    per = per.withColumn("vertices", F.col("seen")) if graphs is None else graphs.join(per, "g", "left").withColumn("vertices", F.col("n").cast("long"))
    n, m = F.col("vertices"), F.coalesce(F.col("total"), F.lit(0)) / 2
    return per.select("g", "vertices", m.cast("long").alias("edges"), F.when(n > 1, 2 * m / (n * (n - 1))).otherwise(0.0).alias("density"), (2 * m / n).alias("mean_degree"), (F.coalesce("c", F.lit(0.0)) / n).alias("clustering"))


def mean_statistics(statistics: DataFrame, members: DataFrame) -> DataFrame:
    """batch and the means of density, mean_degree and clustering over its graphs."""
    return members.join(statistics, "g").groupBy("batch").agg(*[F.avg(c).alias(c) for c in ("density", "mean_degree", "clustering")])


def edge_violations(edges: DataFrame, graphs: DataFrame) -> DataFrame:
    """(g, u, v, why): loops, vertices outside 0 to n - 1 of (g, n), edges of unknown graphs, and edges that occur more than once in either direction."""
    e = edges.select("g", "u", "v").join(graphs.select("g", "n"), "g", "left")
    e = e.withColumn("copies", F.count("*").over(Window.partitionBy("g", F.least("u", "v"), F.greatest("u", "v"))))
    why = F.when(F.col("n").isNull(), "unknown graph").when(F.col("u").isNull() | F.col("v").isNull(), "null").when(F.col("u") == F.col("v"), "loop").when((F.least("u", "v") < 0) | (F.greatest("u", "v") >= F.col("n")), "range").when(F.col("copies") > 1, "duplicate")
    return e.withColumn("why", why).where("why IS NOT NULL").select("g", "u", "v", "why")

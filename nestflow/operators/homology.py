"""Degree-one persistence over Z/2 of filtered clique complexes: a graph in a task, or ranges of a graph's boundary matrix."""
from __future__ import annotations

from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..stages import Stages
from .diagrams import clean
from .graph import both_ways, vertices
from .groups import dealt, groups
from .numbering import numbered


def intervals(edges: list[tuple[float, int, int]], triangles: list[tuple[float, int, int, int]]) -> list[tuple[float, float]]:
    """(birth, death) of every class of degree one, of length 0 too; a class that no triangle fills dies at 1.

    edges (time, u, v) and triangles (time, a, b, c) in order of appearance. An edge that joins two components bears no class, so union-find settles it
    without reduction, and only edges that close a cycle can be pivots.
    """
    place = {(u, v): i for i, (_, u, v) in enumerate(edges)}
    ends = np.unique(np.array([e[1:] for e in edges], np.int64), return_inverse=True)[1].reshape(-1, 2)
    sides = np.array([[place[a, b], place[a, c], place[b, c]] for _, a, b, c in triangles], np.int64).reshape(-1, 3)
    out = interval_arrays(np.array([e[0] for e in edges], float), ends, np.array([t[0] for t in triangles], float), sides)
    return list(map(tuple, out.tolist()))


def interval_arrays(times: np.ndarray, ends: np.ndarray, late: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """The same rows (birth, death) from arrays: times and ends (u, v) of edges, times of triangles and the places of their edges.

    Edges of the forest are no rows of the matrix, as in ``h1_spread``, and of a column that is reduced only its rows are held, as numbers side by side.
    """
    root = np.arange(ends.max(initial=-1) + 1).tolist()
    bears = np.zeros(len(times), bool)
    for at in range(0, len(times), 100_000):  # few numbers are Python's at a time
        for i, (a, b) in enumerate(ends[at : at + 100_000].tolist(), at):
            while root[a] != a:
                root[a] = a = root[root[a]]
            while root[b] != b:
                root[b] = b = root[root[b]]
            if a == b:
                bears[i] = True
            else:
                root[b] = a
    pivots: dict[int, array] = {}
    low_of, number = array("q"), array("q")
    for at in range(0, len(late), 100_000):
        for n, rows in enumerate(sides[at : at + 100_000].tolist(), at):
            column = {r for r in rows if bears[r]}
            while column:
                low = max(column)
                if low not in pivots:
                    pivots[low] = array("i", column)
                    low_of.append(low)
                    number.append(n)
                    break
                column.symmetric_difference_update(pivots[low])
    low, n = np.array(low_of, np.int64), np.array(number, np.int64)
    bears[low] = False
    return np.concatenate([np.column_stack([times[low], late[n]]), np.column_stack([times[bears], np.ones(bears.sum())])])


#: Simplices of a graph up to which one task reduces it.
KERNEL_SIMPLICES = 2_000_000


def h1(complex_: DataFrame, drop_empty: bool = True, most: int = KERNEL_SIMPLICES) -> DataFrame:
    """obs, birth, death, coefficient from clique_complex(); obs is the graph. Graphs of up to ``most`` simplices are reduced in a task each, larger ones by ``h1_spread``."""
    large = complex_.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > most).select("g")
    if not large.limit(1).count():
        return h1_kernel(complex_, drop_empty)
    return h1_kernel(complex_.join(large, "g", "left_anti"), drop_empty).unionByName(h1_spread(complex_.join(large, "g", "left_semi"), drop_empty=drop_empty))


def h1_kernel(complex_: DataFrame, drop_empty: bool = True) -> DataFrame:
    """The same, each graph in one task, which reads many graphs."""
    kind = complex_.schema["g"].dataType.simpleString()

    def reduced(t: pa.Table) -> np.ndarray:
        dim, time, place = (t.column(c).to_numpy() for c in ("dim", "filtration", "place"))
        lists = pa.concat_arrays(t.column("vertices").chunks)
        flat, start = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        edge, triangle = (np.nonzero(dim == d)[0] for d in (1, 2))
        edge, triangle = edge[place[edge].argsort(kind="stable")], triangle[place[triangle].argsort(kind="stable")]
        names = np.unique(flat)
        ends, corners = (np.searchsorted(names, flat[start[at][:, None] + np.arange(d)]) for at, d in ((edge, 2), (triangle, 3)))
        code = ends[:, 0] * len(names) + ends[:, 1]
        order = code.argsort()
        sides = order[np.searchsorted(code, corners[:, [0, 0, 1]] * len(names) + corners[:, [1, 2, 2]], sorter=order)] if len(triangle) else np.zeros((0, 3), np.int64)
        return interval_arrays(time[edge], ends, time[triangle], sides)

    def run(batches):
        keys, got = [], []
        for g, t in groups(batches):
            if t is not None:
                x = reduced(t)
                if len(x):
                    x = x[np.lexsort(x.T[::-1])]
                    heads = np.nonzero(np.concatenate([[True], (x[1:] != x[:-1]).any(1)]))[0]
                    keys.append(g)
                    got.append(np.column_stack([x[heads], np.diff(heads, append=len(x))]))
            elif got:
                obs = pa.concat_arrays(keys).take(pa.array(np.repeat(np.arange(len(got)), list(map(len, got)))))
                yield pa.RecordBatch.from_arrays([obs, *map(pa.array, np.ascontiguousarray(np.concatenate(got).T))], names=["obs", "birth", "death", "coefficient"])
                keys, got = [], []

    # vertices are not needed: an edge's ends name them
    rows = dealt(complex_.where("dim > 0").select("g", "vertices", "dim", "filtration", "place"), "g")
    out = rows.mapInArrow(run, f"obs {kind}, birth double, death double, coefficient double")
    return clean(out) if drop_empty else out


def class_count(edges: DataFrame) -> DataFrame:
    """g, classes: edges - vertices + components, what the coefficients of an uncleaned diagram add up to."""
    per = components(edges).groupBy("g").agg(F.count("*").alias("n"), F.countDistinct("c").alias("k"))
    return edges.groupBy("g").agg(F.count("*").alias("e")).join(per, "g").select("g", (F.col("e") - F.col("n") + F.col("k")).alias("classes"))


def components(edges: DataFrame) -> DataFrame:
    """g, v, c: the least vertex of each vertex's component, from a spanning forest's last labels."""
    return spanning_forest(edges.select("g", "u", "v", F.struct("u", "v").alias("place")))[1]


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((g, place) of the edges that join two components when edges (g, u, v, place) appear in order of place, (g, v, c) with the component of each vertex), by rounds.

    In a round every component takes its first outgoing edge, which belongs to the forest; components so joined become one, found by doubling of pointers, and edges within a component go. The number of components at least halves.
    """
    stages = Stages(edges.sparkSession, "forest")
    edges = edges.select("g", "u", "v", "place")
    label = stages.keep(vertices(edges).withColumn("c", F.col("v")))
    live = stages.keep(edges.select("g", "place", F.col("u").alias("a"), F.col("v").alias("b")))
    forest = None
    while live.limit(1).count():
        ends = live.select("g", F.col("a").alias("c"), F.col("b").alias("to"), "place").unionByName(live.select("g", F.col("b").alias("c"), F.col("a").alias("to"), "place"))
        first = stages.keep(ends.groupBy("g", "c").agg(F.min_by(F.struct("to", "place"), "place").alias("x")).select("g", "c", "x.to", "x.place"))
        taken = stages.keep(first.select("g", "place").distinct())
        forest = taken if forest is None else forest.unionByName(taken)
        # two components that take the same edge point at each other: the lesser one is the root
        back = first.select("g", F.col("c").alias("to"), F.col("to").alias("back"))
        up = first.join(back, ["g", "to"]).select("g", "c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("up"))
        up = stages.keep(up)
        while True:
            above = up.select("g", F.col("c").alias("up"), F.col("up").alias("top"))
            new = stages.keep(up.join(above, ["g", "up"]).select("g", "c", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
            stages.drop(up)
            up = new
            if not new.where("moved").limit(1).count():
                break
        of = lambda old, name: up.select("g", F.col("c").alias(old), F.col("up").alias(name))
        moved = live.join(of("a", "x"), ["g", "a"]).join(of("b", "y"), ["g", "b"]).where("x <> y")
        # of the edges between two components only the first can be taken
        live_new = stages.keep(moved.groupBy("g", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min("place").alias("place")).select("g", "place", "a", "b"))
        label_new = stages.keep(label.join(of("c", "top"), ["g", "c"], "left").select("g", "v", F.coalesce("top", "c").alias("c")))
        stages.drop(live, label, first, up)
        live, label = live_new, label_new
    if forest is None:
        forest = edges.where("false").select("g", "place")
    return forest, label.groupBy("g", "c").agg(F.min("v").alias("least")).join(label, ["g", "c"]).select("g", "v", F.col("least").alias("c"))


def reduce_range(columns: list[tuple[int, set[int]]], floor: int) -> list[tuple[int, list[int]]]:
    """Columns (number, rows) after left-to-right reduction as far as their lowest row stays at or above floor; empty ones are left out.

    A column is added only to columns with a higher number, so the pairs of the whole matrix stay what they are, whichever columns are still to come.
    """
    pivots: dict[int, tuple[int, set[int]]] = {}
    out: list[tuple[int, list[int]]] = []
    for number, column in sorted(columns, key=lambda c: c[0]):
        column = set(column)
        while column:
            low = max(column)
            if low < floor or low not in pivots:
                break
            column ^= pivots[low][1]
        if column:
            if max(column) >= floor:
                pivots[max(column)] = (number, column)
            out.append((number, sorted(column)))
    return out


def h1_spread(complex_: DataFrame, rows: int = 200_000, drop_empty: bool = True) -> DataFrame:
    """The same as ``h1`` with no task that holds a graph.

    An edge bears a class unless it is in the spanning forest, so only the others are rows of the matrix, and no column of edges is reduced. Columns (triangles) lie in the range of their lowest row, ranges holding about ``rows`` columns to start with; each
    is reduced within its range, and one whose lowest row leaves the range is passed on to a lower one. Rounds end when no column is passed on; then no two columns of the matrix share their lowest row.
    """
    stages = Stages(complex_.sparkSession, "h1")
    s = stages.keep(complex_.where("dim > 0").select("g", "vertices", "dim", "filtration", F.col("place").cast("long").alias("place")))
    edges = s.where("dim = 1").select("g", F.col("vertices")[0].alias("u"), F.col("vertices")[1].alias("v"), "filtration", "place")
    forest, _ = spanning_forest(edges)
    born = stages.keep(edges.join(forest, ["g", "place"], "left_anti"))
    sides = s.where("dim = 2").select("g", F.col("place").alias("number"), F.explode(F.expr("array(struct(vertices[0] AS u, vertices[1] AS v), struct(vertices[0] AS u, vertices[2] AS v), struct(vertices[1] AS u, vertices[2] AS v))")).alias("e"))
    sides = sides.select("g", "number", "e.u", "e.v").join(born.select("g", "u", "v", "place"), ["g", "u", "v"])
    columns = stages.keep(sides.groupBy("g", "number").agg(F.sort_array(F.collect_list("place")).alias("rows")))  # three at most
    # ranges of the lowest row, that hold about as many columns each
    low = numbered(columns.select("g", "number", F.element_at("rows", -1).alias("low")), ["g"], ["low", "number"], "_k")
    floors = low.groupBy("g", F.expr(f"(_k - 1) div {rows}").alias("range")).agg(F.min("low").alias("floor"))
    floors = stages.keep(floors.groupBy("g").agg(F.sort_array(F.collect_set("floor")).alias("floors")))  # a number for each range
    kind = complex_.schema["g"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        floor = int(pdf["floor"].iloc[0])
        got = reduce_range([(a, set(b)) for a, b in zip(pdf["number"], pdf["rows"], strict=True)], floor)
        rows = pd.Series([b for _, b in got], dtype=object)
        return pd.DataFrame({"g": np.full(len(got), pdf["g"].iloc[0], object), "number": np.array([a for a, _ in got], np.int64), "rows": rows, "moved": np.array([b[-1] < floor for _, b in got], bool)})

    while True:
        lies = columns.join(floors, "g").select("g", "number", "rows", F.expr("get(reverse(filter(floors, f -> f <= element_at(rows, -1))), 0)").alias("floor"))
        lies = lies.withColumn("floor", F.coalesce("floor", F.lit(0).cast("long")))  # passed on below the least of them
        new = stages.keep(lies.groupBy("g", "floor").applyInPandas(run, f"g {kind}, number long, rows array<long>, moved boolean"))
        stages.drop(columns)
        columns = new
        if not new.where("moved").limit(1).count():
            break
    died = columns.select("g", F.element_at("rows", -1).alias("place"), "number").join(s.where("dim = 2").select("g", F.col("place").alias("number"), F.col("filtration").alias("death")), ["g", "number"])
    out = born.join(died.select("g", "place", "death"), ["g", "place"], "left").groupBy(F.col("g").alias("obs"), F.col("filtration").alias("birth"), F.coalesce("death", F.lit(1.0)).alias("death")).agg(F.count("*").cast("double").alias("coefficient"))
    return clean(out) if drop_empty else out

"""Collections of labelled graphs as text: NAME_A.txt (u, v), NAME_graph_indicator.txt (graph of each vertex), NAME_graph_labels.txt.

Line numbers are the ids. They come from counts of lines in each block of each file, and a line's place in its block; no row goes through Python.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import canonical
from ..operators.numbering import numbered


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 1), value; files in the order of their names."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    blocks = rows.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    # a row for each block of a file
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("file", "start", (before - F.col("first") + 1).alias("shift"))
    return rows.join(F.broadcast(blocks), ["file", "start"]).select((F.col("at") + F.col("shift")).alias("line"), "value")


def _integer(text: str) -> Column:
    return F.expr(f"try_cast(trim({text}) as int)")


def read(spark: SparkSession, folder: str, name: str, strict: bool = False) -> dict[str, DataFrame]:
    """graphs (g, label, n), vertices (vertex, g, local) and edges (g, u, v, formation); ids of graphs and vertices are from 1, local ones from 0.

    Loops go, and of an edge that occurs in both directions the first stays. Lines that ``violations`` names are an error if ``strict``, and are left out otherwise.
    """
    if strict and (bad := violations(spark, folder, name).limit(5).collect()):
        raise ValueError(f"{folder}/{name}: {[tuple(r) for r in bad]}")
    v = numbered_lines(spark, f"{folder}/{name}_graph_indicator.txt").select(F.col("line").alias("vertex"), _integer("value").alias("g")).where("g IS NOT NULL")
    v = numbered(v, ["g"], ["vertex"], "local").withColumn("local", F.col("local") - 1)
    labels = numbered_lines(spark, f"{folder}/{name}_graph_labels.txt").select(F.col("line").alias("g"), _integer("value").alias("label"))
    graphs = labels.join(v.groupBy("g").agg(F.count("*").alias("n")), "g", "left").select("g", "label", F.coalesce("n", F.lit(0)).alias("n"))
    a = numbered_lines(spark, f"{folder}/{name}_A.txt").select(F.col("line").alias("formation"), _integer("get(split(value, ','), 0)").alias("a"), _integer("get(split(value, ','), 1)").alias("b"))
    e = a.join(v.select(F.col("vertex").alias("a"), "g", F.col("local").alias("u")), "a").join(v.select(F.col("vertex").alias("b"), F.col("g").alias("g2"), F.col("local").alias("v")), "b").where("g = g2")
    return {"graphs": graphs, "vertices": v, "edges": canonical(e.select("g", "u", "v", "formation"))}


def write(graphs: DataFrame, vertices: DataFrame, edges: DataFrame, folder: str, name: str) -> None:
    """The three files of graphs (g, label), vertices (g, v) and edges (g, u, v, formation), both directions of an edge one after the other. Graphs and vertices are numbered from 1 in order of g and v.

    Each is a folder of files whose names are in the order of their lines, as ``read`` takes them; put together in that order they are the file of the form.
    """
    g = numbered(graphs.select("g", "label"), [], ["g"], "number")
    v = numbered(vertices.join(g, "g").select("g", "v", "number"), [], ["number", "v"], "vertex")
    e = edges.join(v.select("g", F.col("v").alias("u"), F.col("vertex").alias("a"), "number"), ["g", "u"]).join(v.select("g", "v", F.col("vertex").alias("b")), ["g", "v"])
    e = e.select("number", "formation", F.posexplode(F.array(F.concat_ws(", ", "a", "b"), F.concat_ws(", ", "b", "a"))).alias("k", "value"))
    for part, table, order in (("graph_labels", g.select("number", F.col("label").cast("string").alias("value")), ["number"]), ("graph_indicator", v.select("vertex", F.col("number").cast("string").alias("value")), ["vertex"]), ("A", e, ["number", "formation", "value"])):
        table.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.mode("overwrite").text(f"{folder}/{name}_{part}.txt")


def violations(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """(file, line, why) of blank lines, lines of another form, unknown vertices and edges between graphs."""
    out = []
    for part, form in (("graph_indicator", r"^\s*[+-]?\d+\s*$"), ("graph_labels", r"^\s*[+-]?\d+\s*$"), ("A", r"^\s*\d+\s*,\s*\d+\s*$")):
        t = numbered_lines(spark, f"{folder}/{name}_{part}.txt")
        why = F.when(F.trim("value") == "", "blank").when(~F.col("value").rlike(form), "form")
        out.append(t.select(F.lit(part).alias("file"), "line", why.alias("why")).where("why IS NOT NULL"))
    v = numbered_lines(spark, f"{folder}/{name}_graph_indicator.txt").select(F.col("line").alias("vertex"), F.expr("try_cast(trim(value) as int)").alias("g"))
    a = numbered_lines(spark, f"{folder}/{name}_A.txt").select("line", F.expr("try_cast(trim(split(value, ',')[0]) as int)").alias("a"), F.expr("try_cast(trim(get(split(value, ','), 1)) as int)").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    j = a.join(v.select(F.col("vertex").alias("a"), F.col("g").alias("ga")), "a", "left").join(v.select(F.col("vertex").alias("b"), F.col("g").alias("gb")), "b", "left")
    why = F.when(F.col("ga").isNull() | F.col("gb").isNull(), "vertex").when(F.col("ga") != F.col("gb"), "graphs")
    out.append(j.select(F.lit("A").alias("file"), "line", why.alias("why")).where("why IS NOT NULL"))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def count_differences(edges: DataFrame, vertices: DataFrame, stored: DataFrame) -> DataFrame:
    """Graphs whose vertices or edges are not as many as (g, n, m) says."""
    e, v = edges.groupBy("g").agg(F.count("*").alias("m2")), vertices.groupBy("g").agg(F.count("*").alias("n2"))
    j = stored.join(v, "g", "full").join(e, "g", "full")
    return j.where(~F.col("n").eqNullSafe(F.coalesce("n2", F.lit(0))) | ~F.col("m").eqNullSafe(F.coalesce("m2", F.lit(0)))).select("g", "n", "n2", "m", "m2")

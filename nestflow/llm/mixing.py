"""Mixing sources to target weights by hash thresholds, with built-in functions only; nothing is sorted.

A document's hash is fixed by its id, its source and its text. A source that should give T words and has S takes every document
floor(T / S) times, and once more those whose hash is below a threshold. Histograms of the words by source and hash bucket find
the bucket in which the threshold lies; only that bucket is split further, 12 bits at a time, until it holds a single hash.

Defined results
* nulls: a null text has size 0 and is carried along; a null source is a source of its own and comes last in the order of sources; a null id counts as an empty one in the hash.
* empty and very long texts: a blank text has size 0; a text of any length is read whole.
* ties: rows with the same id, source and text share a hash and are taken or left together; the boundary hash is taken if that comes nearer to the target, and left if both are as near.
* repeated rows: each gets a row, with equal results.
* an empty table gives an empty result, and so does one whose sources are all empty in size.
* extra columns: only the id, the source and the text are read, so others may have any name.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, fresh, session_of

WEIGHTS, BUDGET, MOST = (5, 2, 1), 1.5, 2
BITS, STEP = 60, 12
#: The first 15 hex digits of md5 as a number; the same in any SQL engine.
HASH = "cast(conv(substr(md5(concat_ws('|', coalesce(cast(id as string), ''), coalesce(source, ''), md5(coalesce(text, '')))), 1, 15), 16, 10) as bigint)"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """(source, source_size, target): shares of budget x all sizes by weight, none above most x the source's size.

    Sources are capped in ascending order of cap / weight. The first source that its share does not fill, and all after it,
    get what is left by weight. One row per source, so the windows are over a short table.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    i = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (i + 1).cast("int")).cast("long")
    s = sizes.select("source", "source_size", w.alias("w")).withColumn("cap", F.col("source_size") * most)
    by = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    s = s.select("*", F.row_number().over(by).alias("k"), F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("c"), (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("left_w"), F.sum("source_size").over(every).alias("all"))
    s = s.withColumn("level", (F.lit(float(budget)) * F.col("all") - F.col("c")) / F.col("left_w"))
    s = s.withColumn("open", F.col("level") * F.col("w") < F.col("cap"))
    s = s.withColumn("first", F.min(F.when(F.col("open"), F.struct("k", "level"))).over(every))
    free = F.col("first").isNotNull() & (F.col("k") >= F.col("first.k"))
    return s.select("source", "source_size", F.when(free, F.col("first.level") * F.col("w")).otherwise(F.col("cap").cast("double")).alias("target"))


def sized(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, source, size, h): what the mix needs of each row; one scan of the texts."""
    d = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return d.select("id", "source", size.alias("size"), F.expr(HASH).alias("h"))


def thresholds(d: DataFrame, ws: Workspace) -> DataFrame:
    """(s, source_size, target, base, edge, edge_in) of (source, size, h), a row for each source: every row of it is taken ``base`` times, those with a hash below ``edge`` once more, and the edge itself if ``edge_in``."""
    sizes = d.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes).withColumn("base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", F.col("target") - F.col("base") * F.col("source_size"))
    plan = plan.select("*", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("cum"), F.lit(0).cast("long").alias("grp"))
    plan = ws.keep(plan.coalesce(1))
    for done in range(0, BITS, STEP):
        shift, p = BITS - done, ws.small(plan)
        at = p.select(F.col("source").alias("s"), "prefix")
        inside = d.join(at, d.source.eqNullSafe(at.s) & (F.shiftright(d.h, shift) == at.prefix)).drop("s")
        hist = inside.groupBy("source", F.shiftright("h", shift - STEP).alias("b")).agg(F.sum("size").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        h2 = hist.join(p.select(F.col("source").alias("s"), "rest", F.col("cum").alias("cum0")), hist.source.eqNullSafe(F.col("s"))).drop("s")
        run = Window.partitionBy("source").orderBy("b")
        h2 = h2.withColumn("end", F.col("cum0") + F.sum("n").over(run))
        edge = h2.where(F.col("end") >= F.col("rest")).groupBy("source").agg(F.min(F.struct("b", (F.col("end") - F.col("n")).alias("cum"), "n", (F.col("lo") == F.col("hi")).alias("single"), "lo")).alias("e"))
        old = plan.drop("prefix", "cum", "grp", "single", "lo")
        nxt = old.join(edge.select(F.col("source").alias("s"), "e"), old.source.eqNullSafe(F.col("s")), "left").select(
            *old.columns, F.coalesce("e.b", F.lit(-1)).alias("prefix"), F.coalesce("e.cum", F.lit(0)).alias("cum"), F.coalesce("e.n", F.lit(0)).alias("grp"), F.coalesce("e.single", F.lit(True)).alias("single"), F.col("e.lo").alias("lo"))
        nxt = ws.keep(nxt.coalesce(1))
        ws.drop(plan)
        plan = nxt
        if not plan.where(~F.col("single")).limit(1).count():
            break
    # hashes below the boundary are in; the boundary hash is, if that comes nearer
    out = plan.select(F.col("source").alias("s"), "source_size", "target", "base", F.col("lo").alias("edge"), (2 * F.col("cum") + F.col("grp") < 2 * F.col("rest")).alias("edge_in"))
    return ws.small(ws.keep(out.coalesce(1)))


def copies(h: Column) -> Column:
    """How often the plan takes a row with this hash."""
    return F.col("base") + F.when((h < F.col("edge")) | ((h == F.col("edge")) & F.col("edge_in")), 1).otherwise(0)


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, size, source_size, target, copies, taken and source for every row of docs.

    One scan of the texts makes a narrow table (id, source, size, hash); every later pass reads only that table.
    """
    ws = Workspace(session_of(docs), "mixing")
    d = ws.keep(sized(docs, id_col, source_col, text_col))
    plan = thresholds(d, ws)
    out = d.join(plan, d.source.eqNullSafe(plan.s)).withColumn("copies", copies(F.col("h")))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), "source")


def apply_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs with each row as often as the mix takes it. Blank texts of a source that is taken whole stay as often as others do.

    What a row's hash decides is looked up in the plan, which has one row for each source; texts are filtered where they lie.
    """
    ws = Workspace(session_of(docs), "mixing")
    d = ws.keep(sized(docs, id_col, source_col, text_col))
    plan = thresholds(d, ws)
    ws.drop(d)
    names = {n: fresh(docs, n) for n in ("__source", "__h", "__k")}
    own = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"), F.struct(*docs.columns).alias(names["__k"]))
    own = own.select(names["__k"], F.col("source").alias(names["__source"]), F.expr(HASH).alias(names["__h"]))
    out = own.join(plan, own[names["__source"]].eqNullSafe(plan.s)).withColumn("n", copies(F.col(names["__h"]))).where("n > 0")
    out = out.select(names["__k"], F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return out.select(f"{names['__k']}.*")

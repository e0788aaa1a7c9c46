"""Evaluation of classifiers: folds, candidate selection, scaling, bags, metrics and bootstrap intervals. Built-in functions, but for multinomial draws over cells of counts."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..stages import Stages
from .numbering import numbered


def _dealt(samples: DataFrame, by: list[str], key: str, seed: int | None, k: int, name: str) -> DataFrame:
    """Adds name: the samples of a group in turn, by hash of a seed, or by key without one."""
    s = samples.withColumn("_h", F.lit(0) if seed is None else F.xxhash64(F.lit(seed), key))
    return numbered(s, by, ["_h", key], "_place").withColumn(name, ((F.col("_place") - 1) % k).cast("int")).drop("_h", "_place")


def stratified_folds(samples: DataFrame, k: int, stratum: str = "stratum", key: str = "id", seed: int | None = None) -> DataFrame:
    """Adds fold: each stratum is dealt out in turn."""
    return _dealt(samples, [stratum], key, seed, k, "fold")


def nested_folds(samples: DataFrame, outer: int, inner: int, stratum: str = "stratum", key: str = "id", seed: int | None = None) -> DataFrame:
    """key, outer_fold, inner_fold: every sample once in each outer fold; inner_fold is null where it is held out, else dealt among the training samples."""
    s = stratified_folds(samples, outer, stratum, key, seed).withColumnRenamed("fold", "own")
    s = s.select(key, stratum, "own", F.explode(F.sequence(F.lit(0), F.lit(outer - 1))).alias("outer_fold"))
    s = _dealt(s.withColumn("_held", F.col("own") == F.col("outer_fold")), ["outer_fold", stratum, "_held"], key, seed, inner, "inner_fold")
    return s.select(key, "outer_fold", F.when(~F.col("_held"), F.col("inner_fold")).alias("inner_fold"))


def small_strata(samples: DataFrame, k: int, stratum: str = "stratum") -> DataFrame:
    """Strata with fewer than k samples, which cannot be dealt to k folds."""
    return samples.groupBy(stratum).count().where(F.col("count") < k)


def fold_violations(folds: DataFrame, samples: DataFrame, key: str = "id") -> DataFrame:
    """(key, why): samples without a fold, with several, and folds of unknown samples."""
    n = folds.groupBy(key).count()
    twice = n.where(F.col("count") > 1).select(key, F.lit("repeated").alias("why"))
    lost = samples.select(key).join(n, key, "left_anti").withColumn("why", F.lit("missing"))
    return twice.unionByName(lost).unionByName(n.join(samples, key, "left_anti").select(key, F.lit("unknown").alias("why")))


def select_candidate(scores: DataFrame) -> DataFrame:
    """outer_fold, candidate, mean_score from (outer_fold, inner_fold, candidate, score): highest mean, the first candidate on a tie."""
    m = scores.groupBy("outer_fold", "candidate").agg(F.avg("score").alias("mean_score"))
    best = m.groupBy("outer_fold").agg(F.max(F.struct("mean_score", (-F.col("candidate")).alias("c"))).alias("b"))
    return best.select("outer_fold", (-F.col("b.c")).alias("candidate"), F.col("b.mean_score").alias("mean_score"))


def moments(features: DataFrame, by: tuple[str, ...] = ("idx",)) -> DataFrame:
    """mean, variance and sd of (.., idx, value) over the population."""
    return features.groupBy(*by).agg(F.avg("value").alias("mean"), F.var_pop("value").alias("variance"), F.stddev_pop("value").alias("sd"))


def low_variance(features: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """idx of the features whose variance exceeds the tolerance."""
    return moments(features).where(F.col("variance") > tolerance).select("idx")


def standardize(train: DataFrame, rows: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """rows in units of the training rows' deviations from their means; features of no more variance than the tolerance go."""
    m = moments(train).where(F.col("variance") > tolerance)
    return rows.join(m, "idx").withColumn("value", (F.col("value") - F.col("mean")) / F.col("sd")).drop("mean", "variance", "sd")


def majority(samples: DataFrame, by: tuple[str, ...] = ("stratum",)) -> DataFrame:
    """The commonest label of each group; the least on a tie."""
    n = samples.groupBy(*by, "label").count()
    w = Window.partitionBy(*by).orderBy(F.desc("count"), "label")
    return n.withColumn("r", F.row_number().over(w)).where("r = 1").select(*by, "label")


def bags(samples: DataFrame, size: int, key: str = "id", seed: int | None = None) -> DataFrame:
    """key, label, bag: each class cut into whole groups of ``size``; the rest is left out."""
    s = samples.withColumn("_h", F.lit(0) if seed is None else F.xxhash64(F.lit(seed), key))
    b = numbered(s, ["label"], ["_h", key], "_place", size="_n").withColumn("bag", F.floor((F.col("_place") - 1) / size).cast("int"))
    return b.where(F.col("bag") < F.floor(F.col("_n") / size)).select(key, "label", "bag")


def need_bags(samples: DataFrame, size: int) -> DataFrame:
    """samples, or an error if a class has too few for one bag."""
    if few := [r["label"] for r in samples.groupBy("label").count().where(F.col("count") < size).limit(5).collect()]:
        raise ValueError(f"classes without a bag of {size}: {few}")
    return samples


def bag_means(bagged: DataFrame, features: DataFrame, key: str = "id") -> DataFrame:
    return bagged.join(features, key).groupBy("label", "bag", "idx").agg(F.avg("value").alias("value"))


def confusion(predictions: DataFrame, by: tuple[str, ...] = (), prediction: str = "prediction", weight: str | None = None) -> DataFrame:
    return predictions.groupBy(*by, "label", F.col(prediction).alias("prediction")).agg((F.sum(weight) if weight else F.count("*")).alias("n"))


def metrics(predictions: DataFrame, by: tuple[str, ...] = (), prediction: str = "prediction", weight: str | None = None) -> DataFrame:
    """accuracy and macro_f1, over the classes that occur as labels; F1 = 2 TP / (true + predicted). With weight, a row counts that often."""
    c = confusion(predictions, by, prediction, weight)
    true = c.groupBy(*by, "label").agg(F.sum("n").alias("true"), F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("tp"))
    said = c.groupBy(*by, F.col("prediction").alias("label")).agg(F.sum("n").alias("said"))
    f = true.join(said, [*by, "label"], "left").withColumn("f1", 2 * F.col("tp") / (F.col("true") + F.coalesce("said", F.lit(0))))
    return f.groupBy(*by).agg((F.sum("tp") / F.sum("true")).alias("accuracy"), F.avg("f1").alias("macro_f1"))


def fold_summary(per_fold: DataFrame, value: str) -> DataFrame:
    """mean, sd (0 for one fold), min and max over folds."""
    return per_fold.agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"))


def paired_difference(first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    return first.join(second.select(key, F.col(value).alias("_other")), key).select(key, (F.col(value) - F.col("_other")).alias("difference"))


_PRIME = 2147483647


def _shared(key, replicate, i, shift=np.right_shift, xor=np.bitwise_xor):
    """The numbers of ``shared_draw`` from the stratum's key, of columns or of arrays."""
    a = ((key + (replicate * 1000003) % _PRIME + (i * 7919) % _PRIME) % _PRIME * 48271 + 11) % _PRIME
    return (xor(a, shift(a, 13)) * 69621 + 7) % _PRIME


def _shared_key(seed: int, stratum: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), stratum.cast("string"))), 1, 8), 16, 10).cast("long") % F.lit(_PRIME).cast("long")


def shared_draw(seed: int, stratum: Column, replicate: Column, i: Column) -> Column:
    """A draw, at least 0, that any SQL engine can repeat: products and remainders of numbers below 2^31, and a key for the stratum from an md5."""
    return _shared(_shared_key(seed, stratum), replicate, i, F.shiftright, lambda a, b: a.bitwiseXOR(b))


#: Cells of a stratum that are drawn together, replicates of a task, and single draws that are made at once.
CELLS, REPLICATES, DRAWS = 1000, 100, 250_000


def resampled_cells(samples: DataFrame, cells: tuple[str, ...], replicates: int, seed: int, stratum: str = "stratum", draw=None, weight: str | None = None) -> DataFrame:
    """(replicate, cells, times): for each replicate how often a sample of each cell is drawn, with replacement, as many in each stratum as it has samples.

    Samples of a stratum with equal cells are alike, so only their numbers are drawn, from the multinomial distribution: no replicate reads the samples. A stratum of many cells is drawn in two steps, first how often each group
    of ``CELLS`` cells is drawn, then the cells of each group, so no task holds all cells and none come to the driver. With ``draw=shared_draw`` each draw is made by itself instead, so that another engine can repeat it; a task makes ``DRAWS`` of one replicate and
    stratum at once, looks them up among the stratum's cells, which are the combinations of labels that occur, and returns their numbers. With weight, a row counts that often. The result is written once, with a row for each replicate and combination.
    """
    if draw not in (None, shared_draw):
        raise ValueError("draws are multinomial or those of shared_draw")
    spark = samples.sparkSession
    counts = samples.groupBy(F.col(stratum).alias("_s"), *cells).agg((F.sum(weight) if weight else F.count("*")).alias("_c"))
    stages = Stages(spark, "cells")
    counts = stages.keep(numbered(counts, ["_s"], list(cells), "_i").withColumn("_group", F.expr(f"(_i - 1) div {CELLS}")))
    strata = stages.keep(counts.select("_s").distinct().withColumn("_id", F.monotonically_increasing_id()))
    counts = stages.keep(counts.join(strata.withColumnRenamed("_s", "_t"), F.col("_s").eqNullSafe(F.col("_t"))).drop("_t"))
    groups = counts.groupBy("_s", "_id", "_group").agg(F.sort_array(F.collect_list(F.struct("_i", "_c"))).alias("x"), F.sum("_c").alias("n"))
    totals = groups.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("_group", "n"))).alias("y"), F.sum("n").alias("all"))  # a number for each group
    if draw is None:
        blocks = F.explode(F.sequence(F.lit(0), F.lit(max(0, replicates - 1) // REPLICATES)))
        asks = groups.join(totals, "_id")
        asks = asks.select("_id", F.xxhash64(F.lit(seed), "_s").alias("seed"), "_group", F.transform("x", lambda v: v["_i"]).alias("i"), F.transform("x", lambda v: v["_c"]).alias("c"), F.transform("y", lambda v: v["n"]).alias("totals"), "all", blocks.alias("block"))
        def run(batches):
            stream = lambda *key: np.random.Generator(np.random.Philox(key=np.array(key, np.int64).view(np.uint64)))
            for b in batches:
                for own_id, of, g, i, c, totals, n, block in zip(*[x.to_pylist() for x in b.columns], strict=True):
                    share, within, own = np.array(totals) / n, np.array(c) / sum(c), n
                    mark = of ^ (g + 1) << 32  # the stream of a group
                    which, cell, times = [], [], []
                    for r in range(block * REPLICATES, min(replicates, (block + 1) * REPLICATES)):
                        if len(totals) > 1:
                            own = int(stream(of, r).multinomial(n, share)[g])
                        drawn = stream(mark, r).multinomial(own, within)
                        at = np.nonzero(drawn)[0]
                        which.append(np.full(len(at), r))
                        cell.append(at)
                        times.append(drawn[at])
                    cell = np.array(i, np.int32)[np.concatenate(cell)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(which)), pa.array(np.full(len(cell), own_id)), pa.array(cell), pa.array(np.concatenate(times))], names=["replicate", "_id", "_i", "times"])

        asks = asks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # few bytes, but much work for them
        drawn = asks.mapInArrow(run, "replicate long, _id long, _i int, times long")
    else:
        upto = counts.select("_s", "_id", "_i", F.sum("_c").over(Window.partitionBy("_id").orderBy("_i")).alias("upto"))
        places = upto.groupBy("_s", "_id").agg(F.sort_array(F.collect_list("upto")).alias("upto"), F.max("upto").alias("n"))
        span = lambda last: F.explode(F.sequence(F.lit(0).cast("long"), last))
        asks = places.select("_id", _shared_key(seed, F.col("_s")).alias("key"), "upto", "n", span(F.lit(replicates - 1).cast("long")).alias("replicate"))
        asks = asks.select("*", span(F.expr(f"(n - 1) div {DRAWS}")).alias("block"))

        def run(batches):
            for b in batches:
                for own_id, key, upto, n, r, block in zip(*[x.to_pylist() for x in b.columns], strict=True):
                    pick = _shared(key, r, np.arange(block * DRAWS, min(n, (block + 1) * DRAWS), dtype=np.int64)) % n
                    times = np.bincount(np.searchsorted(np.array(upto), pick, "right"), minlength=len(upto))
                    at = np.nonzero(times)[0]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), r)), pa.array(np.full(len(at), own_id)), pa.array((at + 1).astype(np.int32)), pa.array(times[at])], names=["replicate", "_id", "_i", "times"])

        asks = asks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
        drawn = asks.mapInArrow(run, "replicate long, _id long, _i int, times long")
    return stages.keep(drawn.join(counts, ["_id", "_i"]).groupBy("replicate", *cells).agg(F.sum("times").alias("times")))


def interval(values: DataFrame, observed: DataFrame, names: dict[str, str], level: float = 0.95, by: tuple[str, ...] = ()) -> DataFrame:
    """(by,) metric, observed, mean, sd, lower, upper: of each column of values that names lists, over the rows; percentiles with linear interpolation. observed: one row with the same columns, or one for each group of by."""
    a = (1 - level) / 2
    stack = lambda df: df.select(*by, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).cast("double").alias("value")) for n, c in names.items()])).alias("x")).select(*by, "x.metric", "x.value")
    out = stack(values).groupBy(*by, "metric").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"), F.percentile("value", F.lit(a)).alias("lower"), F.percentile("value", F.lit(1 - a)).alias("upper"))
    return out.join(stack(observed).withColumnRenamed("value", "observed"), [*by, "metric"]).select(*by, "metric", "observed", "mean", "sd", "lower", "upper")


def _paired(first: DataFrame, second: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    f, s = (d.select(*by, F.col("accuracy").alias("a" + k), F.col("macro_f1").alias("f" + k)) for d, k in ((first, "1"), (second, "2")))
    d = f.join(s, list(by)) if by else f.join(F.broadcast(s))  # a row each
    return d.withColumn("a3", F.col("a1") - F.col("a2")).withColumn("f3", F.col("f1") - F.col("f2"))


_SIX = {"accuracy first": "a1", "accuracy second": "a2", "accuracy difference": "a3", "macro_f1 first": "f1", "macro_f1 second": "f2", "macro_f1 difference": "f3"}


def need_classes(predictions: DataFrame) -> DataFrame:
    """predictions, or an error if they have fewer than two labels."""
    if predictions.select("label").distinct().limit(2).count() < 2:
        raise ValueError("fewer than two classes")
    return predictions


def _kinds(rows: DataFrame, *cols: str) -> DataFrame:
    """The combinations of the columns that occur, and how many rows have them: all that a bootstrap reads, made once."""
    return Stages(rows.sparkSession, "kinds").keep(rows.groupBy(*cols).agg(F.count("*").alias("rows")))


def bootstrap(predictions: DataFrame, replicates: int, seed: int, level: float = 0.95, draw=None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by,) metric, observed, mean, sd, lower, upper of accuracy and macro_f1 over stratified resamples, of each group of by for itself."""
    kinds = need_classes(_kinds(predictions, "stratum", *by, "label", "prediction"))
    strata = kinds.withColumn("_stratum", F.struct(*by, "stratum")) if by else kinds
    r = resampled_cells(strata, (*by, "label", "prediction"), replicates, seed, "_stratum" if by else "stratum", draw, "rows")
    return interval(metrics(r, (*by, "replicate"), weight="times"), metrics(kinds, by, weight="rows"), {"accuracy": "accuracy", "macro_f1": "macro_f1"}, level, by)


def paired_bootstrap(predictions: DataFrame, replicates: int, seed: int, level: float = 0.95, draw=None) -> DataFrame:
    """The same of ``prediction`` (first), of ``second`` and of their difference, all on the same resamples."""
    kinds = need_classes(_kinds(predictions, "stratum", "label", "prediction", "second"))
    r = resampled_cells(kinds, ("label", "prediction", "second"), replicates, seed, draw=draw, weight="rows")
    values = _paired(metrics(r, ("replicate",), weight="times"), metrics(r, ("replicate",), "second", "times"), ("replicate",))
    return interval(values, _paired(metrics(kinds, weight="rows"), metrics(kinds, (), "second", "rows")), _SIX, level)


def hierarchical_bootstrap(predictions: DataFrame, replicates: int, seed: int, level: float = 0.95, draw=None) -> DataFrame:
    """The same of (id, stratum, label, realization, prediction, second), where the first method has a prediction for each realization, from 0, and the second one for all.

    A replicate draws samples once, and as many realizations as there are, for all samples; the first method's value is the mean over the drawn realizations.
    """
    spark = predictions.sparkSession
    said = F.transform(F.sort_array(F.collect_list(F.struct("realization", "prediction"))), lambda x: x["prediction"])
    wide = predictions.groupBy("id", "stratum", "label", "second").agg(said.alias("said"))
    m = predictions.agg(F.max("realization")).first()[0] + 1
    cols = [f"p{i}" for i in range(m)]
    wide = wide.select("id", "stratum", "label", "second", *[F.col("said")[i].alias(c) for i, c in enumerate(cols)])
    kinds = need_classes(_kinds(wide, "stratum", "label", *cols, "second"))
    r = resampled_cells(kinds, ("label", *cols, "second"), replicates, seed, draw=draw, weight="rows")
    each = lambda df, by, w: metrics(df.select(*by, "label", *w, F.posexplode(F.array(*cols)).alias("realization", "prediction")), (*by, "realization"), weight=w[0])
    of = draw or (lambda s, key, rep, i: F.pmod(F.xxhash64(F.lit(s), key, rep, i), F.lit(_PRIME)))
    picks = spark.range(replicates).select(F.col("id").alias("replicate"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))).alias("i"))
    picks = picks.select("replicate", (of(seed, F.lit("realization"), F.col("replicate"), F.col("i")) % m).cast("int").alias("realization")).groupBy("replicate", "realization").agg(F.count("*").alias("w"))
    mean = lambda c: (F.sum(F.col("w") * F.col(c)) / m).alias(c)
    first = each(r, ("replicate",), ("times",)).join(picks, ["replicate", "realization"]).groupBy("replicate").agg(mean("accuracy"), mean("macro_f1"))
    values = _paired(first, metrics(r, ("replicate",), "second", "times"), ("replicate",))
    seen = each(kinds, (), ("rows",)).agg(F.avg("accuracy").alias("accuracy"), F.avg("macro_f1").alias("macro_f1"))
    return interval(values, _paired(seen, metrics(kinds, (), "second", "rows")), _SIX, level)


def timing_summary(timings: DataFrame, by: tuple[str, ...], value: str) -> DataFrame:
    return timings.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))

"""Diagrams from streams of intervals (obs, birth, death, coefficient, ts).

Masses and linear coordinates are sums, so they stream as plain aggregates. A relationship sum needs an observation's earlier intervals, as each new
one may lie inside any of them or around it: they are kept as state until the watermark closes the observation.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.harmonic import later_sums, spec_frame


def masses(stream: DataFrame, window: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """start, obs, support, mass, weighted_mass per tumbling window; rows later than ``late`` are left out."""
    w = F.window("ts", window)
    g = stream.withWatermark("ts", late).groupBy(w.alias("w"), "obs")
    return g.agg(F.count("*").alias("support"), F.sum("coefficient").alias("mass"), F.sum(F.col("coefficient") * (F.col("death") - F.col("birth"))).alias("weighted_mass")).select(F.col("w.start").alias("start"), "obs", "support", "mass", "weighted_mass")


def linear(stream: DataFrame, spec: list[tuple], window: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """start, obs, idx, re, im."""
    f = F.broadcast(spec_frame(stream.sparkSession, spec))
    c = F.when(F.col("family").startswith("weighted"), F.col("coefficient") * (F.col("death") - F.col("birth"))).otherwise(F.col("coefficient"))
    arg = F.col("w0") * F.col("birth") + F.col("w1") * F.col("death")
    z = stream.withWatermark("ts", late).join(f)
    return z.groupBy(F.window("ts", window).alias("w"), "obs", "idx").agg(F.sum(c * F.cos(arg)).alias("re"), F.sum(c * F.sin(arg)).alias("im")).select(F.col("w.start").alias("start"), "obs", "idx", "re", "im")


def relationship_mass(stream: DataFrame, late: str = "5 minutes") -> DataFrame:
    """obs, support, relationship_mass: a row each time intervals of an observation arrive; its state goes when the watermark passes its last one.

    State holds each different interval once, with the sum of its coefficients; a trigger sweeps them once, however many rows it brings.
    """
    kind = stream.schema["obs"].dataType.simpleString()

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        old = state.get if state.exists else ([], [], [], 0)
        b, d, c = ([np.asarray(x, float)] for x in old[:3])
        support, last = int(old[3]), state.getCurrentWatermarkMs()
        for pdf in batches:
            last = max(last, int(pdf["ts"].max().value // 1_000_000))
            support += len(pdf)
            for have, name in ((b, "birth"), (d, "death"), (c, "coefficient")):
                have.append(pdf[name].to_numpy(float))
        at, which = np.unique(np.column_stack([np.concatenate(b), np.concatenate(d)]), axis=0, return_inverse=True)
        sums = np.bincount(which.ravel(), np.concatenate(c), len(at))
        total = float((sums * later_sums(at[:, 0], at[:, 1], sums[:, None])[:, 0]).sum())
        state.update((at[:, 0].tolist(), at[:, 1].tolist(), sums.tolist(), support))
        state.setTimeoutTimestamp(last + 1)
        yield pd.DataFrame({"obs": [key[0]], "support": [support], "relationship_mass": [total]})

    state = "b array<double>, d array<double>, c array<double>, support long"
    return stream.withWatermark("ts", late).groupBy("obs").applyInPandasWithState(run, f"obs {kind}, support long, relationship_mass double", state, "update", GroupStateTimeout.EventTimeTimeout)

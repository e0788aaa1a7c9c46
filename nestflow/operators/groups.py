"""Many small groups in a task: rows dealt by a key, and read group by group."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def dealt(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The rows of a key side by side, in order. Work that is not in the bytes of the rows: adaptive execution does not join these partitions to a few."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key).sortWithinPartitions(key, *order)


def groups(batches):
    """(key, rows) of each key in the first column of sorted Arrow batches, and (None, None) behind each batch; rows is a table in one piece, key an array of one."""
    held: list[pa.RecordBatch] = []

    def whole():
        out = held[0].column(0)[:1], pa.Table.from_batches(held).combine_chunks()
        held.clear()
        return out

    for b in batches:
        if not b.num_rows:
            continue
        code = pc.fill_null(b.column(0).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        starts = [0, *(np.nonzero(np.diff(code))[0] + 1).tolist(), len(code)]
        for i, j in zip(starts[:-1], starts[1:], strict=True):
            if held and (i or held[0].column(0)[0].as_py() != b.column(0)[0].as_py()):
                yield whole()
            held.append(b.slice(i, j - i))
        yield None, None
    if held:
        yield whole()
        yield None, None

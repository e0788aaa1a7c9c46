"""Exact top-k by inner product, pruned by statistics of vector segments at several resolutions.

Each vector is cut into 4, 8, 16 ... equal segments, and of each segment the mean and the norm of the deviations from it are kept. For a query q and a vector v

    <q, v>  <=  sum over segments of  L * mean(q) * mean(v) + dev(q) * dev(v),

which means for distances: |q - v|^2 is at least |q|^2 + |v|^2 less twice that. Coarse statistics are compared first, finer ones for the
pairs that may still reach the k-th best score, and the exact product only for the pairs that outlive them all. A level is made for those rows and columns of a block that still have such a pair, and pair by pair once few are left;
where a level tells next to no pairs apart, exact products follow at once. ``multiplications`` tells what that takes, beside the components of all pairs.

Vectors and queries are packed into blocks once. Blocks meet in the cells of a grid: a cell holds up to ``GROUP`` blocks of queries, and the blocks of vectors stream past them, so a task
keeps the queries of one cell and one block of vectors. The score that a query has to beat starts from ``VECTORS`` vectors that all cells have compared before (those with the least hashes of their ids), and rises
from block to block. How many pairs outlive each level is told by ``survivors``.

Defined results
* nulls: a vector that is null, or holds a null or a component that is not finite, takes no part; neither does one with a null id.
* empty and very long vectors: components are floor(256 * x) as integers; vectors of unequal length are compared within a length only, empty ones among each other with score 0. A score beyond 64 bits is given as the nearest number within them.
* ties: the smaller id comes first.
* repeated rows: rows that share an id are separate candidates, and a query has no candidate with its own id; each query row has its own results.
* an empty table, of vectors or queries, gives an empty result.
* extra columns: only the id and the vector are read, so others may have any name.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, batch_rows, session_of

#: Vectors and queries in a block, blocks of queries in a cell.
VECTORS, QUERIES, GROUP = 4096, 1024, 8
#: Blocks of vectors: one to a cell up to ``SPREAD`` of them, and ``STREAM`` at least beyond.
SPREAD, STREAM = 64, 16
#: Fewer than one pair in ``FEW`` of a block: products are made pair by pair. Fewer than one in ``TELLING`` told apart: finer levels are not tried.
FEW, TELLING = 20, 10
#: Products below this many units are exact in a double.
_EXACT = 2.0**52


def resolutions(dim: int) -> list[int]:
    """Numbers of segments, coarse to fine: 4, 8, 16 ... as far as they divide the vectors into segments of four, as a mean and a deviation of fewer say little for what they cost."""
    out = [k for k in (4, 8, 16, 32) if dim % k == 0 and dim // k >= 4]
    return out or ([1] if dim else [])


def statistics(x: np.ndarray, k: int) -> np.ndarray:
    """(rows, 2k): scaled means and deviation norms, so that the bound is a product of two such rows."""
    s = x.reshape(len(x), k, -1)
    mean = s.mean(2)
    dev = np.sqrt(np.maximum(((s - mean[:, :, None]) ** 2).sum(2), 0))
    return np.hstack([mean * np.sqrt(s.shape[2]), dev])


class Best:
    """The k best of a block of queries so far: (query row, id, score), and the score that each query has to beat."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.x, self.ids, self.k = queries, ids, k
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor.copy()
        self.levels = resolutions(queries.shape[1])
        self.stats = [statistics(queries, r) for r in self.levels]
        self.norm = np.sqrt((queries**2).sum(1))
        self.top: tuple = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object))
        #: By level: pairs that are left behind it, multiplications made for it; before all, and exact products, come first and last.
        self.counts, self.work = np.zeros(len(self.levels) + 2, np.int64), np.zeros(len(self.levels) + 2, np.int64)

    def _products(self, n: int, a: np.ndarray, b, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, products) of the live pairs of rows of a and of b, a function of rows; pair by pair if few of their rows and columns meet."""
        i, j = np.nonzero(live)
        rows, cols = np.nonzero(live.any(1))[0], np.nonzero(live.any(0))[0]
        right = b(cols)
        j_at = np.searchsorted(cols, j)
        if FEW * len(i) > len(rows) * len(cols):
            self.work[n] += len(rows) * len(cols) * a.shape[1]
            return i, j, (a[rows] @ right.T)[np.searchsorted(rows, i), j_at]
        self.work[n] += len(i) * a.shape[1]
        step = 65_536
        return i, j, np.concatenate([np.einsum("ab,ab->a", a[i[x : x + step]], right[j_at[x : x + step]]) for x in range(0, len(i), step)])

    def compare(self, vectors: np.ndarray, ids: np.ndarray) -> None:
        """Takes a block of vectors into account."""
        exact = self.x.shape[1] * max(1.0, np.abs(self.x).max(initial=0)) * max(1.0, np.abs(vectors).max(initial=0)) < _EXACT
        slack = 1e-9 * self.norm * np.sqrt((vectors**2).sum(1)).max(initial=0) + 1
        need = self.floor - slack
        live = self.ids[:, None] != ids[None]
        left = int(live.sum())
        self.counts[0] += left
        told = True
        for n, r in enumerate(self.levels, 1):
            if left and told:
                i, j, bound = self._products(n, self.stats[n - 1], lambda cols, r=r: statistics(vectors[cols], r), live)
                gone = bound < need[i]
                live[i[gone], j[gone]] = False
                told = TELLING * gone.sum() >= left
                left -= int(gone.sum())
            self.counts[n] += left
        if not left:
            return
        if exact:
            i, j, score = self._products(-1, self.x, lambda cols: vectors[cols], live)
            ok = score >= self.floor[i]
            i, j, score = i[ok], j[ok], score[ok].astype(np.int64)
        else:  # whole numbers of any size
            i, j = np.nonzero(live)
            self.work[-1] += left * self.x.shape[1]
            score = np.array([sum(int(a) * int(b) for a, b in zip(self.x[p].tolist(), vectors[q].tolist(), strict=True)) for p, q in zip(i, j, strict=True)], object)
        self.counts[-1] += len(i)
        row, name, value = np.concatenate([self.top[0], i]), np.concatenate([self.top[1], ids[j]]), np.concatenate([self.top[2], score])
        small = exact and all(isinstance(x, (int, np.integer)) and abs(x) < 2**62 for x in self.top[2])
        order = np.lexsort([name, -value.astype(np.int64), row]) if small else np.array(sorted(range(len(row)), key=lambda r: (row[r], -value[r], name[r])), np.int64)
        row, name, value = row[order], name[order], value[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        ok = place < self.k
        self.top = (row[ok], name[ok], value[ok].astype(object))
        full = place == self.k - 1
        self.floor[row[full]] = np.maximum(self.floor[row[full]], value[full].astype(float))


def prepare(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x): ids and whole components of the vectors that take part."""
    x = F.col(vec_col).cast("array<double>")
    fine = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    floor = lambda c: F.floor(F.lit(256.0) * c).cast("double")
    return df.where(fine).select(F.col(id_col).cast("long").alias("id"), F.transform(x, floor).alias("x"))


def blocks(df: DataFrame, rows: int) -> DataFrame:
    """(dim, ids, data): runs of at most ``rows`` vectors of one length, packed as bytes, in two bytes a component where that is enough; no group is gathered whole."""

    def run(batches):
        ids: dict[int, list[int]] = {}
        data: dict[int, list[np.ndarray]] = {}

        def flush(dim):
            a = np.array(ids.pop(dim), np.int64)
            x = np.array(data.pop(dim), float).reshape(len(a), dim)
            x = x.astype(np.int16) if np.abs(x).max(initial=0) < 2**15 else x
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([a.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["dim", "ids", "data"])

        for b in batches:
            lists = b.column(1)
            values, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for i, p, q in zip(b.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                ids.setdefault(q - p, []).append(i)
                data.setdefault(q - p, []).append(values[p:q])
                if len(ids[q - p]) == rows:
                    yield flush(q - p)
        for dim in list(ids):
            yield flush(dim)

    return df.mapInArrow(run, "dim int, ids binary, data binary").withColumn("block", F.monotonically_increasing_id())


def _unpack(dim: int, ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(ids, np.int64)
    x = np.frombuffer(data, np.int16 if len(data) == 2 * dim * len(a) and dim else float).astype(float)
    return x.reshape(len(a), dim), a


def meet(vectors: DataFrame, queries: DataFrame, k: int, report: bool = False) -> DataFrame:
    """(block, row, query_id, vec_id, score) of the k best in each cell; vectors has (dim, block, ids, data), queries the same and floor. With ``report``: (level, pairs, multiplications).

    Cells: blocks of queries by ``GROUP``, those of vectors by hash. Each block of either side goes to the cells of its row or column, and to no other.
    """
    n = {r["dim"]: (r["v"], r["q"]) for r in vectors.groupBy("dim").agg(F.count("*").alias("v")).join(queries.groupBy("dim").agg(F.count("*").alias("q")), "dim").collect()}  # a row for each length
    spark = vectors.sparkSession
    grid = spark.createDataFrame([(d, max(min(v, SPREAD), -(-v // STREAM)), -(-q // GROUP)) for d, (v, q) in n.items()], "dim int, rows int, cols int")
    grid = F.broadcast(grid)
    none = F.lit(None).cast("binary")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    v = vectors.join(grid, "dim").select("dim", F.pmod(F.xxhash64("block"), F.col("rows")).cast("int").alias("r"), each("cols").alias("c"), F.lit(1).alias("kind"), "block", "ids", "data", none.alias("floor"))
    q = queries.join(grid, "dim").select("dim", each("rows").alias("r"), F.pmod(F.xxhash64("block"), F.col("cols")).cast("int").alias("c"), F.lit(0).alias("kind"), "block", "ids", "data", "floor")
    cells = q.unionByName(v).repartition("dim", "r", "c").sortWithinPartitions("dim", "r", "c", "kind", "block")

    def run(batches):
        cell, here = None, []

        def done():
            for block, b in here:
                if report:
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(b.counts)), pa.int64()), pa.array(b.counts), pa.array(b.work)], names=["level", "pairs", "multiplications"])
                    continue
                row, name, value = b.top
                limit = [max(-(2**63), min(2**63 - 1, int(x))) for x in value]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), block)), pa.array(row), pa.array(b.ids[row]), pa.array(name), pa.array(limit, pa.int64())], names=["block", "row", "query_id", "vec_id", "score"])

        for batch in batches:
            for dim, r, c, kind, block, ids, data, floor in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if (dim, r, c) != cell:
                    yield from done()
                    cell, here = (dim, r, c), []
                x, a = _unpack(dim, ids, data)
                if kind == 0:
                    here.append((block, Best(x, a, k, np.frombuffer(floor, float) if floor else None)))
                    continue
                for _, b in here:
                    b.compare(x, a)
        yield from done()

    return cells.mapInArrow(run, "level long, pairs long, multiplications long" if report else "block long, row long, query_id long, vec_id long, score long")


def _best_of(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("block", "row").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _packed(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vec_col: str, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """Blocks of vectors, and blocks of queries with the scores to beat."""
    v = prepare(vectors, id_col, vec_col)
    first = v.orderBy(F.xxhash64("id"), "id").limit(VECTORS)
    v, q, first = ws.keep(blocks(v, VECTORS)), ws.keep(blocks(prepare(queries, id_col, vec_col), QUERIES)), ws.keep(blocks(first, VECTORS))
    none = F.lit(None).cast("binary")
    with batch_rows(session_of(vectors), 2):
        hits = ws.keep(meet(first, q.withColumn("floor", none), k))
    least = _best_of(hits, k).where(F.col("rank") == k).select("block", F.struct(F.col("row"), F.col("score").cast("double").alias("score")).alias("s"))
    # a score for each query of a block, of which there are ``QUERIES`` at most
    floors = least.groupBy("block").agg(F.collect_list("s").alias("floors"))

    def run(batches):
        for b in batches:
            out = []
            for ids, floors in zip(b.column(2), b.column(4), strict=True):
                f = np.full(len(ids.as_py()) // 8, -np.inf)
                for x in floors.as_py() or []:
                    f[x["row"]] = x["score"]
                out.append(f.tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(out, pa.binary())], names=["dim", "block", "ids", "data", "floor"])

    q = q.join(floors, "block", "left").select("dim", "block", "ids", "data", "floors").mapInArrow(run, "dim int, block long, ids binary, data binary, floor binary")
    with batch_rows(session_of(vectors), 2):
        return v, ws.keep(q)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products among all other rows of vectors."""
    ws = Workspace(session_of(vectors), "topk")
    v, q = _packed(vectors, queries, k, id_col, vec_col, ws)
    with batch_rows(session_of(vectors), 2):
        hits = ws.keep(meet(v, q, k))
    return _best_of(hits, k).select("query_id", "rank", "vec_id", "score")


def _reported(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vec_col: str, what: str) -> DataFrame:
    ws = Workspace(session_of(vectors), "topk")
    v, q = _packed(vectors, queries, k, id_col, vec_col, ws)
    with batch_rows(session_of(vectors), 2):
        return ws.keep(meet(v, q, k, report=True).groupBy("level").agg(F.sum(what).alias(what)))


def survivors(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """level, pairs: all pairs (level 0), those that outlive the bound of each resolution, and those whose product reached the score to beat (the last)."""
    return _reported(vectors, queries, k, id_col, vec_col, "pairs")


def multiplications(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """level, multiplications: those made for the bounds of each resolution (0 at level 0), and for exact products (the last). Brute force makes one for each pair and component."""
    return _reported(vectors, queries, k, id_col, vec_col, "multiplications")

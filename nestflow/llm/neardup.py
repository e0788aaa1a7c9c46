"""MinHash near-duplicates with sequential Bayesian verification.

Rows with the same set of shingles form a class; one vertex stands for it. Signatures of ``BANDS`` x ``ROWS`` minima are cut into bands, and
vertices that agree on a band share a bucket. Candidate pairs come from buckets: at first each member with its bucket's centre, then
every pair whose members still lie in different components. So no pair is made within one component, and no link between different
components is lost. In a bucket of up to ``SMALL`` members such pairs are rows; in a larger one, members outside its largest component meet all
members in blocks of bytes, and only links leave a block. Candidates are compared a batch of minima at a time and
pruned once the posterior probability of a similarity at or above the threshold is below ``MISS``. Survivors are verified exactly,
on whole sets.

A vertex is a set, known by its 128-bit digest, and not an id: rows that share an id but not a text are judged apart.

Defined results
* nulls: a null text has an empty set; a row with a null doc_id has a null component and is kept, and links of others never lead over it.
* empty and very long texts: a blank text has an empty set and is linked with nothing; a text of any length is read whole.
* ties: a component is named after its least doc_id; of rows with that id and different texts in one component ``dedup`` keeps the one with the least hash.
* repeated rows: ``components`` gives each a row; ``dedup`` keeps one of those with equal id and text, blank ones aside, which all stay.
* an empty table gives an empty result.
* extra columns: only doc_id and text are read, so others may have any name.
"""
from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, batch_rows, fresh, session_of, text_batches
from .tokens import shingles, slices, tidy

BANDS, ROWS = 32, 5
#: Minima compared at a time.
BATCH = 32
#: Posterior probability of a link below which a pair is given up.
MISS = 1e-6
#: Members of a bucket whose pairs are made as rows, and bytes of a block in larger ones.
SMALL, BLOCK = 48, 500_000
#: Rows of an Arrow batch of pairs with their sets.
PAIRS = 500


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signatures(sets: list[np.ndarray], mult: np.ndarray, block: int = 60_000) -> np.ndarray:
    """(sets, minima) of uint16: for each multiplier the low half of the least product; of an empty set, zeros."""
    out = np.zeros((len(sets), len(mult)), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(full):
        stop, n = at, 0
        while stop < len(full) and (stop == at or n + len(sets[full[stop]]) <= block):
            n += len(sets[full[stop]])
            stop += 1
        x = np.concatenate([sets[i] for i in full[at:stop]])
        x = (x >> np.uint64(20)).astype(np.uint32)
        heads = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full[at:stop]])[:-1]])
        least = np.empty((stop - at, len(mult)), np.uint32)
        for k, m in enumerate(mult):
            least[:, k] = np.minimum.reduceat(x * m, heads)
        # minima are small numbers of little entropy above; fold all bits into the half that is kept
        least = (least ^ (least >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out[full[at:stop]] = (least >> np.uint32(16)).astype(np.uint16)
        at = stop
    return out


def sketch(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, n, key, sig): hash of the text, size of the set, its digest and its signature."""
    key = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        mult = _multipliers(BANDS * ROWS)
        for batch in batches:
            for b in slices(batch, 2):
                sets = shingles(b.column(2), width)
                sig = signatures(sets, mult)
                yield pa.RecordBatch.from_arrays([
                    b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([r.tobytes() for r in sig], pa.binary()),
                ], names=["doc_id", "fp", "n", "key", "sig"])

    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("fp"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(run, f"doc_id {key}, fp long, n long, key binary, sig binary")


def whole_sets(texts: DataFrame, width: int) -> DataFrame:
    """(v, items) of (v, text): the sorted shingles as bytes."""

    def run(batches):
        for batch in batches:
            for b in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in shingles(b.column(1), width)], pa.binary())], names=["v", "items"])

    return texts.select("v", F.col("text").cast("string").alias("text")).mapInArrow(run, "v long, items binary")


def least_matches(n: int, threshold: float, miss: float) -> int:
    """Fewest of n minima that must agree for P(similarity >= threshold | matches) to reach miss, under a uniform prior.

    The posterior is Beta(m + 1, n - m + 1); its tail equals P(Binomial(n + 1, threshold) <= m).
    """
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def _stack(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), width)


def prune(pairs: DataFrame, threshold: float, miss: float) -> DataFrame:
    """Of (a, b, sig_a, sig_b) the pairs (a, b, matches) that outlive all batches of minima."""
    width = BANDS * ROWS
    bounds = [(n, least_matches(n, threshold, miss)) for n in range(BATCH, width + 1, BATCH)]

    def run(batches):
        for b in batches:
            x, y = _stack(b.column(2), width), _stack(b.column(3), width)
            live, m = np.arange(len(x)), np.zeros(len(x), np.int64)
            for n, least in bounds:
                m = m + (x[live, n - BATCH : n] == y[live, n - BATCH : n]).sum(1)
                ok = m >= least
                live, m = live[ok], m[ok]
            take = pa.array(live)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(m)], names=["a", "b", "matches"])
            tidy()

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long, matches long")


def verify(pairs: DataFrame, percent: int) -> DataFrame:
    """Of (a, b, items_a, items_b) the pairs with 100 * intersection >= percent * union."""

    def run(batches):
        for b in batches:
            keep = []
            for i, (p, q) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                x, y = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                z = np.sort(np.concatenate([x, y]), kind="stable")
                both = int(np.count_nonzero(z[1:] == z[:-1]))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take)], names=["a", "b"])
            tidy()

    return pairs.select("a", "b", "items_a", "items_b").mapInArrow(run, "a long, b long")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of left[i] and right[j]; by a product of 0/1 matrices where many pairs share few items."""
    use_l, use_r = np.unique(i), np.unique(j)
    flat = np.concatenate([*(left[k] for k in use_l), *(right[k] for k in use_r)]) if len(i) else np.zeros(0, np.uint64)
    items, code = np.unique(flat, return_inverse=True)
    if len(i) < 64 or (len(use_l) + len(use_r)) * len(items) > 40_000_000:
        return np.array([len(np.intersect1d(left[p], right[q], assume_unique=True)) for p, q in zip(i, j, strict=True)], np.int64)
    x = np.zeros((len(use_l) + len(use_r), len(items)), np.float32)
    x[np.repeat(np.arange(len(x)), [*(len(left[k]) for k in use_l), *(len(right[k]) for k in use_r)]), code] = 1
    both = x[: len(use_l)] @ x[len(use_l) :].T
    return both[np.searchsorted(use_l, i), np.searchsorted(use_r, j)].astype(np.int64)


def link_blocks(rows: DataFrame, percent: int, miss: float) -> DataFrame:
    """Links (a, b) between members of different components of (band, lefts, rights); of a task's links those that join components which its links before have not joined.

    So a task gives fewer links than it meets components, and joins the same ones. lefts and rights are arrays of (v, c, sig, items). A pair is left to the first band that it agrees on.
    """
    width, threshold = BANDS * ROWS, percent / 100
    bounds = [(n, least_matches(n, threshold, miss)) for n in range(BATCH, width + 1, BATCH)]

    def members(x):
        f = x.flatten()
        return f[0].to_pylist(), f[1].to_numpy(zero_copy_only=False), _stack(f[2], width), [np.frombuffer(y, np.uint64) for y in f[3].to_pylist()]

    def run(batches):
        up: dict[int, int] = {}  # of components that a link joins to a lesser one

        def top(c: int) -> int:
            while c in up:
                above = up[c]
                if above in up:
                    up[c] = up[above]
                c = above
            return c

        for b in batches:
            a_out, b_out = [], []
            for row in range(b.num_rows):
                band = b.column(0)[row].as_py()
                lv, lc, ls, li = members(b.column(1)[row].values)
                rv, rc, rs, ri = members(b.column(2)[row].values)
                nl, nr = np.array([len(x) for x in li]), np.array([len(x) for x in ri])
                i, j = np.nonzero((lc[:, None] != rc[None]) & (100 * np.minimum(nl[:, None], nr[None]) >= percent * np.maximum(nl[:, None], nr[None])))
                m = np.zeros(len(i), np.int64)
                for n, least in bounds:
                    m = m + (ls[i, n - BATCH : n] == rs[j, n - BATCH : n]).sum(1)
                    ok = m >= least
                    i, j, m = i[ok], j[ok], m[ok]
                if band and len(i):
                    first = (ls[i, : band * ROWS] == rs[j, : band * ROWS]).reshape(len(i), band, ROWS).all(2).any(1)
                    i, j = i[~first], j[~first]
                both = _overlaps(li, ri, i, j)
                ok = 100 * both >= percent * (nl[i] + nr[j] - both)
                for p, q, x, y in zip(i[ok].tolist(), j[ok].tolist(), lc[i[ok]].tolist(), rc[j[ok]].tolist(), strict=True):
                    x, y = top(x), top(y)
                    if x != y:
                        up[max(x, y)] = min(x, y)
                        a_out.append(lv[p])
                        b_out.append(rv[q])
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])
            tidy()

    return rows.select("band", "lefts", "rights").mapInArrow(run, "a long, b long")


def merge_components(ws: Workspace, labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (v, c) after edges (a, b) between vertices: c is the least label reachable. Joins and aggregates only.

    Each pass hooks every component to its least neighbour, follows the hooks to their roots and keeps of the edges what still joins two components, once each.
    """
    first = labels
    la, lb = labels.select(F.col("v").alias("a"), F.col("c").alias("ca")), labels.select(F.col("v").alias("b"), F.col("c").alias("cb"))
    ends = lambda x, y: (F.greatest(x, y).alias("c"), F.least(x, y).alias("p"))
    cross = ws.keep(edges.join(la, "a").join(lb, "b").where("ca <> cb").select(*ends("ca", "cb")).distinct())
    while True:
        hooks = ws.keep(cross.groupBy("c").agg(F.min("p").alias("p")))
        if hooks.limit(1).count() == 0:
            ws.drop(cross, hooks)
            return labels
        while True:
            up = hooks.select(F.col("c").alias("p"), F.col("p").alias("q"))
            nxt = ws.keep(hooks.join(up, "p", "left").select("c", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")))
            moved = nxt.where("moved").limit(1).count()
            ws.drop(hooks)
            hooks = nxt.drop("moved")
            if not moved:
                break
        new = ws.keep(labels.join(hooks, "c", "left").select("v", F.coalesce("p", "c").alias("c")))
        root, other = hooks.select("c", F.col("p").alias("x")), hooks.select(F.col("c").alias("p"), F.col("p").alias("y"))
        left = cross.join(root, "c").join(other, "p", "left").withColumn("y", F.coalesce("y", "p")).where("x <> y")
        left = ws.keep(left.select(*ends("x", "y")).distinct())
        if labels is not first:
            ws.drop(labels)
        ws.drop(cross, nxt)
        labels, cross = new, left


def components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable over links), kept; one row per row of docs."""
    return grouped(docs, width, percent, Workspace(session_of(docs), "neardup"), id_col, text_col).drop("fp", "c")


def grouped(docs: DataFrame, width: int, percent: int, ws: Workspace, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``components`` with the hash of the text, fp, and the number of the component, c; two components may have one name."""
    spark = session_of(docs)
    text_batches(spark)
    s = ws.keep(sketch(docs, width, id_col, text_col))
    classes = s.where("n > 0 and doc_id is not null").groupBy("key").agg(F.min(F.struct("doc_id", "fp")).alias("one"), F.first("sig").alias("sig"))
    # numbers of vertices are fixed once the table is written
    reps = ws.keep(classes.select(F.monotonically_increasing_id().alias("v"), "key", F.col("one.doc_id").alias("least"), F.col("one.fp").alias("fp"), "sig"))
    bands = F.array(*[F.xxhash64(F.lit(i), F.substring("sig", i * ROWS * 2 + 1, ROWS * 2)) for i in range(BANDS)])
    banded = reps.select("v", F.posexplode(bands).alias("band", "bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1").select("bucket")
    buckets = ws.keep(banded.join(shared, "bucket").select("bucket", "band", "v"))
    labels = ws.keep(buckets.select("v").distinct().withColumn("c", F.col("v")))
    # whole sets are made of one text for each vertex in a shared bucket
    wanted = ws.keep(reps.join(labels, "v", "left_semi").select("v", "least", "fp"))
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    w = ws.small(wanted)
    texts = d.join(w, (d.id == w.least) & (d.h == w.fp)).select("v", "text")
    sets = whole_sets(texts, width)
    if s.where("doc_id is not null").groupBy("doc_id", "fp").count().where("count > 1").limit(1).count():  # repeated rows
        sets = sets.groupBy("v").agg(F.first("items").alias("items"))
    sets = ws.keep(sets)
    sigs = reps.join(ws.small(labels), "v", "left_semi").select("v", "sig")

    def confirm(pairs: DataFrame, one_each: bool) -> DataFrame:
        both = pairs.join(sigs.select(F.col("v").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("v").alias("b"), F.col("sig").alias("sig_b")), "b")
        alive = prune(both, percent / 100, MISS)
        if one_each:  # each vertex's likeliest link is enough for now; what it leaves apart meets again
            alive = alive.groupBy("b").agg(F.max_by("a", "matches").alias("a")).select("a", "b")
        return verify(alive.join(sets.select(F.col("v").alias("a"), F.col("items").alias("items_a")), "a").join(sets.select(F.col("v").alias("b"), F.col("items").alias("items_b")), "b"), percent)

    centres = buckets.groupBy("bucket").agg(F.min("v").alias("a"))
    stars = buckets.join(centres, "bucket").where("v <> a").select("a", F.col("v").alias("b")).distinct()
    with batch_rows(spark, PAIRS):
        links = ws.keep(confirm(stars, True))
    labels = merge_components(ws, labels, links)

    at = ws.keep(buckets.join(labels, "v").select("bucket", "band", "v", "c"))
    parts = at.groupBy("bucket", "c").agg(F.count("*").alias("m")).groupBy("bucket").agg(F.sum("m").alias("m"), F.count("*").alias("parts"), F.max(F.struct("m", "c")).alias("top"))
    mixed = parts.where("parts > 1").select("bucket", "m", F.col("top.c").alias("top"))
    small = at.join(mixed.where(F.col("m") <= SMALL).select("bucket"), "bucket")
    other = small.select("bucket", F.col("v").alias("b"), F.col("c").alias("cb"))
    pairs = small.select("bucket", F.col("v").alias("a"), F.col("c").alias("ca")).join(other, "bucket").where("ca < cb").select("a", "b").distinct()
    big = at.join(mixed.where(F.col("m") > SMALL).select("bucket", "top"), "bucket")
    big = big.join(sets, "v").join(sigs, "v").select("bucket", "band", (F.col("c") != F.col("top")).alias("apart"), F.struct("v", "c", "sig", "items").alias("x"), (F.length("items") + 400).alias("bytes"))
    big = ws.keep(big)
    blocks_of = ws.keep(big.groupBy("bucket").agg(F.ceil(F.sum("bytes") / BLOCK).alias("k"), F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("apart"), F.col("bytes"))) / BLOCK)).alias("k_left")))
    sized = big.join(ws.small(blocks_of), "bucket")
    lefts = sized.where("apart").groupBy("bucket", "band", "k", F.pmod(F.xxhash64("x.v"), F.col("k_left")).alias("no")).agg(F.collect_list("x").alias("lefts"))
    rights = sized.groupBy("bucket", "band", F.pmod(F.xxhash64("x.v"), F.col("k")).alias("to")).agg(F.collect_list("x").alias("rights"))
    # each left block goes to every right block of its bucket, and those are dealt out one by one
    met = lefts.withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))).join(rights, ["bucket", "band", "to"])
    with batch_rows(spark, PAIRS):
        few_links = ws.keep(confirm(pairs, False))
    with batch_rows(spark, 2):
        links = ws.keep(link_blocks(met, percent, MISS))
    labels = merge_components(ws, labels, few_links.unionByName(links))
    ws.drop(buckets, sets, at, big, few_links, links)
    tops = reps.join(labels, "v", "left").select("key", "least", "c", F.coalesce("c", "v").alias("own"))
    names = ws.small(ws.keep(tops.where("c is not null").groupBy(F.col("c").alias("own")).agg(F.min("least").alias("component"))))
    tops = tops.join(names, "own", "left").select("key", F.col("own").alias("c"), F.coalesce("component", "least").alias("component"))
    out = s.join(tops, "key", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "fp", "c", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def dedup(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component. Blank texts and rows without an id stay. Decisions are joined by id and hash of the text."""
    ws = Workspace(session_of(docs), "neardup")
    c = ws.keep(grouped(docs, width, percent, ws))
    full = c.where("doc_id is not null and n_shingles > 0")
    heads = full.where("kept").groupBy("c", "doc_id", "fp").agg(F.count("*").alias("rows"))
    # of a component's kept rows, which have one id but may have several texts, all but the first go
    first = Window.partitionBy("c").orderBy("fp")
    heads = ws.keep(heads.withColumn("place", F.row_number().over(first)).where("rows > 1 or place > 1"))
    key = [F.col("doc_id").alias("__id"), F.col("fp").alias("__fp")]
    g = ws.small(ws.keep(full.where("not kept").select(*key).unionByName(heads.where("place > 1").select(*key)).distinct()))
    h = fresh(docs, "__h")
    keyed = docs.withColumn(h, F.xxhash64("text"))
    out = keyed.join(g, (keyed["doc_id"] == g["__id"]) & (keyed[h] == g["__fp"]), "left_anti")
    twice = ws.keep(heads.where("rows > 1 and place = 1").select(*key))
    if twice.limit(1).count():
        t = ws.small(twice)
        same = (out["doc_id"] == t["__id"]) & (out[h] == t["__fp"])
        out = out.join(t, same, "left_anti").unionByName(out.join(t, same, "left_semi").dropDuplicates(["doc_id", h]))
    return out.select(*docs.columns)

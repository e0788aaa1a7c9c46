"""Toxicity scores: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

Features: densities of a fixed list of insults and of a lexicon of words and word beginnings learnt from labelled texts, second-person
words near such hits, capitals, punctuation, and rates of obfuscated spelling. Texts are read where they lie; the driver sees the lexicon,
counts and feature rows of at most ``SAMPLE`` labelled documents. A label belongs to a doc_id; of several, the highest counts. Of the
sample one part makes the lexicon, one the trees, one the calibration.

Defined results
* nulls: a null text is an empty one; rows without an id or a label are not learnt from but scored, and a null id is held out.
* empty and very long texts: empty texts are scored as well; a text of any length is read whole.
* ties: of several labels of an id the highest counts; of entries of equal weight all are in the lexicon.
* repeated rows: each is learnt from if its id is in the sample, and gets a row with an equal score.
* empty tables: without documents the result is empty; without both classes among the labels every score is the share of toxic ones.
* extra columns: ``report`` reads doc_id and text alone; ``reject`` hands all columns on, whatever their names.
"""
from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, text_batches
from .tokens import slices, split_tokens

#: Labelled rows learnt from, at most; the rows with the least hashes of their ids.
SAMPLE = 20_000
#: Log-odds from which a word or a beginning belongs to the lexicon; the sample bounds their number.
ODDS = 1.5
SEED_WORDS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "dumb", "hate", "kill", "ugly")
SECOND_PERSON = ("you", "your", "yours", "u", "ur", "du", "dein", "deine", "dich", "dir", "ihr", "tu", "te", "ton", "ta", "tes", "toi", "vous", "votre", "usted", "tú", "ti", "tus")
EDGES = ".,;:!?\"'()[]{}<>«»¡¿-_*#~`"
PLAIN = str.maketrans("013457@$!|", "oieastasil")
STEMS = (4, 5, 6)
NAMES = ("length", "seed", "word_share", "word_hits", "word_max", "word_sum", "stem_share", "stem_hits", "stem_max", "stem_sum", "near_you", "you", "capitals", "shouts", "marks", "obfuscated", "unmasked", "drawn_out")
NEAR = 5


def held_out(id_col: Column, k: int) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")), F.lit(0)) % k == 0


@dataclasses.dataclass
class Model:
    words: dict[str, float]
    stems: dict[str, float]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    base: float
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for feature, cut, leaf in self.trees:
            z += _leaf(x, feature, cut, leaf)
        p = 1 / (1 + np.exp(-z))
        return np.clip(np.interp(p, *self.knots), 0, 1) if len(self.knots[0]) else p


def _clean(vocab: list[str]) -> pa.Array:
    return pc.utf8_trim(pa.array(vocab, pa.string()), characters=EDGES)


def _byte_rates(texts: pa.Array, classes: list[bytes]) -> np.ndarray:
    """Counts of each class of bytes in each text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    out = np.zeros((len(texts), len(classes)))
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    full = np.diff(at) > 0
    for k, c in enumerate(classes):
        table = np.zeros(256, np.int64)
        table[list(c)] = 1
        if full.any():
            out[full, k] = np.add.reduceat(table[raw], (at[:-1] - at[0])[full])
    return out


def _sums(values: np.ndarray, size: np.ndarray, how=np.add) -> np.ndarray:
    out = np.zeros(len(size))
    full = size > 0
    if full.any():
        out[full] = how.reduceat(values, (np.cumsum(size) - size)[full])
    return out


def features(texts: pa.Array, words: dict[str, float], stems: dict[str, float]) -> np.ndarray:
    vocab, code, size = split_tokens(texts)
    clean = _clean(vocab)
    look = lambda keys, table: np.append(np.fromiter(table.values(), float, len(table)), 0.0)[pc.fill_null(pc.index_in(keys, pa.array(list(table), pa.string())), len(table)).to_numpy(zero_copy_only=False)]
    word_w = look(clean, words)
    stem_w = np.zeros(len(vocab))
    for k in STEMS:
        stem_w = np.maximum(stem_w, look(pc.utf8_slice_codeunits(clean, 0, k), stems))
    seed = pc.is_in(clean, pa.array(SEED_WORDS)).to_numpy(zero_copy_only=False)
    you = pc.is_in(clean, pa.array(SECOND_PERSON)).to_numpy(zero_copy_only=False)
    odd = pc.match_substring_regex(clean, r"[\pL][0-9@$!|*]+[\pL]|[\pL][.*_-][\pL][.*_-][\pL]").to_numpy(zero_copy_only=False)
    drawn = pc.match_substring_regex(clean, "aaa|eee|iii|ooo|uuu|!!!").to_numpy(zero_copy_only=False)
    bare = np.zeros(len(vocab))
    for i in np.nonzero(odd)[0].tolist():
        w = clean[i].as_py()
        w = w.translate(PLAIN) if any(c.isdigit() or c in "@$!|" for c in w) else "".join(c for c in w if c.isalpha())
        bare[i] = max(words.get(w, 0.0), 2.0 * (w in SEED_WORDS), *(stems.get(w[:k], 0.0) for k in STEMS))
    n = np.maximum(size, 1)
    hit = (word_w > 0) | (stem_w > 0) | seed | (bare > 0)
    at = np.cumsum(you[code].astype(np.int64)) if len(code) else np.zeros(0, np.int64)
    if len(code):
        i = np.arange(len(code))
        first = np.repeat(np.cumsum(size) - size, size)
        last = np.repeat(np.cumsum(size) - 1, size)
        lo, hi = np.maximum(i - NEAR, first), np.minimum(i + NEAR, last)
        near = hit[code] & (at[hi] - at[lo] + you[code[lo]] > 0)
    else:
        near = np.zeros(0, bool)
    letters = _byte_rates(texts, [bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123), *range(128, 256)]), b"!", b"?.,;:*#@$%^&"])
    total = np.maximum(letters[:, 1], 1)
    take = lambda v: _sums(v[code].astype(float), size)
    w_hits, s_hits, hits = take(word_w > 0), take(stem_w > 0), take(hit)
    return np.column_stack([
        np.log1p(size), take(seed) / n, w_hits / n, np.log1p(w_hits), _sums(word_w[code], size, np.maximum), take(word_w), s_hits / n, np.log1p(s_hits),
        _sums(stem_w[code], size, np.maximum), take(stem_w), _sums(near.astype(float), size) / np.maximum(hits, 1), take(you) / n,
        letters[:, 0] / total, letters[:, 2] / n, letters[:, 3] / n, take(odd) / n, take(bare > 0), take(drawn) / n,
    ])


def _leaf(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """Value of the leaf of a full binary tree that each row reaches; inner nodes lie level by level."""
    node = np.zeros(len(x), np.int64)
    while True:
        node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
        if not len(node) or node[0] >= len(feature):
            return leaf[node - len(feature)]


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 80, rate: float = 0.15, depth: int = 3, bins: int = 48, l2: float = 2.0):
    """(trees, base): trees for the logistic loss, split on histograms of quantile bins."""
    base = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
    z, trees, wide = np.full(len(y), base), [], bins + 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            k = 2**level
            best = np.zeros(k)
            split = np.full((k, 2), -1)
            for f in range(x.shape[1]):
                cell = node * wide + binned[:, f]
                gl = np.bincount(cell, g, k * wide).reshape(k, wide).cumsum(1)
                hl = np.bincount(cell, h, k * wide).reshape(k, wide).cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(hl < 1) | (ht - hl < 1)] = 0
                gain[:, len(edges[f]) :] = 0
                b = gain.argmax(1)
                better = gain[np.arange(k), b] > best + 1e-9
                best[better] = gain[np.arange(k), b][better]
                split[better] = np.column_stack([np.full(k, f), b])[better]
            go = np.zeros(len(y), np.int64)
            for j in range(k):
                f, b = split[j]
                if f >= 0:
                    feature[k - 1 + j], cut[k - 1 + j] = f, edges[f][b]
                    own = node == j
                    go[own] = binned[own, f] > b
            node = 2 * node + go
        leaf = -rate * np.bincount(node, g, 2**depth) / (np.bincount(node, h, 2**depth) + l2)
        z += leaf[node]
        trees.append((feature, cut, leaf))
    return trees, base


def isotonic(p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y to p by pooling adjacent violators, joined by straight lines."""
    order = np.argsort(p, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(p[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([a, b, 1])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            a2, b2, n2 = blocks.pop()
            blocks[-1][0] += a2
            blocks[-1][1] += b2
            blocks[-1][2] += n2
    if not blocks:
        return np.zeros(0), np.zeros(0)
    x = np.array([b[0] / b[2] for b in blocks])
    # half a case on either side keeps the ends off 0 and 1
    v = np.array([(b[1] + 0.5 * y.mean()) / (b[2] + 0.5) for b in blocks])
    v = np.maximum.accumulate(v)
    return np.concatenate([[0.0], x, [1.0]]), np.concatenate([[v[0] * 0.5], v, [0.5 + 0.5 * v[-1]]])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 5, sample: int = SAMPLE) -> Model:
    """Learns from labels of ids whose crc32 modulo ``fold`` is not 0."""
    text_batches(docs.sparkSession)
    chosen = labels.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("y")).where(F.col("__id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("__id"), fold))
    chosen = chosen.groupBy("__id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("__id"), "__id").limit(sample)
    part = F.pmod(F.xxhash64(F.lit("part"), "__id"), F.lit(20))
    # at most ``sample`` ids of a few bytes
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("__id")).select("text", "y", part.alias("part")).persist()
    counts = rows.groupBy("y").agg(F.count("*").alias("n"), F.count(F.when(F.col("part") < 10, 1)).alias("a")).collect()
    n, a = {r["y"]: r["n"] for r in counts}, {r["y"]: r["a"] for r in counts}
    if not (n.get(0) and n.get(1) and a.get(0) and a.get(1)):
        share = n.get(1, 0) / max(1, sum(n.values()))
        return Model({}, {}, [], float(np.log((share + 1e-9) / (1 - share + 1e-9))), (np.zeros(0), np.zeros(0)))

    def keys(batches):
        for batch in batches:
            for b in slices(batch, 0):
                vocab, code, size = split_tokens(b.column(0))
                clean = _clean(vocab).to_pylist()
                ids: dict[str, int] = {}
                own = [[ids.setdefault(k, len(ids)) for k in ("=" + w, *("^" + w[:s] for s in STEMS if len(w) >= s))] if len(w) > 2 else [] for w in clean]
                count = np.zeros((len(ids), 2), np.int64)
                ends = np.cumsum(size)
                for end, k, y in zip(ends.tolist(), size.tolist(), b.column(1).to_pylist(), strict=True):
                    seen = {i for w in np.unique(code[end - k : end]).tolist() for i in own[w]}
                    count[list(seen), 1 if y else 0] += 1
                yield pa.RecordBatch.from_arrays([pa.array(list(ids), pa.string()), pa.array(count[:, 0]), pa.array(count[:, 1])], names=["k", "neg", "pos"])

    least = max(2, a[1] // 500)
    seen = rows.where("part < 10").select("text", "y").mapInArrow(keys, "k string, neg long, pos long").groupBy("k").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    odds = F.log((F.col("pos") + 0.5) / (a[1] + 1)) - F.log((F.col("neg") + 0.5) / (a[0] + 1))
    top = seen.where(F.col("pos") >= least).select("k", odds.alias("w")).where(F.col("w") > ODDS).collect()
    words = {r["k"][1:]: r["w"] for r in top if r["k"][0] == "="}
    stems = {r["k"][1:]: r["w"] for r in top if r["k"][0] == "^"}

    def rows_of(batches):
        for batch in batches:
            for b in slices(batch, 0):
                x = features(b.column(0), words, stems)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), lists], names=["y", "part", "x"])

    got = rows.select("text", "y", "part").where("part >= 10").mapInArrow(rows_of, "y int, part long, x array<double>").toPandas()
    rows.unpersist()
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(NAMES))
    order = np.lexsort([*x.T, got["y"].to_numpy(), got["part"].to_numpy()])  # rows arrive in any order; sums then don't depend on it
    x, y, part = x[order], got["y"].to_numpy(float)[order], got["part"].to_numpy()[order]
    fit = part < 17
    if not fit.any():
        fit = ~fit
    trees, base = boost(x[fit], y[fit])
    raw = Model(words, stems, trees, base, (np.zeros(0), np.zeros(0)))
    rest = ~fit if (~fit).sum() >= 200 else np.ones(len(y), bool)
    return dataclasses.replace(raw, knots=isotonic(raw.score(x[rest]), y[rest]))


def add_score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with the score as one more column."""
    text_batches(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    i = docs.columns.index(text_col)
    # broadcasts are pickled by reference: plain values need no module of ours where they are read
    sent = docs.sparkSession.sparkContext.broadcast([getattr(model, f.name) for f in dataclasses.fields(Model)])

    def run(batches):
        m = Model(*sent.value)
        for batch in batches:
            for b in slices(batch, i):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(m.score(features(b.column(i), m.words, m.stems)))], names=[*b.schema.names, name])

    return docs.mapInArrow(run, schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    scored = add_score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, at: float = 0.5) -> DataFrame:
    """docs without those that score ``at`` or more."""
    name = fresh(docs, "score")
    return add_score(docs, train(docs, labels), name=name).where(F.col(name) < at).select(*docs.columns)

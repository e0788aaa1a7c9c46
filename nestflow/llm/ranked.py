"""Ranked lexical search: every item's best documents, as a sparse matrix product in blocks.

The rows of one matrix are items, those of the other terms: multiplicities of terms in items times impacts of terms in documents, in 64-bit integers. Items are taken in blocks of ``ITEM_BYTES`` of text at most
(a longer item is a block of its own), so the terms that are broadcast have a bound, and blocks of documents stream past them. In a block of documents the terms' rows are merged for each item into one row of
scores (Gustavson's way); rows of frequent terms are kept dense. Each task keeps the k best of each item, and what tasks have found is reduced by item. The score to beat starts from ``FIRST`` documents
that were compared before all others, so what tasks find does not grow with their number.

Texts are cut once: what is kept of a document is its number of terms and, of terms that items have, how often they occur.

Defined results
* nulls: a null text, of a document or an item, has no terms; it is never found, or finds nothing. Rows with a null id take part, and null ids come last among equal scores.
* empty and very long texts: a text without terms is as a null one; texts are read whole.
* ties: equal scores by ascending doc_id; rank is unique.
* repeated rows: each row of documents is a document of its own; each row of items has its own results, though equal ones are searched once.
* an empty table, of documents or items, gives an empty result.
* extra columns: only ids and texts are read, so others may have any name.
"""
from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, session_of, text_batches
from .tokens import slices, tidy

#: Bytes of item texts in a block of items.
ITEM_BYTES = 16_000_000
#: Documents, and occurrences of terms, in a block of documents.
DOCUMENTS, POSTINGS = 8192, 4_000_000
#: Documents that set the first scores to beat.
FIRST = 16_384
#: Bytes that are no part of a term become spaces, A-Z become a-z; bytes of other characters stay.
_IN_TERM = frozenset(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
TERM_BYTES = bytes(x | 32 if 65 <= x <= 90 else x if x >= 128 or x in _IN_TERM else 32 for x in range(256))


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(terms of all texts, the text that each is of)."""
    texts = pa.concat_arrays([pc.fill_null(texts.cast(pa.string()), "")])
    _, offsets, data = texts.buffers()
    data = pa.py_buffer(data.to_pybytes().translate(TERM_BYTES)) if data else data
    lists = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(texts), offsets, data, None, 0, texts.offset))
    terms = lists.flatten()
    of = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    full = pc.not_equal(terms, "")  # empty ones stand before leading and after trailing gaps
    return terms.filter(full), of[full.to_numpy(zero_copy_only=False)]


def count_terms(docs: DataFrame, terms: list[str], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, codes, tf) of the rows that have a term: how many they have, and the places in ``terms`` of those they share with it, with their occurrences."""
    spark = session_of(docs)
    shared = spark.sparkContext.broadcast(pa.array(terms, pa.string()))
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("tf", T.ArrayType(T.LongType()))])

    def run(batches):
        known = shared.value
        for batch in batches:
            for part in slices(batch, 1):
                found, of = cut(part.column(1))
                code = pc.fill_null(pc.index_in(found, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                n = np.bincount(of, minlength=part.num_rows)
                pair, tf = np.unique((of * (len(known) + 1) + code)[code >= 0], return_counts=True)
                ends = np.searchsorted(pair, np.arange(part.num_rows + 1) * (len(known) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in ((pair % (len(known) + 1)).astype(np.int32), tf.astype(np.int64))]
                out = pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), *lists], names=schema.names)
                yield out.filter(pa.array(n > 0))

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


class Best:
    """The k best documents of each item so far, as (score, whether the id is null, id), and the score that each item has to beat."""

    def __init__(self, items: list[tuple[np.ndarray, np.ndarray]], k: int, need: np.ndarray):
        self.items, self.k, self.need = items, k, need.copy()
        self.top = [np.zeros((3, 0), np.int64) for _ in items]

    def take(self, ids: np.ndarray, null: np.ndarray, doc: np.ndarray, code: np.ndarray, weight: np.ndarray, n_terms: int) -> None:
        """A block of documents: of each occurrence of a term its document, its code, and its impact times the term's weight."""
        order = np.argsort(code, kind="stable")
        doc, weight = doc[order], weight[order]
        at = np.searchsorted(code[order], np.arange(n_terms + 1)).tolist()
        score, dense = np.zeros(len(ids), np.int64), {}
        for i, (terms, times) in enumerate(self.items):
            score[:] = 0
            for t, m in zip(terms.tolist(), times.tolist(), strict=True):
                a, b = at[t], at[t + 1]
                if 8 * (b - a) > len(ids):
                    row = dense.get(t)
                    if row is None:
                        row = dense[t] = np.zeros(len(ids), np.int64)
                        row[doc[a:b]] = weight[a:b]
                    score += row if m == 1 else m * row
                elif b > a:
                    score[doc[a:b]] += weight[a:b] if m == 1 else m * weight[a:b]
            hit = np.nonzero(score >= self.need[i])[0]
            if len(hit) > self.k:
                hit = hit[score[hit] >= np.partition(score[hit], -self.k)[-self.k]]
            if len(hit):
                both = np.hstack([self.top[i], np.vstack([score[hit], null[hit], ids[hit]])])
                self.top[i] = both = both[:, np.lexsort([both[2], both[1], -both[0]])[: self.k]]
                if both.shape[1] == self.k:
                    self.need[i] = max(self.need[i], both[0, -1])


def best_documents(counted: DataFrame, items: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, total: tuple[int, int], need: np.ndarray, k: int) -> DataFrame:
    """(item, score, null_id, doc_id): the k best documents of each item in each task; items by their place."""
    n_docs, n_all = total
    shared = session_of(counted).sparkContext.broadcast((items, weights, need))

    def run(batches):
        items, weights, need = shared.value
        best, held, size = Best(items, k, need), [], [0, 0]

        def multiply():
            ids, n, codes, tfs, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
            doc = np.repeat(np.arange(len(n)), sizes)
            m = 50 + (50 * n * n_docs) // n_all
            impact = (1_000_000_000 * tfs) // (1000 * tfs + 20 * m[doc])
            best.take(ids[:, 0], ids[:, 1], doc, codes, weights[codes] * impact, len(weights))
            held.clear()
            size[:] = [0, 0]

        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                null = b.column(0).is_null().to_numpy(zero_copy_only=False)
                ids = np.stack([pc.fill_null(b.column(0), 0).to_numpy(zero_copy_only=False).astype(np.int64), null.astype(np.int64)], 1)
                codes, tfs = b.column(2).flatten(), b.column(3).flatten()
                sizes = pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)
                held.append((ids, b.column(1).to_numpy(zero_copy_only=False), codes.to_numpy(zero_copy_only=False).astype(np.int64), tfs.to_numpy(zero_copy_only=False), sizes))
                size[0] += b.num_rows
                size[1] += len(codes)
                if size[0] >= DOCUMENTS or size[1] >= POSTINGS:
                    multiply()
        if held:
            multiply()
        tidy()
        for i, (score, null, ids) in enumerate(best.top):
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), i), pa.int64()), pa.array(score), pa.array(null.astype(bool)), pa.array(ids, mask=null.astype(bool))], names=["item", "score", "null_id", "doc_id"])

    return counted.mapInArrow(run, "item long, score long, null_id boolean, doc_id long")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("item").orderBy(F.desc("score"), "null_id", "doc_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, block: list, k: int, once: bool, names: tuple[str, str], ws: Workspace, item_type: T.DataType) -> DataFrame:
    """Results of one block of items, as (id, text, number of such rows)."""
    spark = session_of(docs)
    terms, of = cut(pa.array([r[1] for r in block], pa.string()))
    coded = terms.dictionary_encode()
    code, vocabulary = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
    counted = ws.keep(count_terms(docs, vocabulary, *names))
    n_docs, n_all = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(counted.select(F.explode("codes").alias("c")).groupBy("c").count().collect())  # a row for each term of the block
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(c, 0) + 1))) for c in range(len(vocabulary))], np.int64)
    items, ends = [], np.searchsorted(of, np.arange(len(block) + 1))
    for a, b in zip(ends, ends[1:]):
        own, times = np.unique(code[a:b], return_counts=True)
        items.append((own, np.ones_like(times) if once else times))
    args = (items, weights, (n_docs, n_all))
    first = counted.select(*counted.columns, F.xxhash64("doc_id", "n", "codes").alias("__order")).orderBy("__order").limit(FIRST).drop("__order")
    need = np.ones(len(items), np.int64)
    for r in _ranked(best_documents(first, *args, need, k), k).where(F.col("rank") == k).select("item", "score").collect():  # a row for each item of the block
        need[r["item"]] = max(1, r["score"])
    found = ws.keep(_ranked(best_documents(counted, *args, need, k), k))
    ws.drop(counted)
    named = T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", item_type), T.StructField("copies", T.IntegerType())])
    named = spark.createDataFrame([(i, r[0], r[2]) for i, r in enumerate(block)], named).withColumn("__", F.explode(F.sequence(F.lit(1), "copies")))
    return found.join(F.broadcast(named), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 50, once: bool = True, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item, scores above 0. Without ``once`` a term counts as often as the item has it."""
    spark = session_of(docs)
    text_batches(spark)
    ws = Workspace(spark, "ranked")
    rows = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text")).groupBy("item_id", "text").agg(F.count("*").cast("int").alias("copies"))
    blocks = -(-int(rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]) // ITEM_BYTES)
    out = []
    for b in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        if block:
            out.append(_search_block(docs, block, k, once, (doc_id, doc_text), ws, items.schema[item_id].dataType))
    if not out:
        schema = T.StructType([T.StructField("item_id", items.schema[item_id].dataType), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, out)

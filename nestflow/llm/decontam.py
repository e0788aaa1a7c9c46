"""Benchmark decontamination: windows of test items found in training documents, with built-in functions only.

A window is ``n`` consecutive words of an item; an item of fewer words (but not none) is one window. The distinct windows' hashes, 64 bits
each, are the broadcast set. Each document position is hashed the same way and looked up; only where the hash is in the set are the words
cut out and compared with the window's. If the set's files hold more than ``common.BROADCAST_BYTES``, positions and hashes are shuffled instead, without any words,
and the words are cut out of the documents that have hits.

Defined results
* nulls: a null text has no words and no hits; a null item text has no windows; items with a null id mark words as hit, but are not named in ``items``.
* empty and very long texts: a blank text has no words; a text of any length is read whole.
* ties: windows of several items name all of them; overlapping hits count each word once.
* repeated rows: document rows each get a row; rows that share an id but not a text are told apart by a hash of the text. Repeated items count once.
* empty tables: without documents the result is empty, without windows no word is hit.
* extra columns: only the two named columns of either table are read, so others may have any name.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, Workspace, ascii_lower, fresh, null_safe, session_of, split_words


def words_of(c: Column) -> Column:
    return split_words(ascii_lower(c), WORD_GAP)


def benchmark_windows(benchmark: DataFrame, n: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(len, h, words, items): the distinct windows and the sorted ids, as strings, of the items that have them."""
    b = benchmark.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    b = b.select("item", "w", F.least(F.size("w"), F.lit(n)).alias("len"))
    b = b.select("item", "len", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1), lambda i: F.slice("w", i, F.col("len")))).alias("words"))
    return b.groupBy("len", "words").agg(F.sort_array(F.collect_set("item")).alias("items")).select("len", F.xxhash64("words").alias("h"), "words", "items")


def _window_hash(length: int) -> Column:
    """Hash of the window that starts at pos; equal to xxhash64 of the array of the same words, as both chain seeds."""
    return F.xxhash64(*[F.get("w", F.col("pos") + i) for i in range(length)])


def _positions(d: DataFrame, lengths: list[int], start: int) -> DataFrame:
    """d, which has (id, fp, w, n_words), with a row for each position from ``start`` and length of a window: pos, len, h; h is null where no window fits."""
    d = d.select("*", F.explode(F.sequence(F.lit(start), F.greatest(F.col("n_words") - 1, F.lit(start)))).alias("pos"))
    of = lambda k: F.when((F.col("pos") >= 0) & (F.col("pos") + k <= F.col("n_words")), _window_hash(k))
    if len(lengths) == 1:
        return d.withColumn("len", F.lit(lengths[0])).withColumn("h", of(lengths[0]))
    d = d.withColumn("k", F.explode(F.array(*[F.struct(F.lit(k).alias("len"), of(k).alias("h")) for k in lengths])))
    return d.select("id", "fp", "w", "n_words", "pos", F.col("k.len").alias("len"), F.col("k.h").alias("h"))


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: id, fp (hash of the text), n_words, n_hit, spans (word positions, [start, end)), items.

    The scan tokenises each text once. Only hits and one row per document are shuffled.
    """
    ws = Workspace(session_of(docs), "windows")
    win = ws.keep(benchmark_windows(benchmark, n))
    lengths = sorted(r["len"] for r in win.select("len").distinct().collect()) or [n]  # n numbers at most
    known = ws.keep(win.select(F.col("len").alias("k_len"), F.col("h").alias("k_h")).distinct())
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("fp"), words_of(F.col(text_col)).alias("w"))
    d = d.select("id", "fp", "w", F.size("w").alias("n_words"))
    cut = F.slice("w", F.greatest(F.col("pos") + 1, F.lit(1)), F.col("len")).alias("x")
    same = lambda at: (at["h"] == known["k_h"]) & (at["len"] == known["k_len"])
    if ws.is_small(known):
        # position -1 stands for the document itself
        at = _positions(d, lengths, -1)
        hit = at.join(F.broadcast(known), same(at), "left").where(F.col("k_h").isNotNull() | ((F.col("pos") == -1) & (F.col("len") == lengths[0])))
        hit = hit.select("id", "fp", "n_words", "pos", "len", "h", F.when(F.col("pos") >= 0, cut).alias("x"))
    else:
        at = _positions(d, lengths, 0).where("h is not null").select("id", "fp", "pos", "len", "h")
        found = ws.keep(at.join(known, same(at), "left_semi").groupBy("id", "fp").agg(F.collect_set(F.struct("pos", "len", "h")).alias("hits")))
        f = found.select(F.col("id").alias("i"), F.col("fp").alias("p"), "hits")
        none = F.struct(F.lit(-1).alias("pos"), F.lit(lengths[0]).alias("len"), F.lit(None).cast("long").alias("h"))
        both = d.join(f, null_safe(d, f, [("id", "i"), ("fp", "p")]), "left").select("id", "fp", "w", "n_words", F.explode(F.concat(F.array(none), F.coalesce("hits", F.array().cast("array<struct<pos:int,len:int,h:bigint>>")))).alias("k"))
        hit = both.select("id", "fp", "w", "n_words", "k.pos", "k.len", "k.h").select("id", "fp", "n_words", "pos", "len", "h", F.when(F.col("pos") >= 0, cut).alias("x"))
    # documents' own rows match no window, but are spread like the others
    hit = hit.select("id", "fp", "n_words", "pos", F.when(F.col("pos") >= 0, F.col("len")).otherwise(-1).alias("len"), F.when(F.col("pos") >= 0, F.col("h")).otherwise(F.xxhash64("id", "fp")).alias("h"), "x")
    w = ws.small(win).select(F.col("len").alias("w_len"), F.col("h").alias("w_h"), "words", "items")
    # equal hashes are joined; that the words are equal is a check on what has been joined, not a key
    hit = hit.join(w, (hit["len"] == F.col("w_len")) & (hit["h"] == F.col("w_h")), "left").withColumn("true", F.coalesce(F.col("x") == F.col("words"), F.lit(False)))
    hit = hit.where("pos = -1 or true")
    hit = hit.select("id", "fp", "n_words", "items", F.when(F.col("pos") == -1, 1).otherwise(0).alias("rows"), F.when(F.col("pos") >= 0, F.struct("pos", (F.col("pos") + F.col("len")).alias("end"))).alias("span"))
    g = hit.groupBy("id", "fp", "n_words").agg(F.sum("rows").alias("rows"), F.sort_array(F.collect_set("span")).alias("raw"), F.collect_set("items").alias("sets"))
    # union of the sorted windows
    none = F.array().cast("array<struct<pos:int,end:int>>")
    spans = F.aggregate(
        "raw", F.struct(none.alias("done"), F.lit(0).alias("a"), F.lit(0).alias("b")),
        lambda s, x: F.when(x.pos <= s.b, F.struct(s.done.alias("done"), F.when(s.a == s.b, x.pos).otherwise(s.a).alias("a"), F.greatest(s.b, x.end).alias("b")))
        .otherwise(F.struct(F.when(s.b > s.a, F.concat(s.done, F.array(F.struct(s.a.alias("pos"), s.b.alias("end"))))).otherwise(s.done).alias("done"), x.pos.alias("a"), x.end.alias("b"))),
        lambda s: F.when(s.b > s.a, F.concat(s.done, F.array(F.struct(s.a.alias("pos"), s.b.alias("end"))))).otherwise(s.done),
    )
    g = g.select("id", "fp", "rows", F.col("n_words").cast("long").alias("n_words"), spans.alias("spans"), F.sort_array(F.array_distinct(F.flatten("sets"))).alias("items"))
    g = g.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s.end - s.pos)))
    return g.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).drop("copy", "rows")


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    r = find_hits(docs, benchmark, n)
    return r.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def remove(docs: DataFrame, benchmark: DataFrame, n: int = 10, mode: str = "document", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that hold a window (mode "document"), or with the hit words cut out (mode "span").

    In span mode a hit word goes with the gap that follows it; all columns but the text stay as they are. The contaminated keys are broadcast
    if they are few in bytes.
    """
    ws = Workspace(session_of(docs), "contaminated")
    spans = [F.col("spans").alias("__spans")] if mode == "span" else []
    bad = ws.keep(find_hits(docs, benchmark, n, id_col, text_col).where("n_hit > 0").select(F.col("id").alias("__id"), F.col("fp").alias("__fp"), *spans).dropDuplicates(["__id", "__fp"]))
    b, h = ws.small(bad), fresh(docs, "__h")
    keyed = docs.withColumn(h, F.xxhash64(text_col))
    cond = null_safe(keyed, b, [(id_col, "__id"), (h, "__fp")])
    if mode == "document":
        return keyed.join(b, cond, "left_anti").select(*docs.columns)
    piece = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
    lead = F.regexp_extract(text_col, r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    left = F.filter(F.regexp_extract_all(text_col, F.lit(f"({piece})"), 1), lambda w, i: ~F.exists(b["__spans"], lambda s: (s.pos <= i) & (i < s.end)))
    text = F.when(b["__spans"].isNull(), F.col(text_col)).otherwise(F.concat(lead, F.array_join(left, "")))
    return keyed.join(b, cond, "left").select(*[text.alias(c) if c == text_col else keyed[c] for c in docs.columns])

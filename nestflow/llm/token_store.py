"""Token ids as Parquet list columns: written in ascending id order, in row groups and pages of a chosen size, and read back.

The file format: one row per document with columns doc_id, part (number of the range of ids the file holds),
row (ascends in the files' order), n_tokens, ids (list of int). Ids are dictionary-encoded (Parquet falls back by itself where a dictionary does not pay) or, with
``encoding="delta"``, DELTA_BINARY_PACKED. Pages hold ``page_rows`` rows at most and row groups ``row_group_mb``; column and offset
indexes are written, so a reader of a range of ids fetches only those pages, and one of metadata never touches the lists.

Defined results
* nulls: a null text is encoded as an empty one; a null doc_id comes first.
* empty and very long texts: an empty text is the end id alone; a text of any length is encoded whole, and is one row.
* ties: rows that share an id are ordered by a hash of the text.
* repeated rows: each is written; equal rows stand side by side.
* an empty table gives files without rows, and an empty result.
* extra columns: only doc_id and text are read, so others may have any name. A special token's string in a text is that token, as the library's plain call has it.
"""
from __future__ import annotations

import json
import os
import sys
import zlib
from itertools import chain, repeat
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, session_of, text_batches
from .tokens import slices, tidy

#: Spaces that have white space on both sides: a split there could change how the tokenizer cuts the text.
_WHITE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
UNSAFE = f"{_WHITE} {_WHITE}"
#: Marks at the end of a word, and the letters behind which the tokenizer surely cuts them off.
MARKS, LETTER = ".,!?;:", "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]$"
#: Texts that are encoded at a time, in bytes.
CHUNK = 4_000_000


class Pieces:
    """Ids of pieces of text. Remembers the first ``limit`` distinct pieces it meets; others are encoded each time."""

    def __init__(self, tok, spec: dict, limit: int = 300_000):
        self.tok, self.limit = tok, limit
        cut = spec.get("pre_tokenizer") or {}
        #: Whether the tokenizer cuts texts before single spaces, whatever stands around them.
        self.cuts = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not spec.get("normalizer") and not spec.get("post_processor")
        #: Strings that the tokenizer finds before it cuts a text; one that takes in space would change where it cuts.
        self.cuts = self.cuts and not any(" " in t["content"] or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens") or [])
        self.row: dict[str, int] = {}
        self.flat, self.ends = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.opens = np.array([(tok.id_to_token(i) or "").startswith("\u0120") for i in range(tok.get_vocab_size())])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids per text), each text by itself."""
        ids = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum())), size

    def encode_spaced(self, texts: list[str], at_once: int = 1000) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts that begin with a space, have no other, and do not end in white space.

        They are encoded as a few long texts. An id whose token begins with a space begins a text.
        """
        if not texts:
            return self.encode(texts)
        flat, _ = self.encode(["".join(texts[i : i + at_once]) for i in range(0, len(texts), at_once)])
        starts = np.nonzero(self.opens[flat])[0]
        if len(starts) != len(texts) or starts[0]:
            return self.encode(texts)
        return flat, np.diff(np.append(starts, len(flat)))

    def look_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, start, size), the last two by word, of words that stand behind a space, which their ids take in."""
        rows = np.fromiter(map(self.row.get, words, repeat(-1)), np.int64, len(words))
        miss = np.nonzero(rows < 0)[0].tolist()
        # beside a neighbour, one that ends in white space might be cut otherwise than by itself
        safe = [i for i in miss if not (words[i] or " ")[-1].isspace()]
        rest = [i for i in miss if (words[i] or " ")[-1].isspace()]
        known = len(self.ends)
        (f1, n1), (f2, n2) = self.encode_spaced([" " + words[i] for i in safe]), self.encode([" " + words[i] for i in rest])
        flat = np.concatenate([self.flat, f1, f2])
        ends = np.concatenate([self.ends, (self.ends[-1] if known else 0) + np.cumsum(np.concatenate([n1, n2]))])
        new = safe + rest
        rows[new] = known + np.arange(len(new))
        if room := min(self.limit - known, len(new)):
            self.row.update((words[i], known + k) for k, i in enumerate(new[:room]))
            self.ends = ends[: known + room].copy()
            self.flat = flat[: self.ends[-1]].copy()
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        return flat, starts[rows], (ends - starts)[rows]

    def table(self, vocab: pa.Array, heads: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, start, size) of the vocabulary behind a space, then of the heads as they are.

        The tokenizer also cuts between a letter and marks, so a word that ends in marks is looked up without them.
        """
        bare = pc.utf8_rtrim(vocab, characters=MARKS)
        cut = pc.and_(pc.not_equal(bare, vocab), pc.match_substring_regex(bare, LETTER)).to_numpy(zero_copy_only=False)
        words = pc.if_else(pa.array(cut), bare, vocab).dictionary_encode()
        flat, start, size = self.look_up(words.dictionary.to_pylist())
        code = words.indices.to_numpy(zero_copy_only=False)
        where = np.nonzero(cut)[0]
        picked = pa.array(where)
        tails = pa.array([p[len(q) :] for p, q in zip(vocab.take(picked).to_pylist(), bare.take(picked).to_pylist(), strict=True)], pa.string()).dictionary_encode()
        tail_list = tails.dictionary.to_pylist()
        more, n = self.encode(tail_list + heads)
        begin = len(flat) + np.cumsum(n) - n
        # word, then marks
        starts, sizes = np.zeros((len(vocab), 2), np.int64), np.zeros((len(vocab), 2), np.int64)
        starts[:, 0], sizes[:, 0] = start[code], size[code]
        tail = tails.indices.to_numpy(zero_copy_only=False)
        starts[where, 1], sizes[where, 1] = begin[tail], n[tail]
        k = len(tail_list)
        total = np.concatenate([sizes.sum(1), n[k:]])
        out = gather(np.concatenate([flat, more]), np.concatenate([starts.ravel(), begin[k:]]), np.concatenate([sizes.ravel(), n[k:]]))
        return out, np.cumsum(total) - total, total


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of flat that begin at start and have these sizes, one after another."""
    some = np.nonzero(size)[0]
    if not len(some):
        return flat[:0]
    start, size = start[some], size[some]
    step = np.ones(int(size.sum()), np.int32)
    step[0] = start[0]
    step[np.cumsum(size[:-1])] = start[1:] - (start[:-1] + size[:-1] - 1)
    np.cumsum(step, out=step)
    return flat[step]


def encode_texts(pieces: Pieces, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids (uint32) and each text's number of ids, end id included.

    The tokenizer cuts a text before a space that has no white space on both sides, and encodes the parts one by one. So texts
    are split there, each distinct part is encoded once, and the ids are gathered. Texts with other white space are
    encoded whole.
    """
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    texts = pc.fill_null(texts, "")
    odd = pc.match_substring_regex(texts, UNSAFE).to_numpy(zero_copy_only=False) if pieces.cuts else np.ones(n, bool)
    lists = pc.split_pattern(pc.if_else(pa.array(odd), "", texts) if odd.any() else texts, " ")
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = lists.flatten().dictionary_encode()
    code = codes.indices.to_numpy(zero_copy_only=False).copy()
    heads = np.cumsum(counts) - counts  # first pieces have no space before them
    head_codes, head_row = np.unique(code[heads], return_inverse=True)
    code[heads] = len(codes.dictionary) + head_row
    flat, start, size = pieces.table(codes.dictionary, codes.dictionary.take(pa.array(head_codes)).to_pylist())
    piece_n = size[code]
    piece_n[heads[odd]] = 0  # the empty stand-ins of odd texts
    total = np.add.reduceat(piece_n, heads) + 1
    whole = {}
    if odd.any():
        where = np.nonzero(odd)[0].tolist()
        whole = dict(zip(where, (e.ids for e in pieces.tok.encode_batch_fast([texts[i].as_py() for i in where], add_special_tokens=False)), strict=True))
        for i, x in whole.items():
            total[i] += len(x)
    ends = np.cumsum(total)
    out = np.full(int(ends[-1]), end_id, np.uint32)
    mask = np.ones(len(out), bool)
    mask[ends - 1] = False
    for i, x in whole.items():
        mask[ends[i] - total[i] : ends[i]] = False
        out[ends[i] - total[i] : ends[i] - 1] = x
    out[mask] = gather(flat, start[code], piece_n)
    return out, total


def load_pieces(path: str) -> Pieces:
    """One table of pieces for each Python worker, which serves many tasks."""
    kept = sys.modules.setdefault("nestflow_worker_tables", ModuleType("nestflow_worker_tables")).__dict__
    if path not in kept:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kept[path] = Pieces(tok, spec)
    return kept[path]


def encode(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): one row per row of docs, partitioned as docs is."""
    text_batches(session_of(docs))
    key = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", key), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        pieces = load_pieces(tokenizer)
        for batch in batches:
            for part in slices(batch, 1, CHUNK):
                ids, n = encode_texts(pieces, part.column(1).cast(pa.string()), end_id)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), lists], names=["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, encoding: str = "dictionary", row_group_mb: int = 32, page_rows: int = 2000, partitions: int | None = None) -> None:
    """Encodes docs and writes the files under path. Texts are dealt out by ranges of ids before they are encoded."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding {encoding!r}")
    d, keys = docs.select("doc_id", "text"), ["doc_id"]
    if d.where("doc_id is null").limit(1).count():  # rows without an id are dealt out by hashes of their texts
        keys.append(F.xxhash64("text"))
    d = d.repartitionByRange(partitions, *keys) if partitions else d.repartitionByRange(*keys)
    e = encode(d.sortWithinPartitions("doc_id", F.xxhash64("text")), tokenizer, end_id)
    e = e.select("doc_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"), "n_tokens", "ids")
    e.write.options(**{
        "compression": "zstd", "parquet.compression.codec.zstd.level": "1", "parquet.block.size": str(row_group_mb << 20), "parquet.page.row.count.limit": str(page_rows), "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": str(encoding == "dictionary").lower(), "parquet.enable.dictionary#doc_id": "false", "parquet.page.write-checksum.enabled": "true",
    }).parquet(path)


def read(spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "part", "row", "n_tokens", "ids"), first=None, last=None) -> DataFrame:
    """The chosen columns, and with first or last only that range of ids; page indexes spare the rest."""
    df = spark.read.parquet(path)
    if first is not None:
        df = df.where(F.col("doc_id") >= first)
    if last is not None:
        df = df.where(F.col("doc_id") <= last)
    return df.select(*columns)


def checksums(stored: DataFrame) -> DataFrame:
    """Adds ids_crc32 in place of ids: crc32 of the ids as little-endian unsigned 32-bit integers."""
    text_batches(session_of(stored))
    kept = [f for f in stored.schema.fields if f.name != "ids"]
    schema = T.StructType([*kept, T.StructField("ids_crc32", T.LongType())])
    names = [f.name for f in kept]

    def run(batches):
        for b in batches:
            lists = b.column(b.schema.get_field_index("ids"))
            values, at = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), lists.offsets.to_numpy()
            crc = [zlib.crc32(values[x:y].tobytes()) for x, y in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(k)) for k in names], pa.array(crc, pa.int64())], names=[*names, "ids_crc32"])
            tidy()

    return stored.mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0, **options) -> DataFrame:
    """Writes docs to the shared folder and reads back doc_id, start (ids before it in the files' order), n_tokens and ids_crc32.

    The running total is kept within a file; the files' totals, a row each, are added up apart."""
    spark = session_of(docs)
    path = Workspace(spark, "tokens").path()
    write(docs, path, tokenizer, end_id, **options)
    stored = read(spark, path)
    # totals come from a scan of two narrow columns, not from the lists
    meta = read(spark, path, ("part", "n_tokens")).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = meta.select(F.col("part").alias("p"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    c = checksums(stored)
    w = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    run = c.withColumn("upto", F.sum("n_tokens").over(w))
    return run.join(before, run.part == before.p).select("doc_id", (F.col("before") + F.col("upto") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")

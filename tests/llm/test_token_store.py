import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nestflow.llm import token_store

from .helpers import ODD, docs

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = token_store.load_pieces(PATH)


@given(st.lists(st.one_of(st.none(), st.text(max_size=30), st.text("aB 1.'\n\té\u3000\x1c", max_size=30)), max_size=12))
@settings(max_examples=150, deadline=None)
def test_pieces_give_the_tokenizers_ids(texts):
    import pyarrow as pa

    ids, n = token_store.encode_texts(PIECES, pa.array(texts, pa.string()), 0)
    want = [PIECES.tok.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and n.tolist() == [len(w) for w in want]


def check(got, table):
    order = sorted(table, key=lambda r: (r[0] is not None, r[0] or 0))
    want, at = [], 0
    for i, t, *_ in order:
        ids = PIECES.tok.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_round_trip(spark, encoding):
    check(token_store.round_trip(docs(spark, extra=True), PATH, encoding=encoding, partitions=3).collect(), ODD)
    check(token_store.round_trip(docs(spark, ODD[:0]), PATH, encoding=encoding).collect(), [])


def test_files(spark, tmp_path):
    out = str(tmp_path / "t")
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), F.col("id")).alias("text"))
    token_store.write(df, out, PATH, partitions=2, page_rows=100, row_group_mb=1)
    files = sorted((tmp_path / "t").glob("*.parquet"))
    seen = [x for f in files for x in pq.read_table(f, columns=["doc_id"])["doc_id"].to_pylist()]
    assert seen == list(range(5000))
    col = pq.ParquetFile(files[0]).metadata.row_group(0).column(0)
    assert col.has_offset_index and col.has_column_index
    part = token_store.read(spark, out, ("doc_id", "n_tokens"), 100, 120)
    assert sorted(r.doc_id for r in part.collect()) == list(range(100, 121))
    plan = part._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,100)" in plan and "ids" not in plan.split("ReadSchema")[-1]
    with pytest.raises(ValueError):
        token_store.write(df, out, PATH, encoding="other")


@pytest.mark.parametrize("encoding, want", [("delta", "DELTA_BINARY_PACKED"), ("dictionary", "RLE_DICTIONARY")])
def test_encoding_of_pages(spark, tmp_path, encoding, want):
    out = tmp_path / "t"
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the same few words "), F.col("id") % 7).alias("text"))
    token_store.write(df, str(out), PATH, encoding=encoding, partitions=1, page_rows=200)
    (file,) = out.glob("*.parquet")
    group = pq.ParquetFile(file).metadata.row_group(0)
    columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    ids = next(c for k, c in columns.items() if k.startswith("ids"))
    assert want in ids.encodings and all(c.has_offset_index and c.has_column_index for c in columns.values())


def test_rows_without_id_are_dealt_out(spark, tmp_path):
    table = [(None, f"text {i} of many", "", "", 0) for i in range(300)] + [(i, "with an id", "", "", 0) for i in range(30)]
    d = docs(spark, table)
    out = tmp_path / "t"
    token_store.write(d, str(out), PATH, partitions=4)
    holding = [f for f in out.glob("*.parquet") if pq.read_table(f, columns=["doc_id"])["doc_id"].null_count]
    assert len(holding) > 1
    got = token_store.round_trip(d, PATH, partitions=4).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.start) for r in got)[299:301][0][0] is False and len({r.start for r in got}) == 330
    ends = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))


def test_a_special_tokens_string_is_that_token(spark):
    """Ids of the library's plain call, as it is without any flag."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    table = [(i, t, "", "", 0) for i, t in enumerate(["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>!", " <|endoftext|> <|endoftext|>\n", "a  <|endoftext|>  b <|endof text|>", "\u00e9.<|endoftext|>. <|endoftext|>, y"])]
    assert plain.encode(table[0][1], add_special_tokens=False).ids == [64, 220, 50256, 275]
    got = {r.doc_id: r.ids for r in token_store.encode(docs(spark, table), PATH).collect()}
    assert got == {i: [*plain.encode(t, add_special_tokens=False).ids, 0] for i, t, *_ in table}

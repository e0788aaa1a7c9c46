import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from nestflow.llm import pieces

from .helpers import ODD, docs, rows

PATH = public_tokenizers.path("piece_bpe_32k.model")
TABLE = pieces.load_table(PATH)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


@given(st.one_of(st.text(max_size=40), st.text("ab  ▁etinhs\n\t.é漢字😀0́ﬁ", max_size=60), st.text(" ▁", max_size=40)))
@settings(max_examples=600, deadline=None)
def test_ids_are_the_librarys(text):
    ids = TABLE.encode(text)
    assert ids == LIBRARY.encode(text) and LIBRARY.decode(ids) == LIBRARY.decode(LIBRARY.encode(text))


@pytest.mark.parametrize("text", ["the" * 50_000, " " * 50_001, "漢" * 20_000, "͸" * 5000, " ".join(["word"] * 30_000)])
def test_long_texts(text):
    assert TABLE.encode(text) == LIBRARY.encode(text)


def test_pairs_fit_as_the_library_says():
    some = sorted(TABLE.merges)[::97]
    for a in some[::7]:
        for b in some[::5]:
            s = TABLE.text[a] + TABLE.text[b]
            if not s.startswith(pieces.SPACE):  # the library puts a space in front
                s = pieces.SPACE + s
                continue
            assert TABLE.fits(a, b) == (LIBRARY.encode(s[1:].replace(pieces.SPACE, " ")) == [a, b])


def test_every_prefix_has_its_last_token():
    part = "▁unbelievablythewordsmith's"
    last = TABLE.last_tokens(part)
    assert [last[k] for k in range(2, len(part) + 1)] == [LIBRARY.encode(part[1:k])[-1] for k in range(2, len(part) + 1)]


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(pieces, "PARTS", 3)
    monkeypatch.setattr(pieces, "PAIRS", 5)
    table = pieces.Table(PATH)
    for _, text, *_ in ODD * 2:
        assert table.encode(text or "") == LIBRARY.encode(text or "")
    assert len(table.parts) <= 3


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_digests(spark):
    got = rows(pieces.digests(docs(spark, extra=True), PATH), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = []
    for i, text, *_ in ODD:
        ids = [*LIBRARY.encode(text or ""), 2]
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(LIBRARY.decode(ids))))
    assert sorted(got.elements(), key=str) == sorted(want, key=str)
    assert pieces.digests(docs(spark, ODD[:0]), PATH).collect() == []


def test_decode(spark):
    e = pieces.encode(docs(spark), PATH)
    assert e.columns == ["doc_id", "n_tokens", "ids"]
    want = {(i, LIBRARY.decode(LIBRARY.encode(t or ""))) for i, t, *_ in ODD}
    assert {(r.doc_id, r.decoded) for r in pieces.decode(e, PATH).collect()} == want
    null = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert pieces.decode(null, PATH).first().decoded is None

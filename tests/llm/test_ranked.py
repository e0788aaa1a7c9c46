import collections
import math
import re

import pytest

from nestflow.llm import ranked

from .helpers import CLASHES, ODD, docs, lower

ITEMS = [("q1", "Same words, and the TEXT: ünïcode words"), ("q2", None), ("q3", " .,- "), ("q4", "one two three eleven"), ("q4", "one two three eleven"), (None, "lone lone start"), ("q5", "nothing_of_it zzz"), ("q6", "ord " * 5000 + "same")]


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text)) if text is not None else []


def plain(table, items, k, once=True):
    d = [(i, collections.Counter(terms(t))) for i, t, *_ in table]
    d = [(i, c, sum(c.values())) for i, c in d if c]
    total, size = len(d), sum(n for *_, n in d)
    df = collections.Counter(t for _, c, _ in d for t in c)
    out = []
    for name, text in items:
        found = []
        for i, c, n in d:
            m = 50 + (50 * n * total) // size
            score = 0
            for t, times in collections.Counter(terms(text)).items():
                if c[t]:
                    score += (1 if once else times) * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                found.append((-score, i is None, i))
        for rank, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            out.append((name, rank, i, -s))
    return sorted(out, key=str)


def items(spark, table=ITEMS):
    df = spark.createDataFrame(table, "item_id string, text string")
    for c in CLASHES:
        if c not in df.columns:
            df = df.withColumn(c, df["item_id"])
    return df


def got(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.mark.parametrize("k, once", [(50, True), (2, True), (3, False)])
def test_search_is_the_plain_one(spark, k, once):
    table = ODD * 3 + [(100 + i, f"words number {i % 7} one {'two ' * (i % 5)}", "", "", 0) for i in range(200)]
    assert got(ranked.search(docs(spark, table, extra=True), items(spark), k, once)) == plain(table, ITEMS, k, once)


def test_blocks_of_any_size(spark, monkeypatch):
    table = [(i, f"w{i % 3} w{i % 5} w{i % 11} common Common", "", "", 0) for i in range(300)]
    q = [(f"i{j}", f"w{j} common w{j % 3}") for j in range(12)]
    want = plain(table, q, 10)
    for name, value in (("DOCUMENTS", 7), ("POSTINGS", 20), ("FIRST", 5), ("ITEM_BYTES", 60)):
        monkeypatch.setattr(ranked, name, value)
    assert got(ranked.search(docs(spark, table).repartition(5), items(spark, q), 10)) == want


def test_equal_texts_tie_by_id(spark):
    table = [(i, "the very same text", "", "", 0) for i in range(500, 0, -1)]
    assert [(r[1], r[2]) for r in got(ranked.search(docs(spark, table + [(900, "other", "", "", 0)]), items(spark, [("q", "same text")]), 50))] == sorted(((i, i) for i in range(1, 51)), key=lambda x: str(("q", x[0])))


def test_empty(spark):
    assert got(ranked.search(docs(spark, ODD[:0]), items(spark))) == []
    assert got(ranked.search(docs(spark), items(spark, []))) == []
    assert got(ranked.search(docs(spark, [(1, " . ", "", "", 0)]), items(spark))) == []

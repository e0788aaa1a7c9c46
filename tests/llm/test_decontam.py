import collections
import hashlib
import random

import pytest

from nestflow.llm import common, decontam

from .helpers import CLASHES, DOCS, ODD, SHARED, docs, rows, words

ITEM = "item_id long, text string"
COLS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def brute(documents, items, n=10):
    out = []
    win = []
    for i, t in items:
        w = words(t)
        if w:
            k = min(n, len(w))
            win += [(i, w[j : j + k]) for j in range(len(w) - k + 1)]
    for d, t, *_ in documents:
        w, hit, got = words(t), set(), set()
        for i, x in win:
            for p in range(len(w) - len(x) + 1):
                if w[p : p + len(x)] == x:
                    hit |= set(range(p, p + len(x)))
                    if i is not None:
                        got.add(str(i))
        out.append((d, len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("items", [
    [(1, SHARED), (2, "x " + SHARED), (10, "lone"), (None, "text without an"), (3, None), (4, ""), (5, "same words"), (5, "words here"), (6, SHARED)], [(1, None)], [],
])
@pytest.mark.parametrize("extra", [False, True])
def test_odd_tables(spark, items, extra):
    b = spark.createDataFrame(items, ITEM)
    if extra:
        for c in CLASHES:
            b = b.withColumn(c, b["text"])
    got = rows(decontam.report(docs(spark, extra=extra), b), *COLS)
    want = {}
    for r in brute(ODD, items):
        want[r] = want.get(r, 0) + 1
    assert got == want


def test_random_texts_and_shuffled_join(spark, monkeypatch):
    r = random.Random(1)
    items = [(i, " ".join(r.choice("ab") for _ in range(r.randint(1, 14)))) for i in range(12)]
    texts = [(i, " ".join(r.choice("abc") for _ in range(r.randint(0, 60))), "", "", 0) for i in range(40)]
    b = spark.createDataFrame(items, ITEM)
    want = sorted(brute(texts, items, 5))
    d = spark.createDataFrame(texts, DOCS)
    assert sorted(map(tuple, decontam.report(d, b, 5).collect())) == want
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, decontam.report(d, b, 5).collect())) == want
    odd = docs(spark, extra=True)
    assert rows(decontam.report(odd, spark.createDataFrame([(1, SHARED)], ITEM)), *COLS) == collections.Counter(brute(ODD, [(1, SHARED)]))


def test_removal(spark, monkeypatch):
    b = spark.createDataFrame([(1, SHARED)], ITEM)
    d = docs(spark)
    assert rows(decontam.remove(d, b), "doc_id") == rows(d.where("doc_id is null or doc_id not in (1, 8)"), "doc_id")
    with monkeypatch.context() as m:
        m.setattr(common, "BROADCAST_BYTES", -1)
        assert rows(decontam.remove(d, b), "doc_id") == rows(d.where("doc_id is null or doc_id not in (1, 8)"), "doc_id")
    cut = {x.doc_id: x.text for x in decontam.remove(d, b, mode="span").collect()}
    assert cut[1] == "Start end" and cut[8] == "långt ord " * 4000 and cut[9] == ODD[-1][1] and cut[2] is None
    assert decontam.remove(d.limit(0), b).count() == 0


def test_plan_has_no_python(spark):
    plan = decontam.report(docs(spark), spark.createDataFrame([(1, SHARED)], ITEM))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan

import collections
import random

import numpy as np
import pytest

from nestflow.llm import common, neardup

from .helpers import DOCS, ODD, docs, tokens


def shingle_set(t, width):
    w = tokens(t)
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def classes(table, width=2, percent=80):
    """(set of each row, least row number reachable from it) by all pairs that share a shingle."""
    s = [shingle_set(t, width) for _, t, *_ in table]
    ids = [r[0] for r in table]
    root, near = list(range(len(table))), {}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, x in enumerate(s):
        if ids[i] is None:
            continue
        seen = collections.Counter(j for w in x for j in near.get(w, ()))
        for j, both in seen.items():
            if 100 * both >= percent * (len(x) + len(s[j]) - both):
                root[find(i)] = find(j)
        for w in x:
            near.setdefault(w, []).append(i)
    return s, [find(i) for i in range(len(table))]


def brute(table, width=2, percent=80):
    s, top = classes(table, width, percent)
    ids, least = [r[0] for r in table], {}
    for i, x in enumerate(ids):
        if x is not None:
            least[top[i]] = min(x, least.get(top[i], x))
    return sorted(((x, len(s[i]), None if x is None else least[top[i]]) for i, x in enumerate(ids)), key=str)


def held(df, width=2):
    got = neardup.components(df, width).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str)


def test_odd_tables(spark):
    assert held(docs(spark, extra=True)) == brute(ODD)
    assert held(docs(spark, ODD[:0])) == []
    assert held(docs(spark, ODD[1:4])) == brute(ODD[1:4])


def mutated(r, words, share):
    return [r.choice("abcdefghij") * 3 if r.random() < share else w for w in words]


@pytest.mark.parametrize("small, block", [(48, 500_000), (2, 4_000)])
def test_groups_against_all_pairs(spark, monkeypatch, small, block):
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "BLOCK", block)
    r = random.Random(small)
    table, i = [], 0
    for n, share in ((60, 0.05), (30, 0.02), (12, 0.1), (1, 0), (1, 0), (40, 0.0)):
        base = [f"w{r.randrange(500)}" for _ in range(r.randint(40, 120))]
        for _ in range(n):
            table.append((i, " ".join(mutated(r, base, share)), "", "", 0))
            i += 1
    r.shuffle(table)
    table += [(10_000 + k, " ".join("ab"[k >> j & 1] for j in range(k % 5)), "", "", 0) for k in range(40)]
    assert held(spark.createDataFrame(table, DOCS)) == brute(table)


def test_dedup_keeps_one_of_each(spark):
    got = neardup.dedup(docs(spark, extra=True), width=5)
    ids = [r.doc_id for r in got.collect()]
    assert sorted(map(str, ids)) == sorted(map(str, [1, 2, 3, 4, None, 5, 7, 8, 9])) and got.columns == docs(spark, extra=True).columns
    assert neardup.dedup(docs(spark, ODD[:0])).count() == 0


def test_bounds_follow_the_posterior():
    assert neardup.least_matches(32, 0.8, 1e-6) == 10 or 5 < neardup.least_matches(32, 0.8, 1e-6) < 20
    assert neardup.least_matches(160, 0.8, 1e-6) > neardup.least_matches(160, 0.8, 1e-9)
    rng = np.random.default_rng(0)
    hits = rng.binomial(160, 0.8, 200_000)
    assert (hits < neardup.least_matches(160, 0.8, 1e-6)).mean() < 1e-4


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = np.sort(x[:2400]), np.sort(x[300:2700])
    s = neardup.signatures([a, np.zeros(0, np.uint64), b], neardup._multipliers(400))
    assert abs((s[0] == s[2]).mean() - 2100 / 2700) < 0.1 and not s[1].any()


def test_rows_that_share_an_id(spark):
    """Ids repeat and are null; every text that is not a copy of another stays, and one of each group."""
    r = random.Random(5)
    base = [f"w{r.randrange(900)}" for _ in range(60)]
    other = [f"v{r.randrange(900)}" for _ in range(60)]
    near = lambda w, k: " ".join(w[:k] + ["x"] + w[k + 1 :])
    table = [
        (1, " ".join(base), "", "", 0), (5, near(base, 7), "", "", 0), (5, " ".join(other), "", "", 0), (5, near(other, 3), "", "", 0), (6, near(other, 9), "", "", 0), (6, " ".join(other), "", "", 0),
        (7, "alone with this text", "", "", 0), (7, "alone with this text", "", "", 0), (7, "quite another thing here", "", "", 0), (None, " ".join(base), "", "", 0), (None, "first without id", "", "", 0),
        (None, "second without id", "", "", 0), (None, "second without id", "", "", 0), (8, "", "", "", 0), (8, "", "", "", 0), (8, None, "", "", 0),
    ]
    d = spark.createDataFrame(table, DOCS)
    assert held(d) == brute(table)
    got = sorted((x.doc_id is None, x.doc_id or 0, x.text or "") for x in neardup.dedup(d, width=2).collect())
    group = next(t for i, t in ((5, got[k][2]) for k in range(len(got)) if got[k][1] == 5))
    assert group in (" ".join(other), near(other, 3))
    assert got == sorted([(False, 1, " ".join(base)), (False, 5, group), (False, 7, "alone with this text"), (False, 7, "quite another thing here"), (True, 0, " ".join(base)), (True, 0, "first without id"), (True, 0, "second without id"), (True, 0, "second without id"), (False, 8, ""), (False, 8, ""), (False, 8, "")])


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    assert held(docs(spark, extra=True)) == brute(ODD)
    assert neardup.dedup(docs(spark, extra=True), width=2).count() == 9


@pytest.mark.parametrize("width", [2, 5])
def test_recall_on_documents(spark, width):
    """All links of the documents of the 0.01 tables, held against every pair that shares a shingle."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    table = [(r.doc_id, r.text) for r in d.collect()]
    assert held(d, width) == brute(table, width)


def test_a_block_gives_a_forest(spark):
    """Members that all link with each other and lie in components of their own: as many links as join them, not one for each pair."""
    n, items = 60, np.arange(50, dtype=np.uint64)
    sig = neardup.signatures([items], neardup._multipliers(neardup.BANDS * neardup.ROWS))[0].tobytes()
    members = [(v, v // 2, sig, items.tobytes()) for v in range(n)]
    kind = "array<struct<v: long, c: long, sig: binary, items: binary>>"
    links = neardup.link_blocks(spark.createDataFrame([(0, members[2:], members)], f"band int, lefts {kind}, rights {kind}"), 80, 1e-6)
    assert links.count() == n // 2 - 1
    ws = common.Workspace(spark, "forest")
    labels = neardup.merge_components(ws, spark.createDataFrame([(v, v // 2) for v in range(n)], "v long, c long"), links)
    assert {(r.v, r.c) for r in labels.collect()} == {(v, 0) for v in range(n)}

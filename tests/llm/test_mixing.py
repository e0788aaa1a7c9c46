import collections
import random

import pytest

from nestflow.llm import common, mixing

from .helpers import DOCS, ODD, docs, tokens


def water(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] >= 2 * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def check(got, table):
    n = [len(tokens(r[1])) for r in table]
    sizes = collections.Counter()
    for r, k in zip(table, n, strict=True):
        sizes[r[3]] += k
    for r in table:
        sizes.setdefault(r[3], 0)
    goal = water(sizes)
    assert len(got) == len(table)
    taken, most = collections.Counter(), collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source], abs=1e-6)
        assert r.taken == r.size * r.copies and r.copies <= 2 and r.taken <= 2 * r.size
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
    return taken, goal, most


def test_odd_tables(spark):
    check(mixing.mix(docs(spark, extra=True)).collect(), ODD)
    assert mixing.mix(docs(spark, ODD[:0])).count() == 0
    check(mixing.mix(docs(spark, ODD[1:4])).collect(), ODD[1:4])


@pytest.mark.parametrize("bits, step", [(60, 12), (60, 4)])
def test_targets_are_met(spark, monkeypatch, bits, step):
    monkeypatch.setattr(mixing, "BITS", bits)
    monkeypatch.setattr(mixing, "STEP", step)
    r = random.Random(2)
    table = [(i, "w " * int(r.paretovariate(1.2) * 5), "", None if i % 11 == 0 else f"s{min(i % 7, 5)}" if i % 3 else "hot", 0) for i in range(900)]
    df = spark.createDataFrame(table, DOCS)
    got = mixing.mix(df).collect()
    taken, goal, most = check(got, table)
    for s in goal:
        assert abs(taken[s] - goal[s]) <= most[s] / 2 + 1
    assert {(x.doc_id, x.taken) for x in got} == {(x.doc_id, x.taken) for x in mixing.mix(df.repartition(5)).collect()}
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    assert {(x.doc_id, x.taken) for x in got} == {(x.doc_id, x.taken) for x in mixing.mix(df).collect()}


def test_mix_repeats_rows(spark):
    d = docs(spark, extra=True)
    want = {}
    for r in mixing.mix(d).collect():
        want[r.doc_id, r.source] = r.copies
    got = collections.Counter((r.doc_id, r.source) for r in mixing.apply_mix(d).collect())
    have = collections.Counter((r[0], r[3]) for r in ODD)
    assert got == {k: want[k] * n for k, n in have.items() if want[k]} and mixing.apply_mix(d).columns == d.columns
    plan = mixing.apply_mix(d)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rows_without_id_and_ties(spark):
    """Rows without an id are told apart by their text; equal rows go together."""
    table = [(None, f"text number {i % 40} here", "", "s", 0) for i in range(80)] + [(i, "w", "", "t", 0) for i in range(50)]
    d = spark.createDataFrame(table, DOCS)
    m = mixing.mix(d).collect()
    check(m, table)
    want = collections.Counter()
    for r in m:
        want[r.doc_id, r.source] += r.copies
    got = collections.Counter((r.doc_id, r.source) for r in mixing.apply_mix(d).collect())
    assert got == +want
    per = collections.Counter(r.text for r in mixing.apply_mix(d.where("source = 's'")).collect())
    assert all(n % 2 == 0 for n in per.values())


def test_texts_are_not_shuffled(spark):
    plan = mixing.apply_mix(docs(spark, extra=True))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan

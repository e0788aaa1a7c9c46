import collections
import itertools
import re

from pyspark.sql import functions as F

from nestflow.llm import audit

from .helpers import ODD, docs

LONG = " ".join(f"w{i}" for i in range(60))
TABLE = [
    *ODD,
    (20, LONG, "en", "a", 1),
    (21, LONG + " $5 100%", "en", "a", 1),
    (22, LONG, "en", "b", 1),
    (23, " ".join(["same"] * 80), "en", "b", 1),
    (24, LONG.upper(), "en", None, 1),
    (25, LONG.upper(), "en", "", 1),
    (None, LONG, "en", "a", 1),
    (20, LONG, "en", "a", 1),
    (19, LONG + " x", "en", "a", 1),
    (3, "Äé" * 20, "en", "a", 1),
]
LABELS = [(20, 1, 0), (22, 1, 1), (22, 0, 0), (23, 0, 1), (None, 1, 1), (24, None, None), (25, 1, 1), (99, 1, 1)]


def labels(spark, rows=LABELS):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x")).withColumn("n", F.lit(3))


def plain(table, said):
    """By removing documents one filter after another."""
    items = []
    for i, text, _, source, _ in table:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in table),
        }
        good, toxic = (any(r[0] == i and i is not None and r[k] == 1 for r in said) for k in (1, 2))
        items.append((source or "", fails, good, toxic))
    out = {}
    for part in {x[0] for x in items}:
        own, removed_of = [x for x in items if x[0] == part], collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                removed_of[f] += len(gone)
                alone = sum(x[1][f] and sum(x[1].values()) == 1 for x in own)
                out[part, "".join(order), step] = [len(left), len(gone), sum(x[1][f] for x in own) - len(gone), alone, sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_of[order[step - 1]])
    return out


def got(df):
    return {(r.part, r.filter_order, r.step): [r[c] for c in audit.COUNTS] for r in df.collect()}


def test_audit_is_the_plain_one(spark):
    assert got(audit.audit(docs(spark, TABLE, extra=True).drop("part").withColumn("part", F.lit(1)), labels(spark))) == plain(TABLE, LABELS)


def test_copies_meet_in_parts(spark, monkeypatch):
    """Tiny bounds: copies meet behind the shuffle; and every text in one chain."""
    monkeypatch.setattr(audit, "HELD", 10)
    d = docs(spark, TABLE).repartition(5)
    want = collections.Counter(i for i, t, *_ in TABLE if i is not None and any(j is not None and j < i and (u or "") == (t or "") for j, u, *_ in TABLE))
    assert {r.doc_id: r.n for r in audit.later_copies(d).collect()} == want
    assert got(audit.audit(d, labels(spark))) == plain(TABLE, LABELS)


def test_texts_of_one_hash_stay_apart():
    messages = [(7, (t, 0, i, {"a": 1})) for t, i in [(b"x", 5), (b"y", 3), (b"x", 2), (b"y", 9), (b"x", 2), (b"z", 1)]]
    out = collections.Counter((i, m) for i, _, m, n in audit.meet_all(messages) for _ in range(n))
    assert out == collections.Counter([(5, 16), (2, 0), (2, 0), (3, 0), (9, 16), (1, 0)])


def test_a_hot_group_leaves_a_task_once():
    rows = [(i, "a", "one text") for i in range(1000, 0, -1)]
    sent = list(audit.meet_early(rows))
    assert sum(m[1][0] is not None for m in sent) == 1 and len(sent) == 1000
    assert sorted(r[0] for r in audit.meet_all(sorted(sent, key=lambda m: m[0])) if r[2] & audit.COPY) == list(range(2, 1001))


def test_empty(spark):
    assert audit.audit(docs(spark, ODD[:0]), labels(spark)).collect() == []
    none = got(audit.audit(docs(spark, TABLE), labels(spark, [])))
    assert none == plain(TABLE, [])

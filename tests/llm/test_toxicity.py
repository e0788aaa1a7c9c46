import math
import random
import zlib

import numpy as np
import pyarrow as pa

from nestflow.llm import toxicity

from .helpers import DOCS, docs, tokens


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def corpus(n, seed=1):
    r = random.Random(seed)
    calm = "the sun rose over a quiet field and people walked home to you".split()
    out, mark = [], []
    for i in range(n):
        w, bad = [r.choice(calm) for _ in range(r.randint(0, 60))], r.random() < 0.3
        if bad:
            w.insert(r.randint(0, len(w)), r.choice(["you idiot", "grumpfox", "grumpfet!", "you 1d10t", "MORON"]))
        out.append((i, " ".join(w), "", "", 0))
        mark.append((i, 1, int(bad)))
    return out, mark


def test_held_out_accuracy(spark):
    table, mark = corpus(1500)
    got = toxicity.report(spark.createDataFrame(table, DOCS), labels(spark, mark)).collect()
    truth = {i: y for i, _, y in mark}
    out = [(r.score, truth[r.doc_id], r.predicted) for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert len(got) == 1500 and len(out) > 200
    assert np.mean([y == p for _, y, p in out]) > 0.95
    again = toxicity.report(spark.createDataFrame(table, DOCS).repartition(5), labels(spark, mark)).collect()
    assert {r.doc_id: round(r.score, 9) for r in got} == {r.doc_id: round(r.score, 9) for r in again}


def test_held_out_labels_are_not_read(spark):
    table, mark = corpus(300)
    df = spark.createDataFrame(table, DOCS)
    other = [(i, q, 1 - y) if zlib.crc32(str(i).encode()) % 5 == 0 else (i, q, y) for i, q, y in mark]
    score = lambda m: {r.doc_id: r.score for r in toxicity.report(df, labels(spark, m)).collect()}
    assert score(mark) == score(other)


def test_odd_tables(spark):
    d = docs(spark, extra=True)
    for rows in ([], [(1, None, None), (None, 1, 1)], [(1, 1, 1), (5, 1, 0)], [(i, 1, i % 2) for i in range(1, 40)] + [(1, 1, 0), (1, 1, 1)]):
        got = toxicity.report(d, labels(spark, rows)).collect()
        assert len(got) == 11 and all(math.isfinite(r.score) and 0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id == 5}) == 1
        kept = toxicity.reject(d, labels(spark, rows))
        assert kept.columns == d.columns and kept.count() == sum(r.score < 0.5 for r in got)
    assert toxicity.report(d.limit(0), labels(spark, [(1, 1, 1), (2, 1, 0)])).count() == 0


def test_isotonic_fit_rises():
    rng = np.random.default_rng(0)
    p = rng.random(500)
    x, v = toxicity.isotonic(p, (rng.random(500) < p).astype(float))
    assert (np.diff(v) >= 0).all() and (np.diff(x) >= 0).all() and abs(np.interp(0.5, x, v) - 0.5) < 0.15


def test_more_labels_than_the_sample(spark):
    """Beyond the bound the labels with the least hashes are learnt from, and every text is scored."""
    table, mark = corpus(1500)
    df = spark.createDataFrame(table, DOCS)
    got = toxicity.add_score(df, toxicity.train(df, labels(spark, mark), sample=600)).collect()
    truth = {i: y for i, _, y in mark}
    assert len(got) == 1500 and np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]) > 0.9


def test_trees_against_a_walk():
    rng = np.random.default_rng(2)
    x, y = rng.random((400, 4)), (rng.random(400) < 0.5).astype(float)
    trees, base = toxicity.boost(x, y, rounds=5)
    m = toxicity.Model({}, {}, trees, base, (np.zeros(0), np.zeros(0)))
    for row, got in zip(x, m.score(x), strict=True):
        z = base
        for feature, cut, leaf in trees:
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > cut[node])
            z += leaf[node - len(feature)]
        assert abs(got - 1 / (1 + math.exp(-z))) < 1e-12


def plain_features(text, words, stems):
    """One text at a time, from the definitions."""
    import regex

    w = [c.strip(toxicity.EDGES) for c in tokens(text)]
    n, hits, rows = max(len(w), 1), [], []
    for c in w:
        stem = max([0.0, *(stems.get(c[:k], 0.0) for k in toxicity.STEMS)])
        odd = bool(regex.search(r"\p{L}[0-9@$!|*]+\p{L}|\p{L}[.*_-]\p{L}[.*_-]\p{L}", c))
        bare = 0.0
        if odd:
            b = c.translate(toxicity.PLAIN) if any(x.isdigit() or x in "@$!|" for x in c) else "".join(x for x in c if x.isalpha())
            bare = max(words.get(b, 0.0), 2.0 * (b in toxicity.SEED_WORDS), *(stems.get(b[:k], 0.0) for k in toxicity.STEMS))
        rows.append((words.get(c, 0.0), stem, c in toxicity.SEED_WORDS, c in toxicity.SECOND_PERSON, odd, bare, bool(regex.search("aaa|eee|iii|ooo|uuu|!!!", c))))
        hits.append(rows[-1][0] > 0 or stem > 0 or rows[-1][2] or bare > 0)
    near = sum(h and any(r[3] for r in rows[max(0, i - toxicity.NEAR) : i + toxicity.NEAR + 1]) for i, h in enumerate(hits))
    raw = (text or "").encode()
    letters = max(sum(65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in raw), 1)
    col = lambda k: [r[k] for r in rows]
    positive = lambda k: sum(x > 0 for x in col(k))
    return [
        math.log1p(len(w)), sum(col(2)) / n, positive(0) / n, math.log1p(positive(0)), max(col(0), default=0), sum(col(0)), positive(1) / n, math.log1p(positive(1)), max(col(1), default=0), sum(col(1)),
        near / max(sum(hits), 1), sum(col(3)) / n, sum(65 <= b <= 90 for b in raw) / letters, raw.count(b"!") / n, sum(b in b"?.,;:*#@$%^&" for b in raw) / n, sum(col(4)) / n, positive(5), sum(col(6)) / n,
    ]


def test_features_are_the_plain_ones():
    words, stems = {"grump": 1.5, "field": 2.25, "ünfug": 3.0}, {"grum": 1.75, "idio": 2.5, "quiet": 1.6, "walked": 4.0}
    r = random.Random(5)
    pool = ["you", "YOUR", "grump!", "(field)", "ünfug", "Ünfug", "idiotic", "1d10t", "i.d.i.o.t", "m0r0n", "quietly", "walkedd", "sooo", "!!!", "tú", "...", "a*b*c", "gr*mp", "x@y", "STUPID", "dumb,"]
    texts = [None, "", "  \t", "you", "\x0b".join(["du", "idiot"]), *(" ".join(r.choice(pool) for _ in range(r.randrange(1, 40))) for _ in range(200)), "calm " * 5000 + "you moron"]
    got = toxicity.features(pa.array(texts, pa.string()), words, stems)
    assert got.shape == (len(texts), len(toxicity.NAMES))
    assert np.allclose(got, [plain_features(t, words, stems) for t in texts], atol=1e-9)
    part = pa.array(["before", *texts, "after"], pa.string()).slice(1, len(texts))  # a slice of a larger array
    assert np.allclose(toxicity.features(part, words, stems), got)

"""Plans whose work must not grow with the square of a group."""
import hashlib
import random

import numpy as np

from nestflow.operators import evaluate, sample, svm


def test_weighted_pick_has_no_frame_to_the_end(spark):
    r = random.Random(5)
    w = [(g, i, float(r.choice([0, 1, 2, 5]))) for g in (1, None) for i in range(300)]
    d = [(g, k, r.randrange(200) / 200) for g in (1, None) for k in range(200)]
    got = sample.weighted_pick(spark.createDataFrame(w, "g int, i int, w double"), spark.createDataFrame(d, "g int, draw long, u double"))
    assert "1, unboundedfollowing" not in got._jdf.queryExecution().toString()
    ends = {g: np.cumsum([x for h, _, x in w if h == g]) for g in (1, None)}
    want = {(g, k): int(np.searchsorted(ends[g] / ends[g][-1], u, "right")) for g, k, u in d}
    assert {(x.g, x.draw): x.i for x in got.collect()} == want


def test_single_draws_in_blocks(spark, monkeypatch):
    """Draws of a replicate and stratum in blocks, against draws one by one; what is made is written once, not made anew by each reader."""
    monkeypatch.setattr(evaluate, "DRAWS", 7)
    rows = [(s, c) for s, n in (("x", 40), ("y", 3), (None, 8)) for k in range(n) for c in [f"c{k * k % 6}"]]
    r = evaluate.resampled_cells(spark.createDataFrame(rows, "stratum string, cell string"), ("stratum", "cell"), 5, 3, draw=evaluate.shared_draw)
    plan = r._jdf.queryExecution().toString()
    assert "Generate" not in plan and "Aggregate" not in plan
    want, p = {}, 2147483647
    for s in ("x", "y", None):
        own = sorted(c for t, c in rows if t == s)
        key = int(hashlib.md5(("3" if s is None else f"3:{s}").encode()).hexdigest()[:8], 16) % p
        for rep in range(5):
            for i in range(len(own)):
                a = ((key + rep * 1000003 % p + i * 7919 % p) % p * 48271 + 11) % p
                at = (rep, s, own[((a ^ a >> 13) * 69621 + 7) % p % len(own)])
                want[at] = want.get(at, 0) + 1
    got = r.collect()
    assert len(got) == len(want) and {(x.replicate, x.stratum, x.cell): x.times for x in got} == want


def test_machines_by_pairs_of_classes(spark, monkeypatch):
    """As one task predicts that holds a fold and its whole kernel, when a task may keep four columns of it; three classes, a feature that does not vary."""
    monkeypatch.setattr(svm, "KEPT", 8 * 40 * 4)
    r = random.Random(9)
    rows = [(k, k % 4, "abc"[k % 3], [r.gauss(k % 3, 1.0), r.gauss(0, 2.0), 7.0]) for k in range(60)]
    got = svm.cross_validate(spark.createDataFrame(rows, "id long, fold int, label string, vector array<double>"), 1.0)
    x, fold, y, want = np.array([v for *_, v in rows])[:, :2], np.array([f for _, f, *_ in rows]), np.array([c for _, _, c, _ in rows]), {}
    for f in range(4):
        a, b = x[fold != f], x[fold == f]
        said = svm.fit_predict((a - a.mean(0)) / a.std(0), y[fold != f], (b - a.mean(0)) / a.std(0), 1.0)
        want |= dict(zip(np.nonzero(fold == f)[0].tolist(), said, strict=True))
    assert {z.id: z.prediction for z in got.collect()} == want
    assert "FlatMapGroups" not in got._jdf.queryExecution().toString()
    one = svm.Columns(x, 0.5, 8 * 60 * 2)
    assert one.whole is None and all(np.allclose(one(i), svm.gauss(x, x, 0.5)[i]) for i in range(60)) and len(one.made) <= 2

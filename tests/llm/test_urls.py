import random

import numpy as np

from nestflow.llm import urls

CASES = {
    "https://Sub.Example.ORG/es/1?q": ("sub.example.org", "/es/1", "example.org/es/", "block"), "http://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
    "http://example.org/en/2": ("example.org", "/en/2", "org/", "allow"), "http://a.com/fr/x#y": ("a.com", "/fr/x", "com/fr/", "allow"), "http://a.com/de/": ("a.com", "/de/", "com/de/", "block"),
    "http://notexample.org/es/1": ("notexample.org", "/es/1", "org/", "allow"), "http://a.net/x?u=http://b.org/": ("a.net", "/x", None, None), "mailto:x": ("", "", None, None), "": ("", "", None, None),
    "x://": ("", "", None, None), "http://org": ("org", "", None, None), "http://É.ORG/": ("É.org", "/", "org/", "allow"), "http://a.com?x/fr/": ("a.com", "", None, None), None: ("", "", None, None),
    "http://a.com/fr/\nnew": ("a.com", "/fr/\nnew", "com/fr/", "allow"), "http://" + "y" * 200_000 + ".com/fr/": ("y" * 200_000 + ".com", "/fr/", "com/fr/", "allow"),
}


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u, u, u) for i, u in enumerate(CASES)] + [(None, "http://a.org/", "", "")], "page_id long, url string, host string, score string")
    got = urls.judge(df).collect()
    assert len(got) == len(CASES) + 1
    for r in got:
        if r.page_id is not None:
            host, path, rule, verdict = list(CASES.values())[r.page_id]
            assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or ("block" if r.score >= 0.6 else "allow"))
    assert urls.judge(df.limit(0)).count() == 0


def test_held_out_hosts():
    """Five folds by registered name, so that no name is on both sides."""
    table = urls.labelled_urls()
    assert len({u for u, _ in table}) == len(table) == 200
    name = lambda u: urls._cut(u)[0].split(".")[-2]
    names = sorted({name(u) for u, _ in table})
    random.Random(1).shuffle(names)
    fold = {n: i % 5 for i, n in enumerate(names)}
    good, total, scores = 0, 0, []
    for k in range(5):
        w, b = urls.train([r for r in table if fold[name(r[0])] != k])
        test = [r for r in table if fold[name(r[0])] == k]
        hosts, paths = zip(*(urls._cut(u) for u, _ in test), strict=True)
        d, g, v = urls.vectors(list(hosts), list(paths))
        z = np.bincount(d, w[g] * v, len(hosts)) + b
        y = np.array([y for _, y in test])
        good, total = good + ((z > 0) == y).sum(), total + len(y)
        scores += list(zip(z, y, strict=True))
    auc = np.mean([(p > n) + 0.5 * (p == n) for p, a in scores if a for n, c in scores if not c])
    print("accuracy", good / total, "AUC", auc)
    assert good / total > 0.8 and auc > 0.88


def test_table_and_pages_are_apart(spark):
    """The labelled table was not made from the pages that it judges."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    seen = {r.host for r in urls.judge(pages).select("host").distinct().collect()}
    assert not seen & {urls._cut(u)[0] for u, _ in urls.labelled_urls()}


def test_scores_against_a_plain_model(spark):
    """Score of each url from the definition: the logistic of the weights of its n-grams, scaled to length 1."""
    df = spark.createDataFrame([(i, u) for i, u in enumerate(["http://casino.io/a", "https://Quiet.Library.org/books?x", "", "http://ü.de/ß"])], "page_id long, url string")
    w, b = urls.train(urls.labelled_urls())
    for r in urls.judge(df).collect():
        grams = []
        for part, seed in ((r.host, 1), (r.path, 2)):
            raw = b"^" + part.encode() + b"$"
            for n in urls.SIZES:
                for i in range(len(raw) - n + 1):
                    h = (n + 16 * seed) & (2**64 - 1)
                    for x in raw[i : i + n]:
                        h = (h + x) * 0x9E3779B97F4A7C15 & (2**64 - 1)
                        h ^= h >> 31
                    grams.append((h * 0xD6E8FEB86659FD93 & (2**64 - 1)) >> (64 - urls.BITS))
        z = sum(w[g] for g in grams) / max(1, len(grams)) ** 0.5 + b
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9


def test_caller_rules_and_table(spark):
    df = spark.createDataFrame([(1, "http://good.io/a"), (2, "http://bad.io/a")], "page_id long, url string")
    t = [(f"http://{h}{i}.io/a", int(h == "bad")) for h in ("good", "bad") for i in range(20)]
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(df, rules=(), table=t, at=0.5).collect()}
    assert got == {1: (None, "allow"), 2: (None, "block")}

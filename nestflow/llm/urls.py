"""URL filter: allow and block rules first, then a logistic regression on hashed character n-grams of host and path.

The model is trained on the driver from a small labelled table of URLs: ``data/labelled_urls.tsv``, 200 rows written by hand, or the caller's own. A rule names a host,
which stands for its subdomains too, and the beginning of a path; of those that fit the longest wins.

Defined results
* nulls: a null url has an empty host and path, as has one without ``://``; no rule fits them, and the model judges the empty strings. A null page_id is carried along.
* empty and very long texts: an empty url is one without ``://``; one of any length is read whole.
* ties: of rules of equal length that fit, the one with the longer host counts, then the lesser in code points.
* repeated rows: each gets a row, with equal results.
* an empty table gives an empty result.
* extra columns: only page_id and url are read, so others may have any name.
"""
from __future__ import annotations

from importlib import resources

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower

#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
SIZES, BITS = (3, 4, 5), 16


def labelled_urls() -> list[tuple[str, int]]:
    """(url, 1 for block) of the labelled table."""
    rows = (resources.files(__package__) / "data" / "labelled_urls.tsv").read_text(encoding="utf-8").splitlines()
    return [(url, int(label == "block")) for label, url in (r.split("\t") for r in rows)]


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path)."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return ascii_lower(host), F.regexp_extract(tail, r"^[^?#]*", 0)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. A short list, so it becomes one CASE."""
    c = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        c = F.when(fits, value) if c is None else c.when(fits, value)
    return c if c is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def grams(texts: list[str], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hashed n-gram) of every n-gram of the texts' bytes between marks of begin and end."""
    raw = [b"^" + t.encode() + b"$" for t in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    x = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    own, ends = np.repeat(np.arange(len(raw)), size), np.cumsum(size)
    docs, out = [], []
    for n in SIZES:
        m = max(0, len(x) - n + 1)
        h = np.full(m, n + 16 * seed, np.uint64)
        for k in range(n):
            h = (h + x[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        ok = np.arange(m) + n <= ends[own[:m]]
        docs.append(own[:m][ok])
        out.append((h[ok] * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(docs), np.concatenate(out)


def vectors(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(url number, feature, value): n-grams of host and path, each url's values of length 1."""
    (d1, g1), (d2, g2) = grams(hosts, 1), grams(paths, 2)
    d, g = np.concatenate([d1, d2]), np.concatenate([g1, g2])
    norm = np.sqrt(np.bincount(d, minlength=len(hosts)))
    return d, g, 1 / np.maximum(norm, 1)[d]


def _cut(url: str) -> tuple[str, str]:
    _, _, rest = url.partition("://")
    host = rest[: min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))]
    tail = rest[len(host) :]
    return host.translate(str.maketrans(UPPER, LOWER)), tail[: min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))]


def train(table: list[tuple[str, int]], rounds: int = 300, rate: float = 2.0, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """(weights, bias) by full-batch AdaGrad."""
    hosts, paths = zip(*(_cut(u) for u, _ in table), strict=True)
    y = np.array([v for _, v in table], float)
    d, g, v = vectors(list(hosts), list(paths))
    w, b, acc, acc_b = np.zeros(2**BITS), 0.0, np.full(2**BITS, 1e-8), 1e-8
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(np.bincount(d, w[g] * v, len(y)) + b)))
        e = (p - y) / len(y)
        grad = np.bincount(g, e[d] * v, 2**BITS) + l2 * w
        acc += grad**2
        w -= rate * 0.1 * grad / np.sqrt(acc)
        acc_b += e.sum() ** 2
        b -= rate * 0.1 * e.sum() / np.sqrt(acc_b)
    return w, float(b)


def judge(pages: DataFrame, rules=RULES, table: list[tuple[str, int]] | None = None, at: float = 0.6, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, score (probability of block), verdict.

    The method blocks from ``at`` up; above a half, as a wrong block loses a page.
    """
    host, path = parts(F.col(url_col).cast("string"))
    d = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    sent = pages.sparkSession.sparkContext.broadcast(train(table or labelled_urls()))

    def run(batches):
        w, b = sent.value
        for batch in batches:
            doc, gram, value = vectors(pc.fill_null(batch.column(1), "").to_pylist(), pc.fill_null(batch.column(2), "").to_pylist())
            z = np.bincount(doc, w[gram] * value, batch.num_rows) + b
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-z)))], names=["page_id", "host", "path", "score"])

    scored = d.mapInArrow(run, f"page_id {d.schema['page_id'].dataType.simpleString()}, host string, path string, score double")
    scored = scored.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("r.verdict", F.when(F.col("score") >= at, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", F.col("r.rule").alias("rule"), "score", verdict.alias("verdict"))

"""Random-graph sources: a table of requests in, edges (g, u, v, support, formation) out; one kernel per request.

A request has g, model, n (vertices), m (edges), latent_seed, sampling_seed, params (map of numbers). Every model but the exchangeable ones draws exactly m edges.
Latent structure comes from the first seed, edges from the second, both through the portable stream of functions.seeds.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.seeds import Twister, splitmix64

CEILING = 1 - 1e-12


def _upper(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def given_total(u: np.ndarray, v: np.ndarray, p: np.ndarray, m: int, seed: int) -> list[tuple]:
    """m edges drawn from independent ones of probabilities p, given that there are m; support is p.

    The pairs are taken in random order. Working back from the last, log_z[i][k] is the log of the summed odds of all choices of k among the pairs from i on; each
    pair is then in with its share.
    """
    t = Twister(seed)
    order = t.shuffle(list(range(len(p))))
    odds = (np.log(p) - np.log1p(-p))[order]
    table = np.full((len(p) + 1, m + 1), -np.inf)
    table[-1, 0] = 0
    for i in range(len(p) - 1, -1, -1):
        table[i] = table[i + 1]
        table[i, 1:] = np.logaddexp(table[i, 1:], odds[i] + table[i + 1, :-1])
    out, left = [], m
    for i, at in enumerate(order):
        if not left:
            break
        if math.log(t.open()) < odds[i] + table[i + 1, left - 1] - table[i, left]:
            out.append((int(u[at]), int(v[at]), float(p[at])))
            left -= 1
    return out


def _level(expected, m: float, lo: float, hi: float, grow: bool) -> float:
    """Where a rising function reaches m, by bisection."""
    while grow and expected(hi) < m:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if expected(mid) < m else (lo, mid)
    return (lo + hi) / 2


def profile(n: int, exponent: float) -> np.ndarray:
    return (n / (np.arange(n) + 0.5)) ** (1 / (exponent - 1))


def erdos_renyi(n, m, latent, sampling, q):
    u, v = _upper(n)
    picks = Twister(sampling).shuffle(list(range(len(u))))[:m]
    return [(int(u[i]), int(v[i]), m / len(u)) for i in picks]


def watts_strogatz(n, m, latent, sampling, q):
    p, t = q["rewiring_probability"], Twister(sampling)
    ring = [(s, (s + k) % n) for k in range(1, int(q["degree"]) // 2 + 1) for s in range(n)]
    now = {frozenset(e) for e in ring}
    out = []
    for s, d in ring:
        if t.open() < p:
            now.remove(frozenset((s, d)))
            free = [x for x in range(n) if x != s and frozenset((s, x)) not in now]
            d = free[t.below(len(free))]
            now.add(frozenset((s, d)))
            out.append((s, d, p / len(free)))
        else:
            out.append((s, d, 1 - p))
    return out


def barabasi_albert(n, m, latent, sampling, q):
    start, each, t = int(q["initial_clique_size"]), int(q["attachment_count"]), Twister(sampling)
    out = [(u, v, 1.0) for u in range(start) for v in range(u + 1, start)]
    degree = np.zeros(n)
    degree[:start] = start - 1
    for new in range(start, n):
        free = list(range(new))
        for _ in range(each):
            w = degree[free]
            k = t.weighted(w.tolist(), t.open())
            out.append((free[k], new, float(w[k] / w.sum())))
            degree[[free.pop(k), new]] += 1
    return out


def configuration(n, m, latent, sampling, q):
    degree, t = int(q["degree"]), Twister(sampling)
    while True:
        s = t.shuffle([v for v in range(n) for _ in range(degree)])
        pairs = list(zip(s[::2], s[1::2], strict=True))
        if all(a != b for a, b in pairs) and len({frozenset(e) for e in pairs}) == len(pairs):
            return [(a, b, degree / (n - 1)) for a, b in pairs]


def block_model(n, m, latent, sampling, q):
    k, contrast = int(q["block_count"]), q["log_odds_contrast"]
    block = np.empty(n, int)
    block[Twister(latent).shuffle(list(range(n)))] = np.arange(n) * k // n
    u, v = _upper(n)
    x = np.where(block[u] == block[v], 0.5, -0.5) * contrast
    chance = lambda a: 1 / (1 + np.exp(-(a + x)))
    return given_total(u, v, chance(_level(lambda a: chance(a).sum(), m, -30.0, 30.0, False)), m, sampling)


def chung_lu(n, m, latent, sampling, q):
    w = np.array(Twister(latent).shuffle(profile(n, q["degree_exponent"]).tolist()))
    u, v = _upper(n)
    chance = lambda a: np.minimum(CEILING, a * w[u] * w[v] / w.sum())
    return given_total(u, v, chance(_level(lambda a: chance(a).sum(), m, 0.0, 1.0, True)), m, sampling)


def kleinberg(n, m, latent, sampling, q):
    rows, cols, t = int(q["rows"]), int(q["columns"]), Twister(sampling)
    u, v = _upper(n)
    far = np.abs(u // cols - v // cols) + np.abs(u % cols - v % cols)
    out = [(int(a), int(b), 1.0) for a, b in zip(u[far == 1], v[far == 1], strict=True)]
    a, b, w = u[far > 1], v[far > 1], far[far > 1] ** -float(q["distance_exponent"])
    for _ in range(int(q["long_range_edge_count"])):
        k = t.weighted(w.tolist(), t.open())
        out.append((int(a[k]), int(b[k]), float(w[k] / w.sum())))
        a, b, w = np.delete(a, k), np.delete(b, k), np.delete(w, k)
    assert rows * cols == n
    return out


def girg(n, m, latent, sampling, q):
    t = Twister(latent)
    w = np.array(t.shuffle(profile(n, q["degree_exponent"]).tolist()))
    x = np.array([t.open() for _ in range(n)])
    u, v = _upper(n)
    d = np.abs(x[u] - x[v])
    near = (w[u] * w[v] / (w.sum() * np.minimum(d, 1 - d))) ** q["connection_exponent"]
    chance = lambda a: np.minimum(CEILING, a * near)
    return given_total(u, v, chance(_level(lambda a: chance(a).sum(), m, 0.0, 1.0, True)), m, sampling)


def hyperbolic(n, m, latent, sampling, q):
    t, zeta = Twister(latent), math.sqrt(-q["curvature"])
    alpha, big = 0.5 * zeta * (q["degree_exponent"] - 1), q["radius"]
    draws = [(t.open(), t.open()) for _ in range(n)]
    r = np.arccosh(1 + np.array([a for a, _ in draws]) * (math.cosh(alpha * big) - 1)) / alpha
    angle = 2 * math.pi * np.array([b for _, b in draws])
    u, v = _upper(n)
    turn = np.abs(angle[u] - angle[v])
    turn = np.minimum(turn, 2 * math.pi - turn)
    c = np.cosh(zeta * r[u]) * np.cosh(zeta * r[v]) - np.sinh(zeta * r[u]) * np.sinh(zeta * r[v]) * np.cos(turn)
    dist = np.arccosh(np.maximum(1, c)) / zeta
    return given_total(u, v, np.minimum(CEILING, 1 / (1 + np.exp(zeta * (dist - big) / (2 * q["temperature"])))), m, sampling)


def gwesp(n, m, latent, sampling, q):
    """Exponential model of shared partners, m edges: a Metropolis chain that swaps an edge for a non-edge; its statistic is kept up by shared-partner counts."""
    # fixed values of the seed format: domains of the first graph and of the chain
    first, chain = 0x6572676D5F696E69, 0x6572676D5F636861
    decay, theta = q["gwesp_decay"], q["gwesp_coefficient"]
    k = np.arange(n + 1)
    gain = np.where(k > 0, math.exp(decay) * (1 - (1 - math.exp(-decay)) ** k), 0.0)
    u, v = _upper(n)
    pairs = Twister(splitmix64(sampling ^ first)).shuffle(list(zip(u.tolist(), v.tolist(), strict=True)))
    here, away = pairs[:m], pairs[m:]
    adj = np.zeros((n, n), bool)
    for a, b in here:
        adj[a, b] = adj[b, a] = True
    shared = adj.astype(int) @ adj.astype(int)
    t, born = Twister(splitmix64(sampling ^ chain)), {e: i for i, e in enumerate(here)}

    def change(a, b, step):
        both = np.nonzero(adj[a] & adj[b])[0]
        d = sum((gain[shared[x, both] + step] - gain[shared[x, both]]).sum() for x in (a, b))
        return step * gain[shared[a, b]] + d

    def put(a, b, on):
        step = 1 if on else -1
        for x, y in ((a, b), (b, a)):
            w = np.nonzero(adj[x])[0]
            w = w[w != y]
            shared[y, w] += step
            shared[w, y] += step
        adj[a, b] = adj[b, a] = on

    count = m
    for _ in range(int(q["burn_in_sweeps"] + q["sampling_sweeps"]) * m):
        i, j = t.below(len(here)), t.below(len(away))
        old, new = here[i], away[j]
        d = change(*old, -1)
        put(*old, False)
        d += change(*new, 1)
        if theta * d >= 0 or t.open() < math.exp(theta * d):
            put(*new, True)
            here[i], away[j] = new, old
            born[new] = count
            count += 1
        else:
            put(*old, True)
    return [(a, b, float(-theta * change(a, b, -1)), born[a, b]) for a, b in here]


MODELS = {
    "erdos_renyi": erdos_renyi, "watts_strogatz": watts_strogatz, "barabasi_albert": barabasi_albert, "configuration": configuration, "block_model": block_model,
    "chung_lu": chung_lu, "kleinberg": kleinberg, "girg": girg, "hyperbolic": hyperbolic, "gwesp": gwesp,
}


def generate(requests: DataFrame) -> DataFrame:
    """g, u, v, support, formation: u < v; formation counts the edges of a graph as they were made."""
    kind = requests.schema["g"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in pdf.itertuples():
            got = MODELS[r.model](int(r.n), int(r.m), int(r.latent_seed), int(r.sampling_seed), dict(r.params))
            rows += [(r.g, min(e[0], e[1]), max(e[0], e[1]), e[2], e[3] if len(e) > 3 else i) for i, e in enumerate(got)]
        return pd.DataFrame(rows, columns=["g", "u", "v", "support", "formation"])

    return requests.groupBy("g").applyInPandas(run, f"g {kind}, u long, v long, support double, formation long")


def uniform_graph(graphs: DataFrame, seed: int) -> DataFrame:
    """(g, u, v): m of the pairs of 0 to n - 1 of (g, n, m), by the least hashes; built-in functions only."""
    from pyspark.sql import Window

    from .graph import dyads

    d = dyads(graphs).join(graphs.select("g", "m"), "g")
    w = Window.partitionBy("g").orderBy(F.xxhash64(F.lit(seed), "g", "u", "v"), "u", "v")
    return d.withColumn("k", F.row_number().over(w)).where("k <= m").select("g", "u", "v")

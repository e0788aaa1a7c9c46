"""How document filters overlap: what each removes, alone and behind the others, in every order.

Texts are routed by their xxhash. A partition keeps, for each hash, the chain of the different texts that share it, each with its least id; every other id is emitted as that of a later copy. Copies
meet first where they are read, so a text leaves a partition once for every ``HELD`` bytes of texts read there, however many copies it has; behind the shuffle each partition is sorted by hash, so one chain is held at a time.
Each document then has a mask of the filters it fails. Numbers of documents by mask are vectors, merged by part with combineByKey; every order of the filters is read from such a vector.

Defined results
* nulls: a null text is judged as an empty one, a null source is the part "" (as an empty one is). A document without an id is no copy of another, and no other is a copy of it.
* empty and very long texts: an empty text fails A alone, besides E; texts are read whole.
* ties: rows that share the least id of a text are all first ones.
* repeated rows: each counts. A document is good or toxic if any label row of its id says so.
* an empty table gives no part, so an empty result; without labels good_lost and toxic_lost are 0.
* extra columns: only doc_id, text and source, and doc_id, quality and toxic of labels are read, so others may have any name.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby, permutations

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, session_of

#: Filters by the bit they set in a mask.
FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
#: Bytes of texts that a task holds while copies meet where they are read.
HELD = 32_000_000
#: Bytes of texts that a partition behind the shuffle holds, about.
ROUTED = 64_000_000
#: Documents with a mask: all, good ones, toxic ones.
KINDS = 3
_CAPITALS, _MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
RESULT = T.StructType([T.StructField("part", T.StringType()), T.StructField("filter_order", T.StringType()), T.StructField("step", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in COUNTS]])
MARKED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("part", T.StringType()), T.StructField("mask", T.IntegerType()), T.StructField("n", T.LongType())])


def own_mask(text: bytes) -> int:
    """Which of the filters A to D a text in UTF-8 fails."""
    words = text.split()  # of bytes: at ASCII white space only
    points = len(text) if text.isascii() else len(text.decode())
    few = len(words) < 50
    same = 100 * len(set(words)) < 65 * len(words)
    loud = 100 * (len(text) - len(text.translate(None, _CAPITALS))) > 5 * points
    marked = len(text.translate(None, _MARKS)) < len(text)
    return few | same << 1 | loud << 2 | marked << 3


class Chain:
    """The different texts of one hash: of each its bytes, mask, least id, and the parts of the rows with that id."""

    def __init__(self) -> None:
        self.links: list[list] = []

    def add(self, text: bytes, mask: int, doc_id: int, parts: Counter) -> Iterator[tuple]:
        """Takes rows in, and gives those that turn out to be later copies as (doc_id, part, mask, n)."""
        for link in self.links:
            if link[0] == text:
                if doc_id == link[2]:
                    link[3].update(parts)
                else:
                    later = (doc_id, parts) if doc_id > link[2] else (link[2], link[3])
                    if doc_id < link[2]:
                        link[2:] = [doc_id, parts]
                    for part, n in later[1].items():
                        yield later[0], part, mask | COPY, n
                return
        self.links.append([text, mask, doc_id, parts])


def meet_early(rows: Iterable) -> Iterator[tuple[int, tuple]]:
    """(key, message) of (doc_id, part, text) rows: a first copy goes by the hash of its text and with it, a later one or a row without an id without it and to any key."""
    chains: dict[int, Chain] = {}
    held = k = 0
    for doc_id, part, text in rows:
        text = (text or "").encode()
        if doc_id is None:
            k += 1
            yield _spread(k), (None, own_mask(text), None, {part: 1})
            continue
        h = xxhash.xxh3_64_intdigest(text)
        chain = chains.get(h)
        if chain is None:
            chain = chains[h] = Chain()
        known = len(chain.links)
        mask = next((x[1] for x in chain.links if x[0] == text), None)
        for later in chain.add(text, own_mask(text) if mask is None else mask, doc_id, Counter({part: 1})):
            k += 1
            yield _spread(k), (None, later[2], later[0], {later[1]: later[3]})
        if len(chain.links) > known:
            held += len(text)
        if held > HELD:
            yield from _first(chains)
            chains, held = {}, 0
    yield from _first(chains)


def _first(chains: dict[int, Chain]) -> Iterator[tuple[int, tuple]]:
    for h, chain in chains.items():
        for text, mask, doc_id, parts in chain.links:
            yield h, (text, mask, doc_id, dict(parts))


def _spread(k: int) -> int:
    """A key that only spreads messages."""
    return (k * 0x9E3779B97F4A7C15) % 2**64


def meet_all(messages: Iterable) -> Iterator[tuple]:
    """(doc_id, part, mask, n) of messages in the order of their keys."""
    for _, group in groupby(messages, key=lambda m: m[0]):
        chain = Chain()
        for _, (text, mask, doc_id, parts) in group:
            if text is None:
                for part, n in parts.items():
                    yield doc_id, part, mask, n
            else:
                yield from chain.add(text, mask, doc_id, Counter(parts))
        for _, mask, doc_id, parts in chain.links:
            for part, n in parts.items():
                yield doc_id, part, mask, n


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, n): for rows of docs the filters that they fail as bits, A the lowest; n rows that agree in all that."""
    spark = session_of(docs)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // ROUTED))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("source", F.lit("")), F.col("text")).rdd.mapPartitions(meet_early)
    routed = rows.repartitionAndSortWithinPartitions(partitions, lambda key: key % partitions)
    return spark.createDataFrame(routed.mapPartitions(meet_all), MARKED, verifySchema=False)


def later_copies(docs: DataFrame) -> DataFrame:
    """doc_id, n: ids of documents whose text a smaller id has as well, and how many such rows."""
    return marked(docs).where(F.col("mask").bitwiseAND(COPY) != 0).groupBy("doc_id").agg(F.sum("n").alias("n"))


def mask_counts(rows: RDD) -> RDD:
    """(part, counts) of (part, mask, good, toxic, n) rows: numbers of documents by mask and kind."""

    def add(counts: np.ndarray, row: tuple) -> np.ndarray:
        mask, good, toxic, n = row
        counts[mask] += np.array([n, n * good, n * toxic])
        return counts

    def new(row: tuple) -> np.ndarray:
        return add(np.zeros((1 << len(FILTERS), KINDS), np.int64), row)

    return rows.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(new, add, lambda a, b: a + b)


def every_order(counts: np.ndarray) -> Iterator[tuple]:
    """(filter_order, step, *COUNTS) for all orders of the filters."""
    masks, bits = np.arange(len(counts)), {f: 1 << i for i, f in enumerate(FILTERS)}
    fails = {f: counts[masks & b != 0, 0].sum() for f, b in bits.items()}
    # what a filter removes behind a set of others
    removed = {(f, before): counts[(masks & b != 0) & (masks & before == 0)].sum(0) for f, b in bits.items() for before in range(len(counts)) if not before & b}
    steps, shapley = [], Counter()
    for order in permutations(FILTERS):
        before = 0
        for step, f in enumerate(order, 1):
            out = removed[f, before]
            shapley[f] += int(out[0])
            before |= bits[f]
            kept = counts[masks & before == 0, 0].sum()
            steps.append(("".join(order), step, f, kept, out[0], fails[f] - out[0], counts[bits[f], 0], out[1], out[2]))
    for order, step, f, *numbers in steps:
        yield order, step, *map(int, numbers), shapley[f]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per part, order of the filters and step, with the columns of ``RESULT``."""
    spark = session_of(docs)
    ws = Workspace(spark, "audit")
    m = ws.keep(marked(docs)).groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("labelled")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    named = m.where("doc_id is not null").join(said, F.col("doc_id") == F.col("labelled"), "left").select("part", "mask", flag("good"), flag("toxic"), "n")
    nameless = m.where("doc_id is null").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"), "n")
    rows = mask_counts(named.unionByName(nameless).rdd).flatMap(lambda x: ((x[0], *r) for r in every_order(x[1])))
    return spark.createDataFrame(rows, RESULT, verifySchema=False)

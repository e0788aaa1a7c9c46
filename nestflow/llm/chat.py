"""Chat formatting by quotation linking: quoted passages are hashed, joined to the messages they come from, and cut out.

A line's quote level is the number of its leading ``>``. A run of lines of one level is a passage. Its text, lower-cased and with gaps of one space, is hashed, and so are the whole
body, the paragraphs and the lines of every message; a passage, of whatever level, comes from the latest earlier message of its conversation with its hash or, failing that, from the one
with most of its lines. A message replies to the origin of its outermost passages (most words first, then the latest); without one, to the message before it.
Conversations are put in reply order: by depth in the tree of replies, then by turn.

Numbers within a conversation come from sorted tables whose rows are dealt out by ranges, and from runs of ``CHUNK`` rows; so a conversation of any length is spread over tasks. A message's quotes
are linked by an ordered pass over hashes, without pairs.

Defined results
* nulls: a null text is an empty one; a message with a null conv_id belongs to no conversation: it is linked with nothing and stands at depth and position 0; messages with a null turn come last in theirs and are not linked.
* empty and very long texts: an empty text has no passages and nothing that others could quote; a text of any length is read whole.
* ties: of messages with equal hashes the latest earlier one is the origin; of origins of equal votes too; rows that share a turn are ordered by hashes of role and text, and a reply to that turn goes to the first.
* repeated rows: each gets a row and a position.
* an empty table gives an empty result.
* extra columns: only conv_id, turn, role and text are read, so others may have any name.
"""
from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, session_of

QUOTE = re.compile(r"\s*((?:>[ \t]?)+)(.*)", re.S)
#: A line that only announces a quote; four languages.
ANNOUNCES = re.compile(r"^\s*(on|am|le|el)\b.{0,200}\b(wrote|schrieb|a écrit|escribió)\b.{0,80}:\s*$", re.I)
#: Rows of a sorted table over which a running value is carried in one task.
CHUNK = 65_536
#: A line or paragraph of fewer words says too little to be known again by.
MIN_WORDS = 3


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def digest(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def parse(text: str | None) -> tuple[str, list[tuple[int, str, int]], list[tuple[str, int, bool, int]], int]:
    """(body, passages, keys, depth): passages as (level, hash, words); keys as (hash, words, whole passage?, passage number or -1).

    Keys with passage number -1 are what others can quote: the body, its paragraphs and lines. The others are what this message quotes.
    """
    levels: list[tuple[int, str]] = []
    for line in (text or "").split("\n"):
        m = QUOTE.fullmatch(line)
        levels.append((m[1].count(">"), m[2]) if m else (0, line))
    body = [x for i, (k, x) in enumerate(levels) if k == 0 and not (ANNOUNCES.match(x) and i + 1 < len(levels) and levels[i + 1][0])]
    runs: list[tuple[int, list[str]]] = []
    for i, (k, x) in enumerate(levels):
        if k and i and levels[i - 1][0] == k:
            runs[-1][1].append(x)
        elif k:
            runs.append((k, [x]))
    passages, keys = [], {}
    for k, lines in runs:
        whole = normal(" ".join(lines))
        if not whole:
            continue
        passages.append((k, digest(whole), len(whole.split())))
        n = len(passages) - 1
        for x in lines:
            if len(normal(x).split()) >= MIN_WORDS:
                keys[digest(normal(x)), n] = (len(normal(x).split()), False)
        keys[digest(whole), n] = (len(whole.split()), True)
    joined = "\n".join(body)
    for x in [*joined.split("\n"), *re.split(r"\n\s*\n", joined)]:
        if len(normal(x).split()) >= MIN_WORDS:
            keys[digest(normal(x)), -1] = (len(normal(x).split()), False)
    if normal(joined):
        keys[digest(normal(joined)), -1] = (len(normal(joined).split()), True)
    return re.sub(r"\n{3,}", "\n\n", joined).strip(), passages, [(h, w, whole, n) for (h, n), (w, whole) in keys.items()], max([k for k, _, _ in passages], default=0)


def parsed(messages: DataFrame) -> DataFrame:
    """Adds body, depth of quotes, levels of passages, and keys to (conv_id, turn, role, text)."""
    kinds = {f.name: f.dataType.simpleString() for f in messages.schema.fields}

    def run(batches):
        for b in batches:
            got = [parse(x) for x in b.column(3).to_pylist()]
            keys = pa.array([[{"h": h, "words": w, "whole": y, "n": n} for h, w, y, n in g[2]] for g in got], pa.list_(pa.struct([("h", pa.string()), ("words", pa.int32()), ("whole", pa.bool_()), ("n", pa.int32())])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([g[0] for g in got], pa.string()), pa.array([[p[0] for p in g[1]] for g in got], pa.list_(pa.int32())), keys], names=["conv_id", "turn", "role", "body", "levels", "keys"])

    return messages.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role {kinds['role']}, body string, levels array<int>, keys array<struct<h:string,words:int,whole:boolean,n:int>>")


def in_order(df: DataFrame, ws: Workspace, *order) -> DataFrame:
    """df with g, the row's number from 0 in this order over the whole table, and chunk; sorted by ranges, so no key gathers in a task."""
    d = ws.keep(df.orderBy(*order).select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at")))
    begin, rows = 0, []
    for part, n, first in sorted(d.groupBy("__part").agg(F.count("*").alias("n"), F.min("__at").alias("first")).collect()):  # a row for each partition
        rows.append((part, begin - first))
        begin += n
    shift = df.sparkSession.createDataFrame(rows, "__part int, __shift long")
    d = d.join(F.broadcast(shift), "__part").withColumn("g", F.col("__at") + F.col("__shift")).drop("__part", "__at", "__shift")
    return d.withColumn("chunk", F.floor(F.col("g") / CHUNK))


def running_last(d: DataFrame, **values) -> DataFrame:
    """d, numbered by ``in_order``, with columns that hold the last value, up to the row itself, that is not null.

    Within a chunk by a window; between chunks by one over a row for each ``CHUNK`` rows.
    """
    d = d.withColumns({f"__{k}": v for k, v in values.items()})
    inside = Window.partitionBy("chunk").orderBy("g")
    ends = d.groupBy("chunk").agg(*[F.max_by(f"__{k}", F.when(F.col(f"__{k}").isNotNull(), F.col("g"))).alias(f"{k}_") for k in values])
    past = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("chunk", *[F.last(f"{k}_", ignorenulls=True).over(past).alias(f"{k}_") for k in values])
    out = d.join(ends, "chunk", "left")
    return out.withColumns({k: F.coalesce(F.last(f"__{k}", ignorenulls=True).over(inside), F.col(f"{k}_")) for k in values}).drop(*[f"__{k}" for k in values], *[f"{k}_" for k in values])


def passages(m: DataFrame, ws: Workspace) -> DataFrame:
    """(row, n, level, from, words): the passages of messages (row, conv_id, turn, levels, keys), and the turn that each comes from or null."""
    k = m.where("turn is not null").select("conv_id", "turn", "row", "levels", F.explode("keys").alias("k"))
    asks = k.where("k.n >= 0").select("conv_id", "turn", "row", "k.h", "k.words", "k.whole", "k.n", F.element_at("levels", F.col("k.n") + 1).alias("level"))
    quoted = asks.select("conv_id", "h").distinct()
    # only what somebody quotes can be an origin
    has = k.where("k.n < 0").select("conv_id", "turn", "k.h").distinct().join(quoted, ["conv_id", "h"], "left_semi")
    both = asks.withColumn("has", F.lit(False)).unionByName(has.withColumn("has", F.lit(True)), allowMissingColumns=True)
    # in order of turns, those who ask before those who have: the last who has is the latest earlier origin
    d = in_order(both, ws, "conv_id", "h", "turn", "has")
    d = running_last(d, origin=F.when(F.col("has"), F.struct("conv_id", "h", "turn")))
    start = F.when((F.col("origin.conv_id") == F.col("conv_id")) & (F.col("origin.h") == F.col("h")), F.col("origin.turn"))
    found = d.where(~F.col("has")).select("row", "n", "level", "words", "whole", start.alias("from"))
    # per passage: its own hash first, then the message with most of its words
    votes = found.groupBy("row", "n", "level", "from").agg(F.max("whole").alias("whole"), F.sum(F.when(F.col("whole"), 0).otherwise(F.col("words"))).alias("part"), F.max(F.when(F.col("whole"), F.col("words"))).alias("all"))
    best = F.max(F.when(F.col("from").isNotNull(), F.struct("whole", F.coalesce("all", "part").alias("words"), F.col("from"))))
    return ws.keep(votes.groupBy("row", "n", "level").agg(best.alias("b"), F.max("all").alias("words")).select("row", "n", "level", F.col("b.from").alias("from"), F.col("words"), F.col("b.words").alias("linked")))


def link(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, reply_to, quoted, quotes, depth, position, text: the messages without quotes, in reply order.

    reply_to is a turn; quoted tells whether a quotation says so; quotes lists the message's passages as (level, words, from), from being the turn that a passage comes from
    or null; position counts from 0 within the conversation.
    """
    ws = Workspace(session_of(messages), "chat")
    m = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.col("text").cast("string").alias("text"))
    m = ws.keep(parsed(m).withColumn("row", F.monotonically_increasing_id()))
    inside = m.where("conv_id is not null")
    found = passages(inside, ws)
    list_of = F.transform(F.array_sort(F.collect_list(F.struct("n", "level", "words", "from"))), lambda x: F.struct(x["level"].alias("level"), x["words"].alias("words"), x["from"].alias("from")))
    outer = F.max(F.when(F.col("from").isNotNull(), F.struct((-F.col("level")).alias("outer"), F.col("linked").alias("words"), F.col("from"))))
    replies = ws.keep(found.groupBy("row").agg(list_of.alias("quotes"), outer.alias("p")).select("row", "quotes", F.col("p.from").alias("parent")))
    narrow = inside.select("row", "conv_id", "turn", F.xxhash64("role", "body").alias("tie")).join(replies.select("row", "parent"), "row", "left")
    order = [F.col("turn").asc_nulls_last(), "tie", "row"]
    s = in_order(narrow, ws, "conv_id", *order)
    # the row before, over the chunks' borders too
    by = Window.partitionBy("chunk").orderBy("g")
    ends = s.groupBy((F.col("chunk") + 1).alias("chunk")).agg(F.max_by(F.struct("conv_id", "turn"), "g").alias("end"))
    s = s.join(ends, "chunk", "left").withColumn("last", F.coalesce(F.lag(F.struct("conv_id", "turn")).over(by), F.col("end"))).drop("end")
    s = s.withColumn("opens", ~F.coalesce(F.col("last.conv_id") == F.col("conv_id"), F.lit(False))).withColumn("before", F.when(~F.col("opens"), F.col("last.turn"))).drop("last")
    # a run of messages that follow each other is a segment, named after its first row; only that has a parent elsewhere
    s = running_last(s, seg=F.when(F.col("opens") | F.col("parent").isNotNull(), F.col("g")), first=F.when(F.col("opens"), F.col("g")))
    s = ws.keep(s.withColumn("step", F.col("g") - F.col("seg")))
    spots = s.where("turn is not null").groupBy("conv_id", F.col("turn").alias("parent")).agg(F.min(F.struct("g", "seg", "step")).alias("at"))
    heads = s.where("parent is not null").select("conv_id", "seg", "parent")
    tree = ws.keep(heads.join(spots, ["conv_id", "parent"]).select("seg", F.col("at.seg").alias("up"), (F.col("at.step") + 1).alias("above"), F.lit(True).alias("open")))
    while tree.where("open").limit(1).count():  # each pass doubles the reach
        b = tree.select(F.col("seg").alias("up"), F.col("up").alias("up2"), F.col("above").alias("above2"))
        nxt = tree.join(b, "up", "left").select("seg", F.coalesce("up2", "up").alias("up"), (F.col("above") + F.coalesce("above2", F.lit(0))).alias("above"), F.col("up2").isNotNull().alias("open"))
        new = ws.keep(nxt)
        ws.drop(tree)
        tree = new
    d = s.join(tree.select("seg", "above"), "seg", "left").withColumn("depth", F.col("step") + F.coalesce("above", F.lit(0)))
    # conversations lie in the same runs of rows in both orders
    placed = in_order(d.select("row", "conv_id", "depth", F.col("g").alias("was"), "first", "parent", "before"), ws, "conv_id", "depth", "was")
    placed = placed.select("row", F.coalesce("parent", "before").alias("reply_to"), F.col("parent").isNotNull().alias("quoted"), F.col("depth").cast("int").alias("depth"), (F.col("g") - F.col("first")).cast("int").alias("position"))
    out = m.select("row", "conv_id", "turn", "role", "body").join(placed.join(replies.select("row", "quotes"), "row", "left"), "row", "left")
    none = F.array().cast("array<struct<level:int,words:int,from:bigint>>")
    return out.select("conv_id", "turn", "role", "reply_to", F.coalesce("quoted", F.lit(False)).alias("quoted"), F.coalesce("quotes", none).alias("quotes"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("position", F.lit(0)).alias("position"), F.col("body").alias("text"))

import random
import re

import pytest

from nestflow.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
A = "Could you tell me where the old mill stands?\n\nI walked there once, long ago."
B = "> Could you tell me where the old mill stands?\n\nIt stands by the river, near the bridge."
C = "On Monday, Ann wrote:\n> It stands by the\n> river, near the bridge.\n> > could you tell me where   the old MILL stands?\nThank you, found it."
D = "> I walked there once, long ago.\nHow long ago was that?"
ROWS = [(1, 0, "user", A), (1, 1, "assistant", B), (1, 2, "user", C), (1, 3, "user", D), (1, 4, "assistant", "More than ten years."), (2, 0, "user", B), (2, 1, "user", "no quote here at all")]


def run(spark, rows):
    return {(r.conv_id, r.turn, r.role): r for r in chat.link(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_replies_follow_quotes(spark):
    got = run(spark, ROWS)
    reply = {k[:2]: (r.reply_to, r.quoted, r.depth, r.position) for k, r in got.items()}
    assert reply == {(1, 0): (None, False, 0, 0), (1, 1): (0, True, 1, 1), (1, 2): (1, True, 2, 3), (1, 3): (0, True, 1, 2), (1, 4): (3, False, 2, 4), (2, 0): (None, False, 0, 0), (2, 1): (0, False, 1, 1)}
    quotes = {k[:2]: [(q.level, q["from"]) for q in r.quotes] for k, r in got.items()}
    assert quotes == {(1, 0): [], (1, 1): [(1, 0)], (1, 2): [(1, 1), (2, 0)], (1, 3): [(1, 0)], (1, 4): [], (2, 0): [(1, None)], (2, 1): []}
    assert got[1, 2, "user"].text == "Thank you, found it." and got[1, 1, "assistant"].text == "It stands by the river, near the bridge."


def test_long_chain_of_quotes(spark):
    n = 40
    rows = [(1, 0, "user", "message number zero says hello")]
    for i in range(1, n):
        rows.append((1, i, "user", f"> {rows[-1][3].splitlines()[-1]}\nmessage number {i} answers the one before"))
    got = run(spark, rows)
    assert all(got[1, i, "user"].depth == i and got[1, i, "user"].reply_to == i - 1 for i in range(1, n))


def test_latest_of_equal_messages(spark):
    got = run(spark, [(1, 0, "user", "are you there now"), (1, 1, "user", "are you there now"), (1, 2, "user", "other words in between"), (1, 3, "user", "> are you there now\nyes")])
    assert got[1, 3, "user"].reply_to == 1


def test_odd_tables(spark):
    rows = [(None, 0, "user", "hello to you all"), (None, 1, "user", "> hello to you all\nhi"), (1, None, None, "> lost\nx"), (1, 0, "user", None), (1, 0, "user", None), (1, 1, "a", ""), (2, 0, "u", ">"), (2, 1, "u", "> " + "y " * 50_000), (2, 2, "u", ">>>> deep\n> not so")]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("row", "keys", "body", "depth", "position", "h", "seg"):
        df = df.withColumn(c, df["role"])
    got = chat.link(df).collect()
    assert len(got) == len(rows)
    assert all((r.reply_to, r.quoted, r.depth, r.position) == (None, False, 0, 0) for r in got if r.conv_id is None)
    for rows_, cols in ((rows[:0], None), ([(1, 1, "u", "a b"), (1, 1, "u", "a b")], None)):
        assert chat.link(spark.createDataFrame(rows_, SCHEMA)).count() == len(rows_)


def test_depths_against_a_walk(spark):
    import random

    r = random.Random(3)
    rows, parent = [], {}
    for i in range(60):
        q = r.randrange(i) if i and r.random() < 0.6 else None
        rows.append((7, i, "u", (f"> this is message w{q}x\n" if q is not None else "") + f"this is message w{i}x"))
        parent[i] = q if q is not None else i - 1
    depth = {}
    for i in range(60):
        depth[i] = 0 if i == 0 else depth[parent[i]] + 1
    got = run(spark, rows)
    assert {i: got[7, i, "u"].depth for i in range(60)} == depth
    assert [k[1] for k, x in sorted(got.items(), key=lambda z: z[1].position)] == sorted(range(60), key=lambda i: (depth[i], i))


def plain(rows):
    """(conv_id, turn) -> (reply_to, quotes, depth, position) straight from the definition; rows have distinct turns and quote without announcements."""
    norm = lambda x: " ".join(x.lower().split())
    out, by = {}, {}
    for c, t, _, x in rows:
        by.setdefault(c, []).append((t, x))
    for c, ms in by.items():
        have, depth = [], {}
        for i, (t, x) in enumerate(sorted(ms)):
            lines = []
            for line in x.split("\n"):
                m = re.match(r"\s*((?:>[ \t]?)+)(.*)", line)
                lines.append((m[1].count(">"), m[2]) if m else (0, line))
            runs = []
            for k, (level, y) in enumerate(lines):
                if level and k and lines[k - 1][0] == level:
                    runs[-1][1].append(y)
                elif level:
                    runs.append((level, [y]))
            quotes, outer = [], None
            for level, ys in runs:
                whole = norm(" ".join(ys))
                if not whole:
                    continue
                best = None
                exact = [u for u, keys in have if whole in keys]
                if exact:
                    best = (True, len(whole.split()), exact[-1])
                else:
                    votes = {}
                    for y in {norm(y) for y in ys if len(norm(y).split()) >= 3}:
                        origin = [u for u, keys in have if y in keys]
                        if origin:
                            votes[origin[-1]] = votes.get(origin[-1], 0) + len(y.split())
                    if votes:
                        best = max((False, n, u) for u, n in votes.items())
                quotes.append((level, len(whole.split()), best and best[2]))
                if best:
                    outer = max(filter(None, [outer, (-level, best[1], best[2])]))
            body = "\n".join(y for level, y in lines if not level)
            keys = {norm(y) for y in [*body.split("\n"), *re.split(r"\n\s*\n", body)] if len(norm(y).split()) >= 3} | ({norm(body)} - {""})
            have.append((t, keys))
            parent = outer[2] if outer else (sorted(ms)[i - 1][0] if i else None)
            depth[t] = depth[parent] + 1 if parent is not None else 0
            out[c, t] = [parent, quotes, depth[t]]
        for n, (t, _) in enumerate(sorted(depth.items(), key=lambda z: (z[1], z[0]))):
            out[c, t].append(n)
    return {k: tuple(v) for k, v in out.items()}


def talk(r, conversations, longest):
    """Messages of invented lines that quote earlier ones, whole or in part, at one or more levels."""
    rows = []
    for c in range(conversations):
        texts = []
        for t in range(r.randint(1, longest)):
            own = [" ".join(r.choice("abcdefg") * r.randint(1, 2) for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 3))]
            lines = []
            for _ in range(r.randint(0, 2)):
                if texts:
                    q = r.choice(texts)
                    part = q if r.random() < 0.5 else r.sample(q, 1)
                    lines += ["> " * r.randint(1, 3) + x for x in part]
                    lines += [""] if r.random() < 0.5 else ["> something that nobody has said"]
            texts.append(own)
            rows.append((c, t, "user", "\n".join(lines + own)))
    return rows


@pytest.mark.parametrize("chunk", [65_536, 7])
def test_against_the_definition(spark, monkeypatch, chunk):
    monkeypatch.setattr(chat, "CHUNK", chunk)
    rows = talk(random.Random(chunk), 12, 25)
    got = chat.link(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert {(x.conv_id, x.turn): (x.reply_to, [(q.level, q.words, q["from"]) for q in x.quotes], x.depth, x.position) for x in got} == plain(rows)

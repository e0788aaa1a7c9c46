"""SentencePiece BPE ids by a prefix table, and texts back from ids.

The encoding of every prefix of a text ends with one certain token. So a table holds that last token for each prefix: of the pieces that an automaton finds to end at a place, it is
the only one that may stand behind the last token of the prefix before it. Whether two tokens may stand side by side is told by replaying the merges of both: if a merge across the boundary
ever comes first, they may not. The ids are then read backwards from the end of the text. A table takes time in proportion to the text, however long it is.

Where no piece crosses a run of spaces from the left, as in most vocabularies, a text falls apart before such runs; each worker remembers the ids of the short parts it has met.

Defined results
* nulls: a null text is encoded as an empty one; a null doc_id stays null.
* empty and very long texts: an empty text is the end id alone and decodes to an empty text; a text of any length is encoded whole, also without any space.
* ties: merges of equal score go from left to right, as the library's do; so a text has one encoding.
* repeated rows: each row has its own result; equal texts have equal ids.
* an empty table gives an empty result.
* extra columns: only doc_id and text are read, so others may have any name. Strings of control pieces in a text are ordinary text; a character without a piece becomes its bytes.
"""
from __future__ import annotations

import re
import sys
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import session_of, text_batches
from .tokens import slices, tidy

#: What stands for a space in pieces.
SPACE = "▁"
#: Texts that are encoded at a time, in bytes.
CHUNK = 4_000_000
#: Parts of texts, and pairs of tokens, that a worker remembers; parts of more characters are not.
PARTS, PAIRS, PART_LENGTH = 200_000, 1_000_000, 64


class Table:
    """The vocabulary of a model, with the merges that lead to each piece."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.vocab_size())
        self.byte = {int(m.id_to_piece(i)[1:-1], 16): i for i in ids if m.is_byte(i)}
        if len(self.byte) != 256 or any(m.is_unused(i) for i in ids):
            raise ValueError("the model needs a piece for each byte, and no unused pieces")
        plain = [i for i in ids if not (m.is_control(i) or m.is_byte(i) or m.is_unknown(i))]
        self.score = {m.id_to_piece(i): m.get_score(i) for i in plain}
        #: By token: its string, the merges that form it as (score, the string at its right end, that at its left end).
        self.text: dict[int, str] = {i: m.id_to_piece(i) for i in plain}
        for c in sorted({c for p in self.score for c in p} - set(self.score)):  # part of a piece, but none itself
            self.text[len(ids) + len(self.text)] = c
        self.merges: dict[int, list[tuple[float, str, str]]] = {}
        self.found = ahocorasick.Automaton()
        for i, p in self.text.items():
            steps = self._steps(p)
            if steps is not None:  # otherwise no text is ever merged to this piece
                self.merges[i] = steps
                self.found.add_word(p, (i, len(p)))
        self.found.make_automaton()
        apart = not any(SPACE in p.lstrip(SPACE) for p in self.score)
        self.parts_of = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if apart else r"(?s:.+)").findall
        #: Parts met lately, and those met before them.
        self.parts: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}
        self.width = max(self.text) + 1
        self.pairs: dict[int, bool] = {}

    def _steps(self, piece: str) -> list[tuple[float, str, str]] | None:
        """The merges of a piece by itself, best score first and then from left to right; None if they do not end with the piece."""
        s, out = list(piece), []
        while len(s) > 1:
            best, at = max(((self.score.get(a + b, -np.inf), -k) for k, (a, b) in enumerate(zip(s, s[1:]))))
            if best == -np.inf:
                return None
            s[-at : -at + 2] = [s[-at] + s[-at + 1]]
            out.append((best, s[-1], s[0]))
        return out

    def fits(self, a: int, b: int) -> bool:
        """Whether the text of a and b together is encoded as a, b: no merge across the boundary comes before the next one on either side."""
        left, right, score = self.merges[a], self.merges[b], self.score
        i, j, x, y = 0, 0, self.text[a][-1], self.text[b][0]
        while True:
            across = score.get(x + y)
            p = left[i][0] if i < len(left) else None
            q = right[j][0] if j < len(right) else None
            if across is not None and (p is None or across > p) and (q is None or across >= q):
                return False
            if p is not None and (q is None or p >= q):
                x, i = left[i][1], i + 1
            elif q is not None:
                y, j = right[j][2], j + 1
            else:
                return True

    def last_tokens(self, part: str) -> list[int]:
        """For each prefix of the part its last token; -1 for a character without a piece, behind and before which anything may stand."""
        last, pairs, width = [-1] * (len(part) + 1), self.pairs, self.width
        if len(pairs) > PAIRS:
            pairs.clear()
        for at, (token, size) in self.found.iter(part):
            end = at + 1
            if last[end] >= 0:
                continue
            before = last[end - size]
            if before >= 0:
                pair = before * width + token
                ok = pairs.get(pair)
                if ok is None:
                    ok = pairs[pair] = self.fits(before, token)
                if not ok:
                    continue
            last[end] = token
        return last

    def encode_part(self, part: str) -> list[int]:
        """Ids of a part, recovered from its end backwards."""
        last, end, out = self.last_tokens(part), len(part), []
        while end:
            token = last[end]
            p = part[end - 1] if token < 0 else self.text[token]
            if p in self.score:
                out.append(token)
            else:
                out.extend(self.byte[x] for x in reversed(p.encode()))
            end -= len(p)
        out.reverse()
        return out

    def recall(self, part: str) -> list[int]:
        """Ids of a part that has not been met lately."""
        ids = self.older.get(part) or self.encode_part(part)
        if len(part) <= PART_LENGTH:
            if len(self.parts) >= PARTS:
                self.older, self.parts = self.parts, {}
            self.parts[part] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        get, extend = self.parts.get, out.extend
        for part in self.parts_of(self.model.normalize(text)):
            extend(get(part) or self.recall(part))
        return out


def load_table(path: str) -> Table:
    """One table for each Python worker, which serves many tasks."""
    kept = sys.modules.setdefault("nestflow_worker_tables", ModuleType("nestflow_worker_tables")).__dict__
    key = f"pieces {path}"
    if key not in kept:
        kept[key] = Table(path)
    return kept[key]


def encode(docs: DataFrame, model: str, decoded: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids), with ``decoded`` also the text that the ids give back: a row per row of docs, partitioned as docs is. The end id comes last and is counted."""
    text_batches(session_of(docs))
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    if decoded:
        schema = schema.add("decoded", T.StringType())
    names = schema.names

    def run(batches):
        table = load_table(model)
        end = table.model.eos_id()
        for batch in batches:
            for part in slices(batch, 1, CHUNK):
                ids = [[*table.encode(t or ""), end] for t in part.column(1).to_pylist()]
                columns = [part.column(0), pa.array(list(map(len, ids)), pa.int64()), pa.array(ids, pa.list_(pa.int32()))]
                if decoded:
                    columns.append(pa.array([table.model.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the text of the ids in ``out_col``; null ids have a null text."""
    text_batches(session_of(encoded))
    at, schema = encoded.columns.index(ids_col), T.StructType([*encoded.schema.fields, T.StructField(out_col, T.StringType())])

    def run(batches):
        m = load_table(model).model
        for b in batches:
            texts = [None if x is None else m.decode(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=schema.names)
            tidy()

    return encoded.mapInArrow(run, schema)


def digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, and sha256 of the ids in decimal, joined by spaces, and of the decoded text."""
    e = encode(docs, model, decoded=True)
    return e.select("doc_id", "n_tokens", F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

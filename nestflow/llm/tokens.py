"""Tokens and shingles of Arrow text columns, a batch at a time."""
from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


def tidy() -> None:
    """Gives memory back that freed batches have left with the allocators, as a worker serves many tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batch: pa.RecordBatch, column: int, most: int = 3_000_000):
    """The batch in runs of rows whose texts have about ``most`` bytes together; one row at least. Tidies up behind itself."""
    length = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    upto, at = np.cumsum(length), 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop
    tidy()


def split_tokens(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct tokens, each token's place among them, tokens per text); A-Z lower-cased, split at ASCII white space."""
    n = len(texts)
    flat = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    size = pc.list_value_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = flat.flatten().dictionary_encode()
    vocab, code = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if "" in vocab:  # before leading and after trailing white space
        gone = vocab.index("")
        full = code != gone
        size = np.bincount(np.repeat(np.arange(n), size), full, n).astype(np.int64)
        code = code[full]
        code -= code > gone
        vocab.pop(gone)
    return vocab, code, size


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(29))


def shingles(texts: pa.Array, width: int = 2) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles of ``width`` tokens.

    A text of fewer tokens, but not none, has one shingle, the whole of it; a text without tokens has none.
    """
    vocab, code, size = split_tokens(texts)
    word = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocab), np.uint64, len(vocab))[code] if len(code) else np.zeros(0, np.uint64)
    ends = np.cumsum(size)
    n = max(0, len(word) - width + 1)
    roll = np.full(n, width, np.uint64)
    for k in range(width):
        roll = _mixed(roll * np.uint64(0xD6E8FEB86659FD93) + word[k : k + n])
    out = []
    for end, k in zip(ends.tolist(), size.tolist(), strict=True):
        if k >= width:
            out.append(np.unique(roll[end - k : end - width + 1]))
        elif k:
            whole = np.full(1, k, np.uint64)
            for w in word[end - k : end]:
                whole = _mixed(whole * np.uint64(0xD6E8FEB86659FD93) + w)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out

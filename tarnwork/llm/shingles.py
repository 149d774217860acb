"""Vectorised word and shingle hashing straight from Arrow string buffers (numpy, no Python strings).

A word is a run of bytes other than ASCII blanks; A-Z count as a-z.  A shingle is ``width``
consecutive words of one document; a document of fewer words (but at least one) has one shingle, of
all its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
#: Bytes hashed at once; a longer document makes a chunk of its own.
CHUNK = 4 << 20

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_LOWER += 1
#: Byte values as they are, for hashes that tell A-Z from a-z.
EXACT = np.arange(1, 257, dtype=np.uint64)
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
_POWERS = {"n": 0, "up": None, "down": None}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int):
    if _POWERS["n"] < n:
        inverse = U(pow(int(BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            for name, b in (("up", BASE), ("down", inverse)):
                p = np.full(n, b, np.uint64)
                p[0] = 1
                _POWERS[name] = np.cumprod(p, dtype=np.uint64)
        _POWERS["n"] = n
    return _POWERS["up"], _POWERS["down"]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls have length 0."""
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        import pyarrow.compute as pc

        column = pc.fill_null(column, "")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most ``limit`` bytes, or of one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = b


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each run [start, end) of byte values (uint64, above 0)."""
    n = len(values)
    up, down = _powers(max(n + 1, CHUNK + 1))
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def spans(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rows' bytes, start and end of each word in them, and the word offsets of the rows."""
    base, end = int(offsets[0]), int(offsets[-1])
    raw = data[base:end]
    at = offsets - base
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return raw, none, none, np.zeros(len(at), np.int64)
    letter = ~blank[raw]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    heads = at[:-1][at[:-1] < n]
    first[heads] = letter[heads]
    starts = np.flatnonzero(first)
    last = letter.copy()
    last[:-1] &= ~letter[1:]
    tails = at[1:][at[1:] > 0] - 1
    last[tails] = letter[tails]
    ends = np.flatnonzero(last) + 1
    return raw, starts, ends, np.searchsorted(starts, at, "left")


def word_strings(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, blank: np.ndarray = BLANK) -> pa.StringArray:
    """The words that ``spans`` found, as strings."""
    body = raw[~blank[raw]]
    at = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=at[1:])
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(body))


def words(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray = _LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the rows, and the word offsets of the rows."""
    raw, starts, ends, at = spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), at
    return run_hashes(fold[raw], starts, ends), at


def shingles(word: np.ndarray, at: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each shingle and the row it belongs to, in text order."""
    counts = np.diff(at)
    rows = len(counts)
    with np.errstate(over="ignore"):
        if len(word) >= width:
            n = len(word) - width + 1
            s = np.zeros(n, np.uint64)
            for j in range(width):
                s = s * U(0x9FB21C651E98DF25) + word[j : j + n]
            s = mix(s + U(width))
            row = np.repeat(np.arange(rows), counts)[:n]
            ok = np.arange(n) + width <= at[1:][row]
            s, row = s[ok], row[ok]
        else:
            s, row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        short = np.flatnonzero((counts > 0) & (counts < width))
        if len(short):
            extra = np.zeros(len(short), np.uint64)
            for j in range(width - 1):
                has = counts[short] > j
                extra = np.where(has, extra * U(0x9FB21C651E98DF25) + word[np.minimum(at[:-1][short] + j, len(word) - 1)], extra)
            extra = mix(extra + counts[short].astype(np.uint64))
            s, row = np.concatenate([s, extra]), np.concatenate([row, short])
            order = np.argsort(row, kind="stable")
            s, row = s[order], row[order]
    return s, row

"""Vectorised word and shingle hashing over Arrow string arrays.

Works on whole texts.  Words are runs of bytes other than ASCII white space
(0x20, 0x09-0x0D) with A-Z lower-cased.  A word's hash is a polynomial over its
bytes taken from prefix sums, finished with a 64-bit mixer; a shingle's hash
combines the hashes of its words in order.  A text with fewer words than the
shingle length has one shingle, its whole word sequence; a null or blank text
has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_C = np.uint64(0xD6E8FEB86659FD93)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply), elementwise."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the multiplier and of its inverse modulo 2**64."""
    if "p" not in _powers or len(_powers["p"]) <= n:
        size = max(n, CHUNK_BYTES) + 1
        for key, base in (("p", _P), ("i", _P_INV)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[key] = np.multiply.accumulate(table)
    return _powers["p"], _powers["i"]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes and their n + 1 offsets; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole texts of about ``most`` bytes."""
    body, at = flat(texts)
    row, n = 0, len(at) - 1
    while row < n:
        to = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield row, to, body[at[row] : at[to]], at[row : to + 1] - at[row]
        row = to


def words(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in bytes, and for each text the index of its first word (n + 1 values)."""
    n = len(body)
    solid = np.zeros(n + 2, dtype=bool)
    solid[1:-1] = ~SPACE[body]
    edge = solid[1:] != solid[:-1]
    inner = at[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    cut = np.unique(inner[solid[inner] & solid[inner + 1]])  # two texts meet within solid bytes
    bounds = np.flatnonzero(edge)
    starts, ends = bounds[0::2], bounds[1::2]
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(starts, at, "left")


def word_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    p, inv = powers(len(body))
    total = np.zeros(len(body) + 1, dtype=np.uint64)
    np.cumsum((LOWER[body].astype(np.uint64) + np.uint64(1)) * p[: len(body)], out=total[1:])
    return mix((total[ends] - total[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def shingles(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 64-bit shingle hashes) of every text, whole, in row order."""
    for first, to, body, at in chunks(texts):
        starts, ends, begin = words(body, at)
        h = word_hashes(body, starts, ends)
        full = np.zeros(0, np.uint64)
        if len(h) >= k:
            full = h[: len(h) - k + 1].copy()
            for j in range(1, k):
                full = full * _C + h[j : len(h) - k + 1 + j]
            full = mix(full)
        for i in range(to - first):
            a, b = begin[i], begin[i + 1]
            if b - a >= k:
                s = np.sort(full[a : b - k + 1])
                yield first + i, s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif b > a:
                one = np.uint64(b - a)
                with np.errstate(over="ignore"):
                    for x in h[a:b]:
                        one = one * _C + x
                yield first + i, mix(np.array([one]))
            else:
                yield first + i, np.zeros(0, np.uint64)

"""Vectorised words, word hashes and shingles of Arrow text columns.

A word is a run of bytes other than ``\\x20`` and ``\\x09-\\x0D``, with A-Z lower-cased. Words and
shingles are represented by 64-bit hashes. Everything here works on one Arrow batch inside a Spark
task; nothing depends on the batch's borders, since no word reaches across two texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: The same, with ASCII punctuation and control bytes as gaps too.
LOOSE = ~np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = (_RNG.integers(0, 2**63, 256, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_PLACES = (_RNG.integers(0, 2**63, 64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)

#: Texts of a batch are worked on in runs of about so many bytes, to bound memory.
RUN_BYTES = 1 << 18

_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        made = []
        for base in (_BASE, _BASE_INVERSE):
            table = np.full(max(n, RUN_BYTES + 1), base, np.uint64)
            table[0] = 1
            made.append(np.cumprod(table, dtype=np.uint64))
        if n > 16 * RUN_BYTES:  # one enormous text: don't keep its tables
            return made[0], made[1]
        _powers[:] = made
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after another, and where each begins (and the last ends)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def runs(at: np.ndarray, limit: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit bytes each; at least one text in each."""
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def word_hashes(raw: np.ndarray, at: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the texts, and where each text's words begin (and the last end)."""
    n, texts = len(raw), len(at) - 1
    if not n:
        return np.zeros(0, np.uint64), np.zeros(texts + 1, np.int64)
    gap = np.ones(n + 1, bool)
    np.take(gaps, raw, out=gap[:n])
    inside = ~gap[:n]
    first = inside.copy()
    first[1:] &= gap[: n - 1]
    edge = at[(at > 0) & (at < n)]
    first[edge] = inside[edge]
    last = inside & gap[1:]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[raw]] * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    return hashes, np.searchsorted(starts, at)


def sequence_hashes(words: np.ndarray, begin: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's n-word sequences, in order, and where each text's begin (and the last end)."""
    counts = np.maximum(np.diff(begin) - n + 1, 0)
    out_at = np.concatenate([[0], np.cumsum(counts)])
    if not out_at[-1]:
        return np.zeros(0, np.uint64), out_at
    total = len(words) - n + 1
    every = words[:total] * _PLACES[0]
    for k in range(1, n):
        every += words[k : k + total] * _PLACES[k]
    keep = np.zeros(total + 1, np.int32)
    np.add.at(keep, begin[:-1][counts > 0], 1)
    np.add.at(keep, (begin[:-1] + counts)[counts > 0], -1)
    return mix(every[np.cumsum(keep[:total]) > 0]), out_at


def shingle_sets(words: np.ndarray, begin: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct n-word shingles as sorted hashes, and where each text's begin.

    A text of fewer words has its whole sequence as its one shingle; a text without words has none.
    """
    shingles, at = sequence_hashes(words, begin, n)
    n_words = np.diff(begin)
    short = np.flatnonzero((n_words > 0) & (n_words < n))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for k, i in enumerate(short):
            own = words[begin[i] : begin[i + 1]]
            extra[k] = (own * _PLACES[16 : 16 + len(own)]).sum(dtype=np.uint64)
        shingles = np.insert(shingles, at[short], mix(extra))
        more = np.zeros(len(n_words), np.int64)
        more[short] = 1
        at = at + np.concatenate([[0], np.cumsum(more)])
    if not len(shingles):
        return shingles, at
    for i in range(len(at) - 1):
        shingles[at[i] : at[i + 1]].sort()
    new = np.ones(len(shingles), bool)
    new[1:] = shingles[1:] != shingles[:-1]
    new[at[:-1][at[:-1] < len(shingles)]] = True
    return shingles[new], np.concatenate([[0], np.cumsum(new)])[at]

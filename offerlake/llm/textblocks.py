"""Vectorised word hashing over Arrow string columns.

A block is a run of whole texts of about BLOCK_BYTES bytes, so that the work arrays stay small whatever the
batch size; one text longer than that is a block of its own. Words are maximal runs of bytes for which a
256-entry table holds True. A-Z count as a-z. A word's hash is a polynomial over its bytes modulo 2**64, taken
from prefix sums (so its cost doesn't depend on word lengths), then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18
U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
#: One odd 64-bit number for each (lower-cased) byte.
_BYTE_VALUES = None

#: Words are what is between ASCII white space: [^\x20\x09-\x0D]+
BLANK_SEPARATED = np.ones(256, dtype=bool)
BLANK_SEPARATED[[0x20, *range(0x09, 0x0E)]] = False
#: Words are ASCII letters, digits and everything beyond ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (the published splitmix64 constants)."""
    x = np.asarray(x, dtype=U64) + U64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> U64(shift)
        x *= U64(factor)
    return x ^ (x >> U64(31))


_BYTE_VALUES = mix(_lower.astype(U64)) | U64(1)
_powers = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        steps = np.full(max(n, BLOCK_BYTES + 1), _P if kind == "up" else _P_INVERSE, U64)
        steps[0] = 1
        _powers[kind] = np.multiply.accumulate(steps)
    return _powers[kind]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n+1 offsets of each; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    # Buffers are read as they are: a copy of each batch would hold its memory several times over.
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole texts of about limit bytes."""
    data, at = utf8(column)
    row, n = 0, len(at) - 1
    while row < n:
        to = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
        yield row, to, data[at[row] : at[to]], at[row : to + 1] - at[row]
        row = to
    pa.default_memory_pool().release_unused()


def word_spans(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte positions where words start and end (exclusive), and the n+1 word offsets of the texts."""
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = table[data]
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    edges = at[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    first[edges] = inside[edges + 1]
    last[edges - 1] = inside[edges]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, at: np.ndarray, table: np.ndarray = BLANK_SEPARATED) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and the n+1 word offsets of the texts."""
    starts, ends, of = word_spans(data, at, table)
    sums = np.zeros(len(data) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE_VALUES[data] * _power("up", len(data))[: len(data)], out=sums[1:])
        raw = (sums[ends] - sums[starts]) * _power("down", len(data) + 1)[starts]
    return mix(raw), of


def shingles(words: np.ndarray, of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text in order, and their n+1 offsets.

    A text of fewer words, but not none, has its whole sequence as its one shingle.
    """
    counts = np.diff(of)
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    to = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(int(to[-1]), U64)
    if not len(out):
        return out, to
    where = np.arange(len(out)) - np.repeat(to[:-1], sizes) + np.repeat(of[:-1], sizes)
    n_words = np.repeat(np.minimum(counts, k), sizes)
    with np.errstate(over="ignore"):
        for j in range(k):
            has = n_words > j
            if has.all():
                out = mix(out + words[where + j]) if j else mix(words[where])
            else:
                out[has] = mix(out[has] + words[where[has] + j]) if j else mix(words[where[has]])
        out += n_words.astype(U64) * U64(0xD6E8FEB86659FD93)
    return mix(out), to


def sort_within(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Sort the values of each text in place."""
    for a, b in zip(of[:-1].tolist(), of[1:].tolist(), strict=True):
        if b - a > 1:
            values[a:b].sort()
    return values


def distinct_within(values: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, and their n+1 offsets."""
    values = sort_within(values.copy(), of)
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    new[of[:-1][of[:-1] < len(values)]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return values[new], kept[of]

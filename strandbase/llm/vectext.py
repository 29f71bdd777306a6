"""Text as flat arrays: words, lines and their 64-bit hashes over a whole Arrow batch at once.

All functions work on UTF-8 bytes.  A word hash is a polynomial over per-byte
random values, read off a running sum, so its cost doesn't depend on word length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

_rng = np.random.Generator(np.random.PCG64(20240601))
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) | U64(1)
BYTE_VALUE_LOWER = BYTE_VALUE.copy()
BYTE_VALUE_LOWER[65:91] = BYTE_VALUE[97:123]

#: 9-13 and 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def powers(n: int, which: str = "up") -> np.ndarray:
    have = _powers[which]
    if len(have) < n:
        base = _BASE if which == "up" else _INVERSE
        size = -(-n // (1 << 18)) * (1 << 18)
        have = np.full(size, base, U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[which] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[s:e] for each span; equal spans hash alike wherever they stand."""
    if not len(starts):
        return np.zeros(0, U64)
    run = np.empty(len(values) + 1, U64)
    run[0] = 0
    np.cumsum(values * powers(len(values)), out=run[1:])
    return mix((run[ends] - run[starts]) * powers(len(values) + 1, "down")[starts] + (ends - starts).astype(U64))


def combine(*columns: np.ndarray) -> np.ndarray:
    """One hash for each tuple of hashes; the order of the columns counts."""
    out = columns[0]
    for col in columns[1:]:
        out = mix(out * U64(0xD6E8FEB86659FD93) + col)
    return out


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of n + 1) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type not in (pa.string(), pa.binary(), pa.large_string(), pa.large_binary()):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if column.type in (pa.large_string(), pa.large_binary()) else np.int32
    _, offs, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` text bytes, one row at least."""
    _, offsets = string_parts(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, min(end, n) - at)
        at = end


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each document: n + 1) of maximal runs of other bytes, cut at document ends."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~space[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    end = np.empty(n, bool)
    end[-1] = word[-1]
    end[:-1] = word[:-1] & ~word[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    start[inner] = word[inner]
    end[inner - 1] = word[inner - 1]
    starts = np.flatnonzero(start)
    ends = np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True, space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(a hash for each word, words before each document: n + 1)."""
    starts, ends, before = word_spans(data, offsets, space)
    return span_hashes((BYTE_VALUE_LOWER if lower else BYTE_VALUE)[data], starts, ends), before


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All of starts[i] .. starts[i] + lengths[i] - 1, one after another."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def shingle_hashes(words: np.ndarray, before: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of k consecutive words, shingles before each group); a group of 1 to k - 1 words has one shingle: all of it."""
    counts = np.diff(before)
    number = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    starts = ranges(before[:-1], number)
    lengths = np.repeat(np.minimum(counts, k), number)
    return span_hashes(words, starts, starts + lengths), np.concatenate(([0], np.cumsum(number)))


def count_sorted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, index of the first row of each, summed weights)."""
    if not len(keys):
        return keys, np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    if weights is None:
        total = np.diff(np.append(first, len(keys)))
    else:
        total = np.add.reduceat(weights[order], first)
    return ordered[first], order[first], total

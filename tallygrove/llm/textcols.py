"""Whole text columns as numpy arrays: words, word hashes and n-grams of many documents at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
PIECE_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


#: A random value for each byte, and the odd base of the rolling hash with its inverse modulo 2**64.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64, at least n of them."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), np.uint64(base))
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have


def forget() -> None:
    """Lets go of the powers that are kept."""
    _powers.clear()


def lowered() -> np.ndarray:
    """Byte table that lower-cases A-Z and leaves all else."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = lowered()
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: What separates words that hold letters and digits only; any byte of a non-ASCII character belongs to a word.
MARKS = np.ones(256, bool)
MARKS[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array, and where each begins (one entry more than texts); null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, name: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts hold about `most` bytes, one document at least."""
    if not batch.num_rows:
        return
    _, at = utf8(batch.column(batch.schema.get_field_index(name)))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, "right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def words(data: np.ndarray, at: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word, and for each document how many words come before it (one entry more)."""
    n = len(data)
    inside = ~separators[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last[:-1] &= ~inside[1:] | edge[1:n]
    begins = np.flatnonzero(first)
    return begins, np.flatnonzero(last) + 1, np.searchsorted(begins, at)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """C with C[e] - C[b] = sum of value(data[i]) * BASE**i over b <= i < e."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(BASE, len(data))[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, the same wherever the span lies."""
    return mix((prefix[ends] - prefix[begins]) * powers(INVERSE, len(prefix))[begins])


def shingles(hashes: np.ndarray, before: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every k consecutive words, and for each document how many shingles come before it.

    A document with fewer than k words, but not none, has its whole sequence as its one shingle.
    """
    factors = mix(np.arange(11, 12 + k, dtype=np.uint64)) | np.uint64(1)
    counts = np.diff(before)
    many = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    ends = np.zeros(len(many) + 1, np.int64)
    np.cumsum(many, out=ends[1:])
    start = np.repeat(before[:-1] - ends[:-1], many) + np.arange(ends[-1])
    out = np.zeros(ends[-1], np.uint64)
    size = np.repeat(np.minimum(counts, k), many)
    for i in range(k):
        here = size > i
        at = np.minimum(start + i, max(len(hashes) - 1, 0))
        out += np.where(here, hashes[at] if len(hashes) else np.uint64(0), np.uint64(0)) * factors[i]
    out += size.astype(np.uint64) * factors[k]
    return mix(out), ends


def distinct_in_documents(values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct values in ascending order, and how many come before each document."""
    if not len(values):
        return values, np.zeros(len(ends), np.int64)
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(ends)))

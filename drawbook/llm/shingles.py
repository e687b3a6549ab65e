"""Words and word shingles of Arrow text columns as 64-bit hashes, computed on whole buffers with numpy.

A word is a run of bytes other than space and 0x09-0x0D; A-Z count as a-z. Two different shingles share a hash with a
chance of 2**-64; everything else is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
_random = np.random.default_rng(20240101)
_letters = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
RAW_LETTERS = _letters.copy()
LOWER_LETTERS = _letters.copy()
LOWER_LETTERS[65:91] = _letters[97:123]
PLACES = _random.integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def forget_powers() -> None:
    """Free the tables of powers; the next text makes them again."""
    _powers.clear()


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n > CHUNK_BYTES + 1:
            return have  # not kept: a single very long text
        _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray, letters: np.ndarray) -> np.ndarray:
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(letters[data] * powers(_P, len(data))[: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of the bytes behind ``prefix``; equal bytes give equal hashes wherever they stand."""
    at = powers(_P_INVERSE, len(prefix))[starts]
    return mix((prefix[ends] - prefix[starts]) * at + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about ``size`` bytes."""
    data, offsets = text_buffers(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, end, data[offsets[first]: offsets[end]], offsets[first: end + 1] - offsets[first]
        first = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document of every word."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    gap = SEPARATOR[data]
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, gap[:-1]
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, gap[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = True
    after[inner - 1] = True
    starts, ends = np.flatnonzero(before & ~gap), np.flatnonzero(after & ~gap) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, end to end, and the bounds of the documents.

    A document of fewer than ``width`` words has its whole sequence as its one shingle, one without words has none.
    """
    documents = len(offsets) - 1
    starts, ends, owner = word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(documents + 1, np.int64)
    words = span_hashes(prefix_hash(data, LOWER_LETTERS), starts, ends)
    counts = np.bincount(owner, minlength=documents)
    first = np.concatenate([[0], np.cumsum(counts)])
    full = max(0, len(words) - width + 1)
    hashes = np.zeros(full, np.uint64)
    for k in range(width):
        hashes += words[k: k + full] * PLACES[k]
    hashes = mix(hashes)
    inside = owner[:full] == owner[width - 1: width - 1 + full]
    hashes, holder = hashes[inside], owner[:full][inside]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = np.array([int((words[first[d]: first[d + 1]] * PLACES[: counts[d]]).sum(dtype=np.uint64)) for d in short], np.uint64)
        extra = mix(extra + counts[short].astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        order = np.argsort(np.concatenate([holder, short]), kind="stable")
        hashes, holder = np.concatenate([hashes, extra])[order], np.concatenate([holder, short])[order]
    bounds = np.searchsorted(holder, np.arange(documents + 1))
    for d in range(documents):
        hashes[bounds[d]: bounds[d + 1]].sort()
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (holder[1:] != holder[:-1])
    return hashes[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]

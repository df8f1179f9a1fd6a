"""Whole texts as byte blocks in numpy: words, hashes and shingles for many rows at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19
_SEED = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_blocks(texts: pa.Array, limit: int = BLOCK_BYTES
                ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets in them): runs of rows of about ``limit`` bytes.

    A row is never cut: a longer text is a block of its own. A null text is an empty one.
    """
    column = texts.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    _, starts, data = column.buffers()
    offsets = np.frombuffer(starts, np.int64)[column.offset:column.offset + n + 1]
    values = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1
        high = min(n, max(high, low + 1))
        yield low, high, values[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
        low = high


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base and of its inverse modulo 2**64."""
    if len(_powers["up"]) <= n:
        for name, factor in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n + n // 2 + 1, factor)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running hash: entry i covers the first i bytes."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:len(data)], out=out[1:])
    return out


def span_hash(running: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans, independent of where they stand."""
    _, down = powers(len(running))
    return mix((running[end] - running[start]) * down[start] + (end - start).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the number of words before each row (rows + 1 entries)."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~separator[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside & (~before | cut))
    ends = np.flatnonzero(before & (~inside | cut))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE
                ) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word (A-Z lowered), and the number of words before each row."""
    data = LOWER[data]
    starts, ends, firsts = word_spans(data, offsets, separator)
    return span_hash(prefix_hash(data), starts, ends), firsts


def shingle_sets(words: np.ndarray, firsts: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles.

    A row with fewer words gives one hash of the whole sequence, one without words none.
    """
    weights = [np.uint64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64)) for i in range(k)]
    n = len(words)
    rolled = np.zeros(max(0, n - k + 1), np.uint64)
    for i in range(k):
        rolled += words[i:n - k + 1 + i] * weights[i]
    rolled = mix(rolled)
    out = []
    for low, high in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if high - low >= k:
            out.append(np.unique(rolled[low:high - k + 1]))
        elif high > low:
            short = words[low:high] * np.array(weights[:high - low], np.uint64)
            out.append(mix(np.array([short.sum(dtype=np.uint64) + np.uint64(high - low)])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out

"""Texts of an Arrow batch as flat numpy arrays: bytes, words, hashes of word windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once; a longer text is a piece of its own.
PIECE = 1 << 19
U64 = np.uint64
#: Odd multipliers of the rolling hashes.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F

IS_GAP = np.zeros(256, bool)
IS_GAP[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts have at most ``limit`` bytes, but one text at least."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto, at = np.cumsum(size), 0
        while at < len(size):
            done = upto[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(upto, done + limit, "right")))
            yield batch.slice(at, end - at)
            at = end


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the words' offsets by text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    gap = IS_GAP[data]
    after = np.empty(len(data), bool)
    after[0], after[1:] = True, gap[:-1]
    after[off[:-1][off[:-1] < len(data)]] = True
    before = np.empty(len(data), bool)
    before[-1], before[:-1] = True, gap[1:]
    before[off[1:][off[1:] > 0] - 1] = True
    word = ~gap
    start, end = np.flatnonzero(word & after), np.flatnonzero(word & before) + 1
    return start, end, np.searchsorted(start, off)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit over all."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**i modulo 2**64 for i below n; of its inverse, if asked."""
    held = _powers.get((base, inverse))
    if held is None or len(held) < n:
        x = pow(base, -1, 1 << 64) if inverse else base
        held = np.full(max(n, 1 << 16), x, U64)
        held[0] = 1
        held = np.multiply.accumulate(held)
        if len(held) <= 1 << 24:
            _powers[(base, inverse)] = held
    return held[:n]


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values * base**i, one longer than the values."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end] for many spans: depends on the values alone, not on where they stand."""
    inv = powers(base, len(sums), True)
    return (sums[end] - sums[start]) * inv[start]


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: its groups of eight bytes, each spread together with its place, summed and spread again.

    No sum of powers: long words that are built to cancel modulo 2**64 differ like any others.
    """
    if not len(start):
        return np.zeros(0, U64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray(len(data) + 1, "<u8", buffer=padded.data, strides=(1,))
    size = end - start
    n = (size + 7) >> 3
    place = ranges(n)
    left = np.minimum(np.repeat(size, n) - 8 * place, 8).astype(U64)
    value = lanes[np.repeat(start, n) + 8 * place] & (U64(0xFFFFFFFFFFFFFFFF) >> (U64(64) - U64(8) * left))
    spread = mix(mix(value ^ U64(BYTE_BASE)) + place.astype(U64) * U64(WORD_BASE))
    return mix(np.add.reduceat(spread, np.cumsum(n) - n) + size.astype(U64) * U64(WORD_BASE))


def ranges(count: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """first[i], first[i]+1, ... count[i] times, for all i in a row."""
    count = count.astype(np.int64)
    ends = np.cumsum(count)
    out = np.arange(ends[-1] if len(ends) else 0)
    shift = (np.zeros(len(count), np.int64) if first is None else first) - (ends - count)
    return out + np.repeat(shift, count)


def windows(word_off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows of n words inside one text, and the windows' offsets by text."""
    count = np.maximum(np.diff(word_off) - n + 1, 0)
    return ranges(count, word_off[:-1]), np.concatenate([[0], np.cumsum(count)])


def window_hashes(words: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Hash of n words in a row, from the words' hashes."""
    return mix(span_hash(prefix(words, WORD_BASE), first, first + n, WORD_BASE))


def joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with one space after each, and where each word starts there."""
    size = end - start
    at = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(at[-1], 32, np.uint8)
    out[ranges(size, at[:-1])] = data[ranges(size, start)]
    return out, at

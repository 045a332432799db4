"""Vectorised words, shingles and hashes over the bytes of Arrow text columns.

A word is a run of bytes other than space and ``\\t\\n\\v\\f\\r``; ``A-Z`` is lower-cased first. All hashes are 64 bit and
depend on the word bytes only, so the same words give the same hash in every task, file and run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK = 1 << 16  #: bytes hashed at a time: their 64-bit numbers stay in a core's cache
POWERS = 1 << 21  #: powers that are remembered
ROWS = 1 << 21  #: bytes of text handled at a time by callers that slice batches

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers (a bijection)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse modulo 2**64, for i up to n."""
    known = _POWERS.get(base)
    if known is None or len(known[0]) <= n:
        size = max(n + 1, 1 << 16)
        up, down = np.full(size, base, _U), np.full(size, pow(base, -1, 1 << 64), _U)
        up[0] = down[0] = 1
        known = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size <= POWERS:
            _POWERS[base] = known
    return known


def run_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of ``values[start:end]`` for every pair of ends; equal runs have equal hashes wherever they stand."""
    up, down = _powers(_BASES[seed], len(values))
    total = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up[: len(values)], out=total[1:])
    length = (ends - starts).astype(_U)
    return mix((total[ends] - total[starts]) * down[starts] + length * _U(0xD6E8FEB86659FD93))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = ROWS):
    """Parts of a batch with about ``limit`` bytes of text each, a longer row alone."""
    sizes = np.diff(text_bytes(batch.column(column))[1])
    lo = size = 0
    for i, n in enumerate(sizes):
        if i > lo and size + n > limit:
            yield batch.slice(lo, i - lo)
            lo, size = i, 0
        size += n
    if lo < batch.num_rows:
        yield batch.slice(lo)


def lowered(data: np.ndarray) -> np.ndarray:
    return data | (((data - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5))


def separators(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True):
    """Start, end and hash of every word, and the first word of every row (one more entry than rows).

    Offsets cut words: a word never reaches over the border of two rows.
    """
    n = len(data)
    if lower:
        data = lowered(data)
    word = ~separators(data)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before, after = np.ones(n, bool), np.ones(n, bool)
    if n:
        before[1:] = ~word[:-1]
        after[:-1] = ~word[1:]
    starts = np.flatnonzero(word & (before | cut[:n]))
    ends = np.flatnonzero(word & (after | cut[1:])) + 1
    hashes = np.empty(len(starts), _U)
    i = 0
    while i < len(starts):  # blocks of whole words, so that memory does not grow with the text
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        hashes[i:j] = run_hash(data[lo:hi].astype(_U) + _U(1), starts[i:j] - lo, ends[i:j] - lo)
        i = j
    return starts, ends, hashes, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, first: np.ndarray, size: int):
    """Hashes of all runs of ``size`` words of each row, and each row's first; fewer words give one run of them all."""
    if size == 1:  # words as they are
        return hashes, first
    counts = np.diff(first)
    runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    border = np.concatenate([[0], np.cumsum(runs)])
    row = np.repeat(np.arange(len(counts)), runs)
    starts = first[row] + (np.arange(border[-1]) - border[row])
    ends = np.minimum(starts + size, first[row + 1])
    out = np.empty(len(starts), _U)
    for lo in range(0, len(starts), BLOCK):
        s, e = starts[lo : lo + BLOCK], ends[lo : lo + BLOCK]
        out[lo : lo + BLOCK] = run_hash(hashes[s[0] : e[-1]], s - s[0], e - s[0])
    return out, border


def set_print(values: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set of distinct hashes, as two signed numbers."""
    a = int(np.bitwise_xor.reduce(mix(values + _U(_BASES[0])))) if len(values) else 0
    b = int(np.add.reduce(mix(values + _U(_BASES[1])))) if len(values) else 0
    return a - (1 << 64) * (a >> 63), b - (1 << 64) * (b >> 63)

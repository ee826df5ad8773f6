"""Whole texts of Arrow batches as numpy arrays: words, their hashes, k-gram hashes and window minima.

Work goes on in chunks of about CHUNK bytes of text, so memory follows the longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
POSITION_BITS = 28

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def u64(x: int) -> np.uint64:
    return np.uint64(x & (2**64 - 1))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; base is odd."""
    usual = 2 * CHUNK  # kept; more, for a very long text, is made anew each time
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size, inverse = max(n, usual), pow(base, -1, 2**64)
        have = tuple(np.concatenate(([u64(1)], np.cumprod(np.full(size - 1, b, np.uint64)))) for b in (base, inverse))
        if size == usual:
            _POWERS[base] = have
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit."""
    x = x ^ u64(salt)
    x ^= x >> np.uint64(32)
    x *= u64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= u64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0 or column.buffers()[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at.astype(np.int64)


def chunks(column: pa.Array, limit: int = CHUNK, rows: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row starts): each row's bytes are followed by one space, which ends its last word.

    A chunk has ``limit`` bytes at most, or one row, and ``rows`` rows at most.
    """
    data, at = raw(column)
    i, n = 0, len(column)
    while i < n:
        j = min(max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1), i + rows)
        starts = at[i : j + 1] - at[i] + np.arange(j - i + 1)
        out = np.full(int(at[j] - at[i]) + j - i, 32, np.uint8)
        mask = np.ones(len(out), bool)
        mask[starts[1:] - 1] = False
        out[mask] = data[at[i] : at[j]]
        yield i, j, out, starts
        i = j


class Words:
    """The words of one chunk; ``letters`` says for each byte value whether it belongs to a word."""

    def __init__(self, data: np.ndarray, row_starts: np.ndarray, letters: np.ndarray):
        inside = letters[data]
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        self.starts = np.flatnonzero(inside & ~before)
        ends = ~inside & before
        self.ends = np.flatnonzero(ends)
        self.row = np.searchsorted(row_starts, self.starts, side="right") - 1
        self.n_rows = len(row_starts) - 1
        self.first = np.searchsorted(self.row, np.arange(self.n_rows + 1))
        self.data, self._kept = data, inside | ends
        self._ends = ends

    def __len__(self) -> int:
        return len(self.starts)

    def compact(self) -> tuple[np.ndarray, np.ndarray]:
        """The words with one space after each, and where each begins (with the end as last value)."""
        spaced = np.where(self._ends, np.uint8(32), self.data)[self._kept]
        return spaced, np.concatenate(([0], np.cumsum(self.ends - self.starts + 1)))

    def hashes(self, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
        """64 bits for each word."""
        up, down = powers(base, len(self.data) + 1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((self.data.astype(np.uint64) + u64(1)) * up[:-1])))
        return mix((total[self.ends] - total[self.starts]) * down[self.starts])


def gram_hashes(items: np.ndarray, k: int, base: int = 0xC2B2AE3D27D4EB4F) -> np.ndarray:
    """A hash of the k consecutive values from each position on; len(items) - k + 1 of them, or none."""
    n = len(items)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = powers(base, n + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(items * up[:n])))
    return mix((total[k:] - total[:-k]) * down[: n - k + 1], k)


def window_minima(grams: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` grams, the position of its smallest one; of equal ones, the last.

    Equal runs choose equal offsets.
    """
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    mask = (1 << POSITION_BITS) - 1
    at = np.arange(len(grams), dtype=np.uint64)
    low = (grams & u64(~mask)) | (u64(mask) - (at & u64(mask)))
    size = 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[:n], low[width - size : width - size + n])
    s = np.arange(n, dtype=np.int64)
    return s + ((mask - (low & u64(mask)).astype(np.int64) - s) & mask)


def letters(allowed: range | list[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(allowed)] = True
    return out


#: Words that white space ends: every byte but space and \x09-\x0D.
NOT_SPACE = letters([b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D])
#: Words of letters and digits after lower-casing A-Z: 0-9, a-z and all that is not ASCII.
ALNUM = letters([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in any [start, start + length)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + lengths, n), -1)
    return np.cumsum(edge[:-1]) > 0


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of True."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    starts = np.flatnonzero(edge == 1)
    return starts, np.flatnonzero(edge == -1) - starts

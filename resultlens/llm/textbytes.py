"""Words, hashes and lines of many texts at once, over the UTF-8 bytes of Arrow string columns in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd, so it has an inverse modulo 2**64.
BASE = U(0x9E3779B97F4A7C15)
BASE_INV = U(pow(int(BASE), -1, 1 << 64))
#: Texts are taken in blocks of about so many bytes; a longer text is a block of its own.
BLOCK = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i in 0..n."""
    if len(_powers[0]) <= n:
        size = max(n + 1, BLOCK + (1 << 16))
        for k, b in enumerate((BASE, BASE_INV)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][: n + 1], _powers[1][: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64 if wide else np.int32, len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts."""
    data, at = text_buffer(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        j = min(j, n, i + 20_000)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that do not cross a text's border."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def owners(starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Index of the text that each position lies in."""
    return np.searchsorted(at, starts, "right") - 1


def prefix_hash(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * up[:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end], by content and length."""
    _, down = powers(len(prefix) - 1)
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the number of the first word of each text (n + 1)."""
    starts, ends = runs(~SPACE[data], at)
    return starts, ends, np.searchsorted(starts, at)


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k words in a row and the text of each; a text of fewer words (but one at least) gives its whole sequence as one."""
    count = np.diff(first)
    n = len(h)
    out = np.zeros(max(0, n - k + 1), np.uint64)
    for i in range(k):
        out += h[i : n - k + 1 + i] * powers(k)[0][i + 1]
    owner = np.repeat(np.arange(len(count)), count)
    whole = np.flatnonzero(owner[: len(out)] == owner[k - 1 :]) if n >= k else np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < k))
    extra = np.zeros(len(short), np.uint64)
    for i in range(k - 1):
        has = count[short] > i
        extra[has] += h[first[short[has]] + i] * powers(k)[0][i + 1]
    extra += count[short].astype(np.uint64) * U(0xA0761D6478BD642F)
    return np.concatenate([mix(out[whole]), mix(extra)]), np.concatenate([owner[whole], short])

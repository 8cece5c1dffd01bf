"""Suffix arrays, common prefixes, anchors and window fingerprints over bytes, in numpy."""

from __future__ import annotations

import numpy as np

from .textbytes import BYTE_VALUE, U, mix, powers, prefix_hash

SECOND = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
#: Low bits of a sliding key that hold the position: as many as a column of texts can have bytes. What is left of the hash orders the grams of a window; among equals the first is least, in every copy of it.
PLACE = 31


def words8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, big-endian; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out |= padded[k : len(data) + k] << U(56 - 8 * k)
    return out


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by their next `depth` bytes at least, equal ones by position.

    Larsson-Sadakane: groups of equal prefix are refined by the ranks h positions on, h doubling; groups of one are done."""
    n = len(data)
    key = words8(data)
    sa = np.argsort(key)
    ordered = key[sa]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.zeros(n + 1, np.int64)  # of the position after the end: 0, below all others
    rank[sa] = start + 1
    h = 8
    while h < depth:
        alone = new & np.append(new[1:], True)
        left = np.flatnonzero(~alone)
        if not len(left):
            break
        sub = sa[left]
        key = rank[sub] * (n + 1) + rank[np.minimum(sub + h, n)]
        order = np.argsort(key)
        sa[left] = sub = sub[order]
        key = key[order]
        fresh = np.ones(len(left), bool)
        fresh[1:] = key[1:] != key[:-1]
        new[left] = fresh
        rank[sub] = np.maximum.accumulate(np.where(fresh, left, 0)) + 1
        h *= 2
    return sa[np.argsort(rank[sa] * n + sa)] if n else sa


def common_prefixes(data: np.ndarray, sa: np.ndarray, enough: int) -> np.ndarray:
    """Longest common prefix of each suffix in sa with the one before it (the first: 0), exact wherever it matters whether it reaches `enough`.

    Kasai: going through the text, the prefix shared with the predecessor shrinks by one at most. Where the predecessor moves on along with the
    position it shrinks by exactly one, so bytes are compared only where it does not, for all such positions at once."""
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    key = words8(data)
    out = np.zeros(n, np.int64)
    has = before >= 0
    head = has.copy()
    head[1:] &= ~(has[:-1] & (before[1:] == before[:-1] + 1))
    while True:
        p = np.flatnonzero(head)
        if not len(p):
            break
        # how far the run that a head starts goes, so how long a prefix can matter
        ends = np.flatnonzero(np.append(head | ~has, True))
        length = ends[np.searchsorted(ends, p, "right")] - p
        most = np.minimum(length + enough + 8, n - np.maximum(p, before[p]))
        same = np.zeros(len(p), np.int64)
        live = np.arange(len(p))
        while len(live):
            x, y = p[live] + same[live], before[p[live]] + same[live]
            inside = same[live] < most[live]
            x, y = np.minimum(x, n - 1), np.minimum(y, n - 1)
            differ = key[x] ^ key[y]
            equal = inside & (differ == 0)
            stop = live[~equal]
            d = differ[~equal]
            lead = np.zeros(len(stop), np.int64)
            for k in range(1, 8):
                lead += (d >> U(64 - 8 * k)) == 0
            same[stop] = np.minimum(same[stop] + np.where(inside[~equal], lead, 0), most[stop])
            same[live[equal]] += 8
            live = live[equal]
        same = np.minimum(same, most)
        run = np.repeat(same, length) - (np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length))
        where = np.repeat(p, length) + (np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length))
        out[where] = np.maximum(run, 0)
        head = np.zeros(n, bool)
        head[where[run < 0]] = True  # nothing was left to shrink: compare anew
    return out[sa]


def anchors(data: np.ndarray, at: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of `size` bytes within a text: its start and its anchor's position (the gram of least hash in it, by content alone); and the hashes of all grams."""
    n = len(data)
    prefix = prefix_hash(data)
    _, down = powers(n)
    m = max(0, n - gram + 1)
    g = mix((prefix[gram:] - prefix[:m]) * down[:m]) if m else np.zeros(0, np.uint64)
    count = np.maximum(np.diff(at) - size + 1, 0)
    starts = np.repeat(at[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    if not len(starts):
        return starts, starts, g
    w = size - gram + 1
    key = (g >> U(PLACE) << U(PLACE)) | np.arange(m, dtype=np.uint64)
    rows = -(-m // w)
    square = np.full(rows * w, ~U(0))
    square[:m] = key
    square = square.reshape(rows, w)
    ahead = np.minimum.accumulate(square, 1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], 1)[:, ::-1].ravel()
    best = np.minimum(behind[starts], ahead[starts + w - 1])
    return starts, (best & U((1 << PLACE) - 1)).astype(np.int64), g


def fingerprints(data: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the windows."""
    up, down = powers(len(data))
    out = []
    for values in (BYTE_VALUE, SECOND):
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * up[:-1], out=prefix[1:])
        out.append(mix((prefix[starts + size] - prefix[starts]) * down[starts]))
    return out[0], out[1]


def stretches(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of the runs of consecutive numbers in sorted, distinct x."""
    if not len(x):
        return x, x
    cut = np.flatnonzero(np.diff(x) != 1)
    return x[np.concatenate([[0], cut + 1])], x[np.concatenate([cut, [len(x) - 1]])]

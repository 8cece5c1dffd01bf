"""A block of probes against a block of vectors, as matrices: the nearest rows and the greatest cosines.

A matrix product finds, within its error bound, which pairs can be among the best; only these are evaluated, component by component in double as the column functions do, so results are theirs to the last bit. Memory is that of the two
blocks and of `CELLS` products at a time. A vector that is null, holds null or has another length than the probe's has no distance (such rows come last) and a cosine of 0."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .vectors import TINY

#: Products at a time, pairs evaluated at a time, and columns of which one minimum is taken.
CELLS, PAIRS, GROUP = 4_000_000, 65_536, 64


def by_length(column: Any) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The places and the matrix of the vectors of each length, in order; those that are null or hold null are left out."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(pc.fill_null(pc.list_value_length(a), -1).to_numpy(zero_copy_only=False), np.int64)
    flat, held = a.flatten(), np.maximum(lengths, 0)
    starts, values, whole = np.cumsum(held) - held, flat.to_numpy(zero_copy_only=False).astype(float), lengths >= 0
    if flat.null_count:
        whole[np.repeat(np.arange(len(a)), held)[flat.is_null().to_numpy(zero_copy_only=False)]] = False
    found = {}
    for n in np.unique(lengths[whole]).tolist():
        at = np.flatnonzero(whole & (lengths == n))
        found[n] = at, values[starts[at][:, None] + np.arange(n)]
    return found


def codes(*columns: Any) -> list[np.ndarray]:
    """Values of all columns as numbers, equal ones alike; null is -1."""
    known: dict[Any, int] = {None: -1}
    return [np.array([known.setdefault(v, len(known)) for v in c.to_pylist()], np.int64) for c in columns]


def _allowed(scope: str, p: np.ndarray, m: np.ndarray) -> np.ndarray:
    if scope == "any":
        return np.ones((len(p), len(m)), bool)
    known = (p >= 0)[:, None] & (m >= 0)
    return known & ((p[:, None] == m) if scope == "same" else (p[:, None] != m))


def _in_turn(terms: np.ndarray) -> np.ndarray:
    """Sums of rows, from the first component to the last."""
    return np.cumsum(terms, axis=1)[:, -1] if terms.shape[1] else np.zeros(len(terms))


def _slices(x: np.ndarray, y: np.ndarray) -> Iterator[slice]:
    step = max(1, CELLS // max(1, len(y)))
    return (slice(k, k + step) for k in range(0, len(x), step))


def _firsts(keys: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the first k of their key."""
    order = np.argsort(keys, kind="stable")
    begins = np.r_[True, keys[order][1:] != keys[order][:-1]] if len(keys) else np.zeros(0, bool)
    out = np.zeros(len(keys), bool)
    out[order] = np.arange(len(keys)) - np.maximum.accumulate(np.where(begins, np.arange(len(keys)), 0)) < k
    return out


def _alike(y: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """A number for each row that copies of one kind share."""
    rows = np.ascontiguousarray(np.column_stack([y, kinds.astype(float)]))
    return np.unique(rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1])))[:, 0], return_inverse=True)[1].ravel()


def nearest_rows(probes: Any, probe_kinds: np.ndarray, vectors: Any, kinds: np.ndarray, k: int, scope: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of probes and of vectors, squared distances and which of these are none: at least the k nearest of each probe in its scope, ties to the vector that is first."""
    mine, theirs, some = by_length(probes), by_length(vectors), {}
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n_found = np.zeros(len(probes), np.int64)
    for n, (p_at, x) in mine.items():
        m_at, y = theirs.get(n, (np.zeros(0, np.int64), np.zeros((0, n))))
        some[n] = m_at
        few = _firsts(_alike(y, kinds[m_at]), k)  # no more than k copies of a vector in a database can be among the nearest
        m_at, y = m_at[few], y[few]
        for s in _slices(x, y):
            i, j, d = _least(x[s], y, None if scope == "any" else _allowed(scope, probe_kinds[p_at[s]], kinds[m_at]), k)
            n_found[p_at[s]] = np.bincount(i, minlength=len(x[s]))
            out.append((p_at[s][i], m_at[j], d))
    # rows without a distance, where others are too few
    length = np.full(len(probes), -1)
    for n, (p_at, _) in mine.items():
        length[p_at] = n
    i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    lacking = np.flatnonzero(n_found < k)
    for n, kind in sorted(set(zip(length[lacking].tolist(), probe_kinds[lacking].tolist(), strict=True))):
        rest = np.setdiff1d(np.arange(len(vectors)), some.get(n, np.zeros(0, np.int64)), assume_unique=True)
        rest = rest[_allowed(scope, np.array([kind]), kinds[rest])[0]][:k]
        own = lacking[(length[lacking] == n) & (probe_kinds[lacking] == kind)]
        i.append(np.repeat(own, len(rest)))
        j.append(np.tile(rest, len(own)))
    none = sum(map(len, i))
    i, j = np.concatenate([*(o[0] for o in out), *i]), np.concatenate([*(o[1] for o in out), *j])
    return i, j, np.concatenate([*(o[2] for o in out), np.zeros(none)]), np.arange(len(i)) >= len(i) - none


def _at_least_kth(rough: np.ndarray, k: int) -> np.ndarray:
    """A bound of each row that k of its values do not exceed: the k-th of the minima of groups of columns, so a row is passed over once and only the minima are ordered. Values that are no numbers count last."""
    wide = rough.shape[1] // GROUP
    if wide >= k:
        rough = np.fmin.reduce(rough[:, : wide * GROUP].reshape(len(rough), GROUP, wide), axis=1)
    return np.partition(rough, k - 1, axis=1)[:, k - 1]


@np.errstate(all="ignore")
def _least(x: np.ndarray, y: np.ndarray, allowed: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """allowed: which pairs count; None: all."""
    if len(y) > k:
        own, other = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
        rough = x @ y.T
        rough *= -2
        rough += other
        rough += own[:, None]
        if allowed is not None:
            rough[~allowed] = np.inf
        error = 4 * (x.shape[1] + 8) * np.finfo(float).eps * (own + other[np.isfinite(other)].max(initial=0))
        near = ~(rough > (_at_least_kth(rough, k) + 2 * error)[:, None])  # where there is no number, the pair is evaluated
        i, j = np.nonzero(near if allowed is None else near & allowed)
    else:
        i, j = np.nonzero(np.ones((len(x), len(y)), bool) if allowed is None else allowed)
    d = np.zeros(len(i))
    for at in range(0, len(i), PAIRS):
        gap = x[i[at : at + PAIRS]] - y[j[at : at + PAIRS]]
        d[at : at + PAIRS] = _in_turn(gap * gap)
    order = np.lexsort((j, d, i))  # not a number comes last
    i, j, d = i[order], j[order], d[order]
    first = _firsts(i, k)
    return i[first], j[first], d[first]


@np.errstate(all="ignore")
def greatest_cosines(probes: Any, vectors: Any) -> np.ndarray:
    """The greatest cosine of each probe with any of the vectors, of which there is one at least."""
    theirs, best = by_length(vectors), np.full(len(probes), -np.inf)
    for n, (p_at, x) in by_length(probes).items():
        y = theirs.get(n, (None, np.zeros((0, n))))[1]
        if len(y) < len(vectors):
            best[p_at] = 0
        y = y[_firsts(_alike(y, np.zeros(len(y))), 1)]
        if not len(y):
            continue
        own, other = np.sqrt(_in_turn(x * x)), np.sqrt(_in_turn(y * y))
        unit = np.where((other < TINY)[:, None], 0, y / other[:, None])
        for s in _slices(x, y):
            rough = np.where((own[s] < TINY)[:, None], 0, x[s] / own[s][:, None]) @ unit.T
            rough[np.isnan(rough)] = 0
            i, j = np.nonzero(rough >= (rough.max(1) - 8 * (n + 8) * np.finfo(float).eps)[:, None])
            for at in range(0, len(i), PAIRS):
                a, b = i[at : at + PAIRS], j[at : at + PAIRS]
                length = own[s][a] * other[b]
                value = np.where((own[s][a] < TINY) | (other[b] < TINY), 0, _in_turn(x[s][a] * y[b]) / length)
                np.maximum.at(best, p_at[s][a], np.nan_to_num(value, nan=0.0))
    return np.where(np.isneginf(best), 0, best)  # a probe without a vector

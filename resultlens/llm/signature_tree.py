"""Signature trees over token sets: nodes hold OR-combined token bitmaps and size ranges; dual traversal links sets of high Jaccard similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

FAN = 8
#: Words of bitmaps that one vectorised step may compare, and pairs of nodes that are opened at once.
STEP, OPEN = 1 << 19, 2048
#: Found pairs that are joined before the others are looked at again.
JOIN = 2048


def bitmap_width(n: np.ndarray) -> np.ndarray:
    """Bits for sets of n tokens: a power of two, twice the size at least."""
    return np.clip(1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64), 64, 1 << 17)


class Groups:
    """Groups of 0..n-1 in which whole arrays of labels can be read; items of equal label are together from the start."""

    def __init__(self, label: np.ndarray) -> None:
        self.label = np.unique(label, return_inverse=True)[1].astype(np.int64)

    def join(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """Join pairs; those that joined two groups come back."""
        used = []
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = self.label[x], self.label[y]
            if p != q:
                self.label[self.label == max(p, q)] = min(p, q)
                used.append((x, y))
        return used


class SignatureTree:
    """Sets of one bitmap width: `bits` is a matrix of 64-bit words, `size` the number of tokens, `spare` the tokens that share their bit with another of the set."""

    def __init__(self, bits: np.ndarray, size: np.ndarray, spare: np.ndarray) -> None:
        self.levels = [(bits, size, size, spare)]  # OR of bitmaps, least and largest size, most spare
        while len(self.levels[-1][0]) > 1:
            bits, low, high, spare = self.levels[-1]
            at = np.arange(0, len(bits), FAN)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(spare, at)))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def level(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The nodes k levels above the sets, or the root."""
        return self.levels[min(k, len(self.levels) - 1)]

    def folded(self) -> SignatureTree:
        """The same tree with bitmaps of half the width."""
        bits, low, _, _ = self.levels[0]
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
        return SignatureTree(bits, low, low - np.bitwise_count(bits).sum(1, dtype=np.int64))


def reach(top: np.ndarray, low: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether overlaps of `top` can make num / den of the union of sets whose sizes sum to `low`."""
    return den * top >= num * (low - top)


class Traversal:
    """Dual traversal of two trees (or one with itself); of_x and of_y number their sets in `groups`.

    A pair of nodes is dropped when its largest possible overlap can't reach num / den, when its size ranges do not fit, or
    when all sets below both are in one group already. Pairs of sets that may reach it (and pass `check`, if there is one) are joined; `used` has those that joined groups.
    Node pairs are opened depth first, OPEN at a time, so memory is bounded whatever is left to compare."""

    def __init__(self, x: SignatureTree, y: SignatureTree, of_x: np.ndarray, of_y: np.ndarray, groups: Groups, num: int, den: int, check: Callable[[int, int], bool] | None) -> None:
        self.x, self.y, self.of_x, self.of_y, self.groups, self.num, self.den, self.check = x, y, of_x, of_y, groups, num, den, check
        self.used: list[tuple[int, int]] = []

    def possible(self, k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        (p, p_low, p_high, p_spare), (q, q_low, q_high, q_spare) = self.x.level(k), self.y.level(k)
        fits = (self.den * p_high[a] >= self.num * q_low[b]) & (self.den * q_high[b] >= self.num * p_low[a])
        ok = np.flatnonzero(fits)
        step = max(1, STEP // p.shape[1])
        for i in range(0, len(ok), step):
            at = ok[i : i + step]
            u, v = a[at], b[at]
            top = np.bitwise_count(p[u] & q[v]).sum(1, dtype=np.int64) + np.minimum(p_spare[u], q_spare[v])
            top = np.minimum(top, np.minimum(p_high[u], q_high[v]))
            fits[at] = reach(top, p_low[u] + q_low[v], self.num, self.den)
        return fits

    def apart(self, k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of nodes have sets of different groups below them."""
        (low_x, high_x), (low_y, high_y) = (self.spread(t, of, k) for t, of in ((self.x, self.of_x), (self.y, self.of_y)))
        return ~((low_x[a] == high_x[a]) & (low_y[b] == high_y[b]) & (low_x[a] == low_y[b]))

    def spread(self, t: SignatureTree, of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        label, at = self.groups.label[of], np.arange(0, len(of), FAN ** min(k, len(t.levels) - 1))
        return np.minimum.reduceat(label, at), np.maximum.reduceat(label, at)

    def leaves(self, a: np.ndarray, b: np.ndarray) -> int:
        """Join the pairs of sets that may link; how many joined groups."""
        before, label = len(self.used), self.groups.label
        step = max(256, STEP // 4 // self.x.levels[0][0].shape[1])
        for i in range(0, len(a), step):
            p, q = a[i : i + step], b[i : i + step]
            ok = label[self.of_x[p]] != label[self.of_y[q]]
            p, q = p[ok], q[ok]
            if len(p):
                ok = self.possible(0, p, q)
                p, q = self.of_x[p[ok]], self.of_y[q[ok]]
            while len(p):
                if self.check is None:
                    self.used += self.groups.join(p[:JOIN], q[:JOIN])
                else:
                    for u, v in zip(p[:JOIN].tolist(), q[:JOIN].tolist(), strict=True):
                        if label[u] != label[v] and self.check(u, v):
                            self.used += self.groups.join(np.array([u]), np.array([v]))
                p, q = p[JOIN:], q[JOIN:]
                ok = label[p] != label[q]
                p, q = p[ok], q[ok]
        return len(self.used) - before

    def sweep(self) -> None:
        """One set of x against all of y, for as long as that joins many: of a group of near copies little is left to compare."""
        every, rng = np.arange(len(self.y)), np.random.default_rng(len(self.y))
        for k in range(32):
            pivot = 0 if k == 0 else int(rng.integers(len(self.x)))
            if self.leaves(np.full(len(every), pivot), every) < max(2, len(every) // 16):
                break

    def run(self) -> list[tuple[int, int]]:
        x, y = self.x, self.y
        if not len(x) or not len(y) or (x is y and len(x) < 2):
            return self.used
        if len(x) * len(y) > 64:
            self.sweep()
            if x is y:
                rest = np.arange(1, len(x))
                self.leaves(rest - 1, rest)
        stack = [(max(len(x.levels), len(y.levels)) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            k, a, b = stack.pop()
            if k == 0:
                self.leaves(a, b)
                continue
            if len(a) > OPEN:
                stack.append((k, a[OPEN:], b[OPEN:]))
                a, b = a[:OPEN], b[:OPEN]
            ok = self.apart(k, a, b)
            a, b = a[ok], b[ok]
            ok = self.possible(k, a, b)
            stack.append((k - 1, *self.opened(k - 1, a[ok], b[ok])))
        return self.used

    def opened(self, k: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of the children, on level k, of pairs of nodes."""
        x, y = self.x, self.y
        f_x, f_y = FAN if k < len(x.levels) - 1 else 1, FAN if k < len(y.levels) - 1 else 1
        p = (np.repeat(a, f_x * f_y).reshape(-1, f_x, f_y) * f_x + np.arange(f_x)[:, None]).ravel()
        q = (np.repeat(b, f_x * f_y).reshape(-1, f_x, f_y) * f_y + np.arange(f_y)).ravel()
        ok = (p < len(x.level(k)[0])) & (q < len(y.level(k)[0]))
        if x is y:
            ok &= p <= q if k else p < q
        return p[ok], q[ok]


def forest(
    bitmaps: list[np.ndarray], size: np.ndarray, order: np.ndarray, num: int, den: int, check: Callable[[int, int], bool] | None = None, label: np.ndarray | None = None, member: np.ndarray | None = None, within: bool = True
) -> list[tuple[int, int]]:
    """Pairs that connect the sets whose bitmaps (of bitmap_width bits, or all of one width) may overlap enough. `order` brings like sets together in the trees.

    Sets of equal `label` are connected beforehand. Members meet each other (unless `within` is false) and the sets that are no members, those do not meet each other. Thresholds of a
    half at least: sets that link have bitmaps of equal width, or one of twice the other's."""
    n = len(size)
    groups = Groups(np.arange(n) if label is None else label)
    member = np.ones(n, bool) if member is None else member
    width = np.array([len(b) for b in bitmaps])
    trees: dict[tuple[bool, int], tuple[SignatureTree, np.ndarray]] = {}
    for side in (True, False):
        for w in np.unique(width[member == side]).tolist():
            of = np.flatnonzero((width == w) & (member == side))
            of = of[np.argsort(order[of], kind="stable")]
            bits = np.stack([bitmaps[k] for k in of])
            trees[side, w] = SignatureTree(bits, size[of], size[of] - np.bitwise_count(bits).sum(1, dtype=np.int64)), of

    def meetings() -> Iterator[tuple[tuple[bool, int], tuple[bool, int]]]:
        for side, w in trees:
            for other in (True, False):
                if (side and other and within) or side != other:
                    if side:  # members and others of one width meet once
                        yield (side, w), (other, w)
                    yield (side, w), (other, 2 * w)

    used: list[tuple[int, int]] = []
    for first, second in meetings():
        if second not in trees:
            continue
        (x, of_x), (y, of_y), v, w = trees[first], trees[second], second[1], first[1]
        used += Traversal(x, y if v == w else y.folded(), of_x, of_y, groups, num, den, check).run()
    return used

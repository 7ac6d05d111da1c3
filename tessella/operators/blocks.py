"""Numeric core of the block tier: blocks of windows, score tiles, exact winners.

A block's windows are rows of a matrix.  One matrix product of two blocks gives
a score that falls with the distance (two extra columns carry the rules for
missing and constant windows, or the norms in raw mode).  Products are only a
search: every entry within a rounding bound of a row's best is evaluated again
from the differences, which depends on the two windows alone, so
results and exact ties do not depend on block sizes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

from tessella.functions.distance import SNAP
from tessella.plans.planner import tile_rows

EPS, EPS32 = float(np.finfo(np.float64).eps), float(np.finfo(np.float32).eps)
BIG, TINY = 1e18, 1e-280
EXACT_ROWS = 4096
NONE = -1


@dataclass
class Block:
    """Windows first .. first + n - 1 of a series."""

    first: int
    values: np.ndarray  # (n, m) z-normalised, or raw with missing samples as 0
    finite: np.ndarray
    constant: np.ndarray
    normalize: bool

    @property
    def n(self) -> int:
        return len(self.values)

    @property
    def m(self) -> int:
        return self.values.shape[1]

    @cached_property
    def single(self) -> np.ndarray:
        return self.values.astype(np.float32)

    @cached_property
    def flat(self) -> np.ndarray:
        """Windows without variation that the user says are not constant."""
        return ~self.values.any(axis=1) & self.finite & ~self.constant & self.normalize


def znormalise(w: np.ndarray, constant: np.ndarray) -> np.ndarray:
    """Rows centred and divided by their population deviation, each in its own frame.

    The frame (midpoint and largest deviation) keeps tiny and huge units from
    under- or overflowing.  Rows flagged constant, and flat rows, become zeros.
    """
    lo, hi = w.min(axis=1), w.max(axis=1)
    mid = lo + (hi * 0.5 - lo * 0.5)
    c = w - mid[:, None]
    scale = np.abs(c).max(axis=1)
    flat = (lo == hi) | constant | ~(scale > 0)
    c /= np.where(flat, 1.0, scale)[:, None]
    c -= c.mean(axis=1)[:, None]
    sigma = np.sqrt((c * c).mean(axis=1))
    flat |= ~(sigma > 0)
    c /= np.where(flat, 1.0, sigma)[:, None]
    c[flat] = 0.0
    return c


def block(samples: np.ndarray, first: int, m: int, normalize: bool, constant: np.ndarray | None = None, finite: np.ndarray | None = None) -> Block:
    """The block of all windows of ``samples`` (which start at window ``first``).

    ``constant`` and ``finite`` override the detected flags; a window that is
    not finite is never constant.  A window forced finite counts missing
    samples as 0.
    """
    ok = np.isfinite(samples)
    clean = np.where(ok, samples, 0.0)
    w = np.lib.stride_tricks.sliding_window_view(clean, m)
    bad = np.concatenate([[0], np.cumsum(~ok)])
    seen = bad[m:] == bad[:-m]
    fin = seen if finite is None else finite.astype(bool)
    const = (w.min(axis=1) == w.max(axis=1)) & seen if constant is None else constant.astype(bool) & fin & seen
    if normalize:
        z = znormalise(np.where(fin[:, None], w, 0.0), const | ~fin)
        return Block(first, z, fin, const, True)
    return Block(first, np.ascontiguousarray(w), fin, const, False)


def norms(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean norms of the rows of x - y, for any doubles whose result is one.

    A row whose sum of squares leaves the safe range is measured again in units
    of a power of two near its largest difference, which rounds nothing.
    """
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        c = x - y
        total = (c * c).sum(axis=1)
    out = np.sqrt(total)
    odd = np.flatnonzero(~((total > 1e-270) & (total < 1e300)))
    if len(odd):
        # differences of quarters never overflow; only rows near the end of the range need them
        part = np.where(np.isfinite(c[odd]).all(axis=1), 1.0, 0.25)[:, None]
        c = x[odd] * part - y[odd] * part
        largest = np.abs(c).max(axis=1)
        unit = np.exp2(np.floor(np.log2(np.where(largest > 0, largest, 1.0))))
        with np.errstate(over="ignore"):
            out[odd] = np.sqrt(((c / unit[:, None]) ** 2).sum(axis=1)) * unit / part[:, 0]
    return out


def exact(a: Block, b: Block, r: np.ndarray, c: np.ndarray, snap: bool = True) -> np.ndarray:
    """Measures of window pairs by sums of squared differences, with all rules applied.

    A measure orders pairs: the squared distance when normalised (0 to 4m), the
    distance itself when raw, whose square need not be a double.
    """
    out = np.empty(len(r))
    for at in range(0, len(r), EXACT_ROWS):
        x, y = a.values[r[at : at + EXACT_ROWS]], b.values[c[at : at + EXACT_ROWS]]
        if a.normalize:
            x = x - y
            out[at : at + EXACT_ROWS] = (x * x).sum(axis=1)
        else:
            out[at : at + EXACT_ROWS] = norms(x, y)
    if a.normalize:
        if snap:
            out[out < SNAP] = 0.0
        out[a.flat[r] | b.flat[c]] = 2 * a.m  # no correlation with anything
        ca, cb = a.constant[r], b.constant[c]
        out[ca ^ cb] = a.m
        out[ca & cb] = 0.0
    out[~(a.finite[r] & b.finite[c])] = np.inf
    return out


def distances(measure: np.ndarray, normalize: bool) -> np.ndarray:
    """Distances of measures."""
    return np.sqrt(measure) if normalize else measure


def _sides(a: Block, b: Block) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Matrices whose product is the score, its rounding bound, and its unit.

    m - d2/2 when normalised; when raw -d2/2 in units of the power of two near
    the largest deviation from a common middle, so that no product overflows.
    """
    m, unit = a.m, 1.0

    def penal(x: Block) -> np.ndarray:
        return np.where(x.finite, 0.0, -BIG)

    if a.normalize:
        ea, eb = penal(a) + a.constant * (m / 2), penal(b) + b.constant * (m / 2)
        # single precision halves the work of the search; its bound lets some more entries be evaluated again
        va, vb, bound = a.single, b.single, 4 * EPS32 * (m + 6) * (m + 2)
    else:
        shown = [x.values[x.finite] for x in (a, b) if x.finite.any()]
        lo, hi = (min(x.min() for x in shown), max(x.max() for x in shown)) if shown else (0.0, 0.0)
        mid = lo * 0.5 + hi * 0.5
        reach = max(hi * 0.5 - mid * 0.5, mid * 0.5 - lo * 0.5)  # half of it, as the whole may be no double
        unit = np.exp2(np.floor(np.log2(reach))) if reach > 0 else 1.0

        def scaled(x: Block) -> np.ndarray:
            return np.where(x.finite[:, None], (x.values * 0.5 - mid * 0.5) / unit, 0.0)

        va, vb = scaled(a), scaled(b)
        na, nb = (va * va).sum(axis=1), (vb * vb).sum(axis=1)
        ea, eb = penal(a) - na / 2, penal(b) - nb / 2
        bound = 64 * EPS * (m + 2) * max(na.max(initial=0.0), nb.max(initial=0.0), 1e-300)
    kind = va.dtype
    one_a, one_b = np.ones((a.n, 1), kind), np.ones((b.n, 1), kind)
    left, right = np.hstack([va, ea[:, None].astype(kind), one_a]), np.hstack([vb, one_b, eb[:, None].astype(kind)])
    return left, right.T.copy(), bound, unit


def _scored(measure: np.ndarray, a: Block, unit: float) -> np.ndarray:
    """The scores of measures that were evaluated exactly."""
    if a.normalize:
        return a.m - measure / 2
    if unit < TINY:  # halves of the samples need not be doubles
        return np.full(len(measure), -np.inf)
    with np.errstate(over="ignore"):
        return -((measure / unit / 2) ** 2) / 2


def keys(i: np.ndarray, j: np.ndarray, self_join: bool) -> np.ndarray:
    return 2 * np.abs(j - i) + (j > i) if self_join else j


class Best:
    """The k best (d2, key, j) of each window of a block, merged in any order; d2 is any measure (see ``exact``).

    ``at`` has the windows' indices where they are not first, first + 1, ...
    """

    def __init__(self, first: int, n: int, k: int, self_join: bool, at: np.ndarray | None = None):
        self.first, self.n, self.k, self.self_join = first, n, k, self_join
        self.at = first + np.arange(n) if at is None else at
        self.d2 = np.full((n, k), np.inf)
        self.j = np.full((n, k), NONE, np.int64)

    def add(self, row: np.ndarray, j: np.ndarray, d2: np.ndarray) -> None:
        """Offers candidates (local row, index of the neighbour, exact squared distance); infinite ones are none."""
        ok = np.isfinite(d2)
        row, j, d2 = row[ok], j[ok], d2[ok]
        if not len(row):
            return
        touched = np.unique(row)
        held_r, held_c = np.nonzero(self.j[touched] != NONE)
        held_r = touched[held_r]
        row = np.concatenate([row, held_r])
        old_j = self.j[touched]
        j = np.concatenate([j, old_j[old_j != NONE]])
        d2 = np.concatenate([d2, self.d2[touched][old_j != NONE]])
        order = np.lexsort((keys(self.at[row], j, self.self_join), d2, row))
        row, j, d2 = row[order], j[order], d2[order]
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (j[1:] != j[:-1])])  # a pair may be offered twice
        row, j, d2 = row[new], j[new], d2[new]
        start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        place = np.arange(len(row)) - np.repeat(start, np.diff(np.append(start, len(row))))
        keep = place < self.k
        self.d2[touched], self.j[touched] = np.inf, NONE
        self.d2[row[keep], place[keep]] = d2[keep]
        self.j[row[keep], place[keep]] = j[keep]


def _winners(score: np.ndarray, k: int, bound: float, axis: int, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries within the rounding bound of the k-th best score of their row (axis 1) or column (axis 0).

    ``held`` is the score of the k-th best a list has already; what is surely
    worse is no winner, so most rows end after their maximum.
    """
    floor = np.maximum(held - 2 * bound, -BIG / 2).astype(score.dtype)
    top, n = score.max(axis=axis, initial=-np.inf), score.shape[axis]
    alive = np.flatnonzero(top >= floor)
    if not len(alive):
        return alive, alive
    part = score
    if len(alive) < len(floor):
        part, floor, top = score.take(alive, axis=1 - axis), floor[alive], top[alive]
    if k < n:
        best = top if k == 1 else np.partition(part, n - k, axis=axis).take(n - k, axis=axis)
        floor = np.maximum(floor, best - 2 * bound)
    hit = np.flatnonzero(part >= (floor[:, None] if axis == 1 else floor[None, :]))
    r, c = np.divmod(hit, part.shape[1])
    return (alive[r], c) if axis == 1 else (r, alive[c])


def _blank(score: np.ndarray, low: int, high: int) -> None:
    """Rules out the columns from low + r up to high + r of each row r."""
    for r in range(len(score)):
        score[r, max(low + r, 0) : max(high + r, 0)] = -np.inf


def join(a: Block, b: Block, k: int, excl: int | None, into: list[tuple[str, int, Best]], mirror: bool) -> None:
    """Offers the pairs of two blocks to the best lists.

    ``into`` lists (side, which, best): which is 0 for a list of ``a``'s windows
    and 1 for one of ``b``'s; side is `all`, `left` or `right`.  ``excl`` is
    None in an AB-join.  With ``mirror`` each pair counts for both blocks.
    """
    left, right, bound, unit = _sides(a, b)
    step = tile_rows(b.n)
    tile = np.empty((min(step, a.n), b.n), right.dtype)
    for at in range(0, a.n, step):
        score = np.matmul(left[at : at + step], right, out=tile[: a.n - at])
        same = a.first + at - b.first  # the column of the first row's own window
        if excl is not None and same - excl < b.n and same + len(score) + excl > 0:
            _blank(score, same - excl, same + excl + 1)
        for side, which, best in into:
            if which == 1 and not mirror:
                continue
            part = score
            if side != "all":
                # from the list's own window to its neighbour: left is before it
                before = (side == "left") == (which == 0)
                some_before, some_after = same + len(score) > 1, same < b.n - 1
                if not (some_before if before else some_after):
                    continue
                if (same < b.n) if before else (same + len(score) > 0):
                    part = score.copy()
                    _blank(part, same if before else -len(part), b.n if before else same + 1)
            kth = best.d2[:, -1] if which else best.d2[at : at + step, -1]
            r, c = _winners(part, best.k, bound, 1 - which, _scored(kth, a, unit))
            if len(r):
                d2 = exact(a, b, r + at, c)
                if which == 0:
                    best.add(r + at, c + b.first, d2)
                else:
                    best.add(c, r + at + a.first, d2)


def search(q: Block, t: Block, excl: int, best: Best) -> None:
    """Offers the windows of a block to the list of any windows ``q`` of its series, which are at ``best.at``."""
    left, right, bound, unit = _sides(q, t)
    step = tile_rows(t.n)
    tile = np.empty((min(step, q.n), t.n), right.dtype)
    for at in range(0, q.n, step):
        score = np.matmul(left[at : at + step], right, out=tile[: q.n - at])
        own = best.at[at : at + step] - t.first
        for r in np.flatnonzero((own - excl < t.n) & (own + excl >= 0)):
            score[r, max(own[r] - excl, 0) : own[r] + excl + 1] = -np.inf
        r, c = _winners(score, best.k, bound, 1, _scored(best.d2[at : at + step, -1], q, unit))
        if len(r):
            best.add(r + at, c + t.first, exact(q, t, r + at, c))


def distance_profile(q: np.ndarray, t: Block, q_constant: bool) -> np.ndarray:
    """Distances of one finite query to all windows of a block."""
    if t.normalize:
        z = znormalise(q[None, :], np.array([q_constant]))
        query = Block(0, z, np.array([True]), np.array([q_constant]), True)
    else:
        query = Block(0, q[None, :], np.array([True]), np.array([q_constant]), False)
    zeros = np.zeros(t.n, np.int64)
    return distances(exact(query, t, zeros, np.arange(t.n), snap=False), t.normalize)

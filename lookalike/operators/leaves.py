"""Exact nearest rows inside one task: the kernel of the look-alike searches (J5) and the donor search.

Both sides are cut by medians into leaves of ``LEAF_ROWS`` rows.  The rows of a leaf visit the other side's
leaves by ascending distance of their boxes.  The first ones give each row a floor for its k-th best score; later leaves
are compared with the floors by one matrix product, and leaves that no row's floor lets in are not visited.
Only rows at or above the last floor (less the product's rounding) get their score from exact differences or
products, so a score does not depend on the place of a row in a block.  Nothing is sampled: where
boxes rule nothing out, every pair is compared.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

LEAF_ROWS = 256
FIRST_ROWS = 512     # targets that give the first floors, at least
BATCH_ROWS = 1024    # targets compared at once later
TIED = 64            # times k candidates of a row at which their exact scores are looked at early
ROUNDING = 1e-12     # of a product, relative to the vectors' squares


def cut(x: np.ndarray, rows: int = LEAF_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers leaf by leaf, bounds of the leaves): each cut is at the median of the widest column."""
    order, starts, stack = np.arange(len(x)), [], [(0, len(x))]
    while stack:
        lo, hi = stack.pop()
        if hi - lo <= rows:
            starts.append(lo)
            continue
        part = x[order[lo:hi]]
        axis, mid = int((part.max(axis=0) - part.min(axis=0)).argmax()), (hi - lo) // 2
        order[lo:hi] = order[lo:hi][np.argpartition(part[:, axis], mid)]
        stack += [(lo, lo + mid), (lo + mid, hi)]
    return order, np.append(np.sort(starts), len(x)).astype(np.int64)


def undominated(x: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the rows that fewer than ``k`` equal rows of lower rank precede: no others can be among the k best."""
    order = np.lexsort((rank, *x.T))
    new = np.r_[True, (x[order[1:]] != x[order[:-1]]).any(axis=1)]
    first = np.flatnonzero(new)
    return np.sort(order[np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x)))) < k])


@dataclass
class Targets:
    """Rows to be found, leaf by leaf; ``number``: a row's place in the caller's table, ``rank`` breaks ties."""
    x: np.ndarray
    number: np.ndarray
    rank: np.ndarray
    bounds: np.ndarray
    low: np.ndarray
    high: np.ndarray
    has_zero: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, number: np.ndarray, rank: np.ndarray) -> "Targets":
        order, bounds = cut(x)
        x = np.ascontiguousarray(x[order])
        at = bounds[:-1]
        return cls(x, number[order], rank[order], bounds, np.minimum.reduceat(x, at), np.maximum.reduceat(x, at),
                   np.maximum.reduceat((~x.any(axis=1)).astype(np.int8), at).astype(bool))


def exact_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, added up column by column."""
    total = a[:, 0] * b[:, 0]
    for f in range(1, a.shape[1]):
        total += a[:, f] * b[:, f]
    return total


def exact_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minus the distances row by row."""
    total = np.zeros(len(a))
    for f in range(a.shape[1]):
        total += (a[:, f] - b[:, f]) ** 2
    return -np.sqrt(total)


def _box_squares(a: np.ndarray, t: Targets) -> np.ndarray:
    """Squared distances (row, leaf) of rows to boxes."""
    far = np.zeros((len(a), len(t.low)))
    for f in range(a.shape[1]):
        v = a[:, f][:, None]
        gap = np.maximum(np.maximum(t.low[:, f][None, :] - v, v - t.high[:, f][None, :]), 0.0)
        far += gap * gap
    return far


def _places(r: np.ndarray) -> np.ndarray:
    """Place of every entry among those of its row; ``r`` is sorted."""
    starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.empty(0, np.int64)
    return np.arange(len(r)) - np.repeat(starts, np.diff(np.append(starts, len(r))))


def nearest(x: np.ndarray, t: Targets, k: int, metric: str, parts: list[np.ndarray], least: float | None = None,
            keep: Callable | None = None, score: Callable | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, target's number, score) of the ``k`` best targets of every row; ties go to the lower rank.

    ``metric``: "cosine" (unit or zero rows on both sides) or "euclidean" (score: minus the distance).  ``parts``: row numbers of
    ``x``, neighbours together.  ``least``: no score lies below.  ``keep(rows, numbers)``: which pairs count.
    ``score(rows, numbers)``: exact score of pairs, by default from the vectors."""
    cosine = metric == "cosine"
    plain = exact_dot if cosine else exact_distance
    scale = 1.0 if cosine else max(float((x * x).sum(1).max(initial=0.0)), float((t.x * t.x).sum(1).max(initial=0.0)))
    slack = ROUNDING * max(1.0, x.shape[1] / 64) * 4 * scale
    sizes, squares = np.diff(t.bounds), (t.x * t.x).sum(axis=1)

    def best(part: np.ndarray, a: np.ndarray, r: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best of every row by exact score and rank."""
        value = plain(a[r], t.x[j]) if score is None else score(part[r], t.number[j])
        if least is not None:
            ok = value >= least
            r, j, value = r[ok], j[ok], value[ok]
        order = np.lexsort((t.rank[j], -value, r))
        order = order[_places(r[order]) < k]
        return r[order], j[order], value[order]
    found = []
    for part in parts:
        if not len(part) or not len(t.x):
            continue
        a = x[part]
        a2 = (a * a).sum(axis=1)
        far = _box_squares(a, t)
        if cosine:                                          # a chord of c spans a cosine of 1 - c * c / 2
            bound = 1.0 - far / 2
            bound = np.where((a2 == 0)[:, None] | t.has_zero[None, :], np.maximum(bound, 0.0), bound)
        else:
            bound = -far
        todo = np.argsort(-bound.max(axis=0), kind="stable")
        # a row's floor lies below its k-th best score, as the product gives scores
        start = -np.inf if least is None else least if cosine else np.inf if least > 0 else -float(least) ** 2
        floor = np.full(len(part), start) - slack
        r, j, s = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)      # row of the part, place in t, product's score
        batch = max(FIRST_ROWS, 2 * k)
        while len(todo):
            todo = todo[(bound[:, todo] >= floor[:, None] - slack).any(axis=0)]
            if not len(todo):
                break
            some = max(1, int(np.searchsorted(np.cumsum(sizes[todo]), batch, side="right")))
            cols = np.concatenate([np.arange(t.bounds[leaf], t.bounds[leaf + 1]) for leaf in todo[:some]])
            todo, batch = todo[some:], BATCH_ROWS
            rough = a @ t.x[cols].T
            if not cosine:
                rough *= 2.0
                rough -= a2[:, None]
                rough -= squares[cols][None, :]
            open_ = np.isneginf(floor).any()
            if open_:
                if keep is not None:
                    rough[~keep(part[:, None], t.number[cols][None, :])] = -np.inf
                if len(cols) >= k:
                    floor = np.maximum(floor, np.partition(rough, len(cols) - k, axis=1)[:, len(cols) - k] - 2 * slack)
            hit = rough >= floor[:, None]
            if open_:
                hit &= rough > -np.inf
            at = np.flatnonzero(hit)
            if not len(at):
                continue
            hr, hc = np.divmod(at, len(cols))
            hj, hs = cols[hc], rough.ravel()[at]
            if keep is not None and not open_:
                ok = keep(part[hr], t.number[hj])
                hr, hj, hs = hr[ok], hj[ok], hs[ok]
            r, j, s = np.concatenate([r, hr]), np.concatenate([j, hj]), np.concatenate([s, hs])
            order = np.argsort(-s)
            order = order[np.argsort(r[order].astype(np.int16), kind="stable")]     # LEAF_ROWS rows: a radix sort
            r, j, s = r[order], j[order], s[order]
            at_k = _places(r) == k - 1
            floor[r[at_k]] = np.maximum(floor[r[at_k]], s[at_k] - 2 * slack)
            near = s >= floor[r]
            r, j, s = r[near], j[near], s[near]
            if len(r) > TIED * k * len(part):               # very many ties: only the lowest ranks stay
                r, j, value = best(part, a, r, j)
                r, j, s = r, j, value if cosine else -value * value
        r, j, s = best(part, a, r, j)
        found.append((part[r], t.number[j], s))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(c) for c in zip(*found))

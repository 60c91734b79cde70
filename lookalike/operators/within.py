"""Rows within a distance of each other inside one task, and the cells they are dealt by: the kernel of M15.

Both sides are cut by medians into leaves (``operators.leaves``).  A leaf meets the other side's leaves whose
boxes lie within the distance, by one matrix product each; pairs whose squared distance lies inside the product's
rounding are looked at again by exact differences.  Counting stops for a row at ``most`` neighbours, and
leaves that are known to be joined are not compared.  Nothing is sampled: every pair that could change a
result is compared.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from lookalike.operators.leaves import BATCH_ROWS, ROUNDING, Targets, _box_squares, cut, exact_distance


@dataclass
class Side:
    """Rows leaf by leaf; ``number``: a row's place in the caller's table."""
    t: Targets
    plain: np.ndarray       # as given: distances at the limit come from these
    squares: np.ndarray

    @property
    def number(self) -> np.ndarray:
        return self.t.number


def sides(eps: float, *tables: np.ndarray) -> tuple[float, list[Side]]:
    """(rounding of a squared distance, a side for every table); all are shifted by one middle, so that squares stay small."""
    middle = np.vstack(tables).mean(axis=0)
    out, scale = [], eps * eps
    for x in tables:
        t = Targets.of(x - middle, np.arange(len(x)), np.arange(len(x)))
        squares = (t.x * t.x).sum(axis=1)
        scale = max(scale, float(squares.max(initial=0.0)))
        out.append(Side(t, x[t.number], squares))
    return ROUNDING * max(1.0, tables[0].shape[1] / 64) * 4 * scale, out


def _near(a: Side, rows: np.ndarray, b: Side, cols: np.ndarray, eps: float, slack: float) -> np.ndarray:
    """Whether each pair of rows (places in their sides) lies within ``eps``."""
    rough = a.t.x[rows] @ b.t.x[cols].T
    rough *= -2.0
    rough += a.squares[rows][:, None]
    rough += b.squares[cols][None, :]
    near = rough <= eps * eps + slack
    edge = np.flatnonzero(near & (rough >= eps * eps - slack))
    for at in np.array_split(edge, max(1, len(edge) >> 16)):
        r, c = np.divmod(at, len(cols))
        near.reshape(-1)[at] = -exact_distance(a.plain[rows[r]], b.plain[cols[c]]) <= eps
    return near


def _batch(b: Side, leaves: np.ndarray, most: int = BATCH_ROWS) -> tuple[int, np.ndarray]:
    """(leaves taken, their rows' places) for one product."""
    n = max(1, int(np.searchsorted(np.cumsum(np.diff(b.t.bounds)[leaves]), most, side="right")))
    return n, np.concatenate([np.arange(b.t.bounds[leaf], b.t.bounds[leaf + 1]) for leaf in leaves[:n]])


def _spans(a: Side):
    return zip(a.t.bounds[:-1].tolist(), a.t.bounds[1:].tolist())


def count(a: Side, b: Side, eps: float, most: int, slack: float) -> np.ndarray:
    """Rows of ``b`` within ``eps`` of every row of ``a``, in the caller's order; a row that has ``most`` counts no more."""
    found = np.zeros(len(a.number), np.int64)
    for lo, hi in _spans(a):
        far = _box_squares(a.t.x[lo:hi], b.t)
        close = far <= eps * eps + slack
        todo = np.flatnonzero(close.any(axis=0))
        todo = todo[np.argsort(far[:, todo].sum(axis=0), kind="stable")]
        n, open_ = np.zeros(hi - lo, np.int64), np.arange(hi - lo)
        while len(todo):
            some, cols = _batch(b, todo)
            todo = todo[some:]
            n[open_] += _near(a, lo + open_, b, cols, eps, slack).sum(axis=1)
            open_ = open_[n[open_] < most]
            todo = todo[close[open_][:, todo].any(axis=0)]
        found[a.number[lo:hi]] = np.minimum(n, most)
    return found


def first_near(a: Side, b: Side, rank: np.ndarray, eps: float, slack: float) -> np.ndarray:
    """For every row of ``a`` the lowest ``rank`` (of the caller's rows of ``b``) within ``eps``, in the caller's order; else
    the number of rows of ``b``."""
    found, placed = np.full(len(a.number), len(b.number), np.int64), rank[b.number]
    for lo, hi in _spans(a):
        todo = np.flatnonzero((_box_squares(a.t.x[lo:hi], b.t) <= eps * eps + slack).any(axis=0))
        best = np.full(hi - lo, len(b.number), np.int64)
        while len(todo):
            some, cols = _batch(b, todo)
            todo = todo[some:]
            near = _near(a, np.arange(lo, hi), b, cols, eps, slack)
            best = np.minimum(best, np.where(near, placed[cols][None, :], len(b.number)).min(axis=1))
        found[a.number[lo:hi]] = best
    return found


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of every pair; the root of a set is its lowest member."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while True:
            higher = root[root]
            if np.array_equal(higher, root):
                break
            root[:] = higher


def join(a: Side, b: Side, a_set: np.ndarray, b_set: np.ndarray, sets: int, eps: float, slack: float) -> np.ndarray:
    """Lowest set that each of ``sets`` sets is joined to; rows of ``a`` and ``b`` (in the caller's order: ``a_set``, ``b_set``)
    within ``eps`` join their sets.  ``a`` may be ``b``."""
    root, sa, sb = np.arange(sets), a_set[a.number], b_set[b.number]

    def compare(lo: int, hi: int, todo: np.ndarray) -> None:
        while len(todo):
            some, cols = _batch(b, todo)
            todo = todo[some:]
            mine, theirs = root[sa[lo:hi]], root[sb[cols]]
            if mine.min() == mine.max() == theirs.min() == theirs.max():
                continue
            near = _near(a, np.arange(lo, hi), b, cols, eps, slack)
            near &= mine[:, None] != theirs[None, :]
            r, c = np.nonzero(near)
            if len(r):
                pairs = np.unique(mine[r] * sets + theirs[c])
                _unite(root, pairs // sets, pairs % sets)
    if a is b:                      # leaves on their own first: most are one set then
        for i, (lo, hi) in enumerate(_spans(a)):
            compare(lo, hi, np.array([i]))
    for i, (lo, hi) in enumerate(_spans(a)):
        close = (_box_squares(a.t.x[lo:hi], b.t) <= eps * eps + slack).any(axis=0)
        if a is b:
            close[:i + 1] = False   # the pairs of leaves before
        mine, theirs = root[sa[lo:hi]], root[sb]
        low, high = np.minimum.reduceat(theirs, b.t.bounds[:-1]), np.maximum.reduceat(theirs, b.t.bounds[:-1])
        if mine.min() == mine.max():
            close &= (low != mine[0]) | (high != mine[0])
        compare(lo, hi, np.flatnonzero(close))
    return root


@dataclass
class Cells:
    """A tree of cuts: rows go right of node i where column axis[i] exceeds at[i]; axis -1 is a cell."""
    axis: np.ndarray
    at: np.ndarray
    right: np.ndarray       # the left child is the next node

    @classmethod
    def of(cls, x: np.ndarray, cells: int) -> "Cells":
        """About ``cells`` cells of as many rows of ``x`` each, cut in halves at the column of the largest deviation."""
        axis, at, right = [], [], []
        least = len(x) / max(cells, 1) * 1.4

        def grow(part: np.ndarray) -> None:
            node = len(axis)
            axis.append(-1), at.append(0.0), right.append(-1)
            if len(part) < max(least, 2):
                return
            for f in np.argsort(-part.std(axis=0), kind="stable").tolist():
                value = np.sort(part[:, f])
                if value[0] == value[-1]:
                    continue
                where = value[(len(value) - 1) // 2]
                if where == value[-1]:
                    where = value[np.searchsorted(value, where) - 1]
                axis[node], at[node] = f, float(where)
                over = part[:, f] > where
                grow(part[~over])
                right[node] = len(axis)
                grow(part[over])
                return
        grow(x)
        return cls(np.array(axis), np.array(at), np.array(right))

    def cell(self, x: np.ndarray) -> np.ndarray:
        """Node number of every row's cell."""
        node = np.zeros(len(x), np.int64)
        while True:
            go = np.flatnonzero(self.axis[node] >= 0)
            if not len(go):
                return node
            i = node[go]
            node[go] = np.where(x[go, self.axis[i]] > self.at[i], self.right[i], i + 1)

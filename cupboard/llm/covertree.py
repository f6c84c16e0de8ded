"""Cover trees over norm-augmented vectors, and exact search for the largest inner products inside windows.

Every vector gets one more entry, ``sqrt(M^2 - |x|^2)``, so that all have the norm ``M``; a query gets a zero. Then
``<q, c> - |q| r <= <q, x> <= <q, c> + |q| r`` for all x within the radius r of the centre c: a node's covering radius
bounds the inner products of all its members from both sides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .vectors import EXACT

# Radii and centre products are doubles; bounds are widened by this share of |q| M, far above their rounding.
SLACK = 1e-9
# Levels of a tree; deeper nodes stay leaves of any size, which costs time only.
DEPTH = 32


def augmented(x: np.ndarray, square: float) -> np.ndarray:
    """The vectors with the entry that lifts their squared norm to ``square``."""
    x = x.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(square - (x * x).sum(axis=1), 0.0))])


def distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - centre) ** 2).sum(axis=1))


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows, saturated at 64 bits."""
    widest = int(np.abs(a.astype(np.float64)).max(initial=0)), int(np.abs(b.astype(np.float64)).max(initial=0))
    if widest[0] * widest[1] * a.shape[1] < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    ends = np.iinfo(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, ends.min, ends.max).astype(np.int64)


def farthest_first(points: np.ndarray, most: int, radius: float = 0.0, first: int = 0) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Centres chosen one by one as the point farthest from those before, until all points lie within ``radius`` of one
    or there are ``most``; the place of each point's centre in that list, and the distance to it."""
    chosen, nearest = [first], np.zeros(len(points), np.int64)
    far = distances(points, points[first])
    while len(chosen) < most and far.max() > radius:
        at = int(far.argmax())
        other = distances(points, points[at])
        closer = other < far
        nearest[closer], far[closer] = len(chosen), other[closer]
        chosen.append(at)
    return chosen, nearest, far


@dataclass(frozen=True)
class Level:
    """The nodes of one depth: centre, covering radius of all members, and the node above."""

    centres: np.ndarray
    radii: np.ndarray
    parents: np.ndarray


@dataclass(frozen=True)
class CoverTree:
    """Levels from the root down; ``leaves`` holds for each node of the last level the rows it has."""

    levels: tuple[Level, ...]
    leaves: tuple[np.ndarray, ...]

    @staticmethod
    def build(points: np.ndarray, leaf: int = 128, base: float = 1.3, fan: int = 24) -> CoverTree:
        """A node's children lie more than ``radius / base`` apart and cover its members within it (with ``fan`` children
        the covering radius may stay larger; the true one is kept). Children of few members share a leaf."""
        middle = int(distances(points, points.mean(axis=0)).argmin())
        radius = float(distances(points, points[middle]).max())
        nodes = [(np.arange(len(points)), middle, radius)]
        levels = [Level(points[[middle]], np.array([radius]), np.zeros(1, np.int64))]
        while len(levels) < DEPTH and any(len(rows) > leaf and r > 0 for rows, _, r in nodes):
            below, parents = [], []
            for number, (rows, centre, r) in enumerate(nodes):
                if len(rows) <= leaf or r <= 0:  # carried down unchanged
                    below.append((rows, centre, r))
                    parents.append(number)
                    continue
                own = points[rows]
                chosen, nearest, far = farthest_first(own, fan, r / base, int(np.flatnonzero(rows == centre)[0]))
                sizes = np.bincount(nearest, minlength=len(chosen))
                few = sizes < leaf // 8
                few[0] = False
                few &= sizes[few].sum() <= leaf
                for k in np.flatnonzero(~few):
                    mine = nearest == k
                    below.append((rows[mine], int(rows[chosen[k]]), float(far[mine].max())))
                    parents.append(number)
                if few.any():
                    rest = few[nearest]
                    at = own[rest]
                    pick = int(distances(at, at.mean(axis=0)).argmin())
                    below.append((rows[rest], int(rows[rest][pick]), float(distances(at, at[pick]).max())))
                    parents.append(number)
            nodes = below
            levels.append(Level(points[[c for _, c, _ in nodes]], np.array([r for _, _, r in nodes]), np.array(parents)))
        return CoverTree(tuple(levels), tuple(rows for rows, _, _ in nodes))

    @staticmethod
    def above(centres: np.ndarray, radii: np.ndarray, leaf: int = 1) -> CoverTree:
        """The tree over given cells: each leaf is one cell, and the radius of a node covers its cells' radii too."""
        tree = CoverTree.build(centres, leaf)
        members = [list(rows) for rows in tree.leaves]
        levels = []
        for level in reversed(tree.levels):
            wide = [max(float((distances(centres[m], c) + radii[m]).max()), 0.0) for c, m in zip(level.centres, members)]
            levels.append(Level(level.centres, np.array(wide), level.parents))
            joined: dict[int, list[int]] = {}
            for parent, m in zip(level.parents, members):
                joined.setdefault(int(parent), []).extend(m)
            members = [joined[k] for k in sorted(joined)]
        return CoverTree(tuple(reversed(levels)), tree.leaves)

    def descend(self, queries: np.ndarray, low: np.ndarray, high: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """(wanted, upper): whether a query has a window (low, high) that a leaf's members may reach, and the upper bound of
        their inner products. Children of nodes outside all windows of a query are not looked at for it."""
        length = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        flat = np.column_stack([queries.astype(np.float64), np.zeros(len(queries))])
        wanted, upper = np.ones((len(queries), 1), bool), np.zeros((len(queries), 1))
        for depth, level in enumerate(self.levels):
            wanted = wanted[:, level.parents] if depth else wanted
            upper = np.full(wanted.shape, -np.inf)
            live = np.flatnonzero(wanted.any(axis=0))
            middle = flat @ level.centres[live].T
            reach = length[:, None] * (level.radii[live] + slack)
            upper[:, live] = middle + reach
            for k, node in enumerate(live):
                lower = middle[:, k] - reach[:, k]
                meets = (upper[:, node, None] >= low) & (lower[:, None] <= high)
                wanted[:, node] &= meets.any(axis=1)
        return wanted, upper


@dataclass
class Found:
    """The best rows of each (query, window): the ``k`` largest scores, ties by smaller id."""

    k: int
    query: np.ndarray
    window: np.ndarray
    score: np.ndarray
    id: np.ndarray

    @staticmethod
    def none(k: int) -> Found:
        return Found(k, *(np.zeros(0, np.int64) for _ in range(4)))

    def add(self, parts: list[tuple[np.ndarray, ...]], floors: np.ndarray) -> None:
        """Take new rows in, and raise the ``floors`` (query, window) to the k-th best score where there are k."""
        if not parts:
            return
        columns = [np.concatenate([own, *new]) for own, new in zip((self.query, self.window, self.score, self.id), zip(*parts))]
        order = np.lexsort((columns[3], -columns[2], columns[1], columns[0]))
        query, window, score, ids = (c[order] for c in columns)
        start = np.ones(len(query), bool)
        start[1:] = (query[1:] != query[:-1]) | (window[1:] != window[:-1])
        rank = np.arange(len(query)) - np.maximum.accumulate(np.where(start, np.arange(len(query)), 0))
        kth = rank == self.k - 1
        floors[query[kth], window[kth]] = np.maximum(floors[query[kth], window[kth]], score[kth])
        keep = rank < self.k
        self.query, self.window, self.score, self.id = query[keep], window[keep], score[keep], ids[keep]


@dataclass
class Block:
    """Candidates with their tree. Rows of equal (id, label, vector) are there once."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    square: float
    tree: CoverTree

    @staticmethod
    def of(ids: np.ndarray, labels: np.ndarray, x: np.ndarray, square: float, leaf: int = 128) -> Block:
        return Block(ids, labels, x, square, CoverTree.build(augmented(x, square), leaf))

    def search(self, ids: np.ndarray, labels: np.ndarray, queries: np.ndarray, low: np.ndarray, high: np.ndarray,
               k: int, same_label: bool, floors: np.ndarray) -> tuple[Found, np.ndarray]:
        """The k best rows inside each window ``low <= score <= high`` (query, window) of every query, its own row left out,
        among rows of the query's label or of all others. ``floors`` are scores below which nothing is wanted; they are
        returned as raised by what was found.

        Best first: a query's leaves are visited by falling upper bound, one, two, four ... at a time, and leaves whose
        bound is below the k-th best score so far, or outside all windows, are skipped.
        """
        floors = np.maximum(floors, low)
        found = Found.none(k)
        wanted, upper = self.tree.descend(queries, floors, high, SLACK * np.sqrt(self.square))
        upper[~wanted] = -np.inf
        order = np.argsort(-upper, axis=1, kind="stable")
        ranked = np.take_along_axis(upper, order, axis=1)
        own = np.array([inner(q[None], q[None])[0, 0] for q in queries], np.int64)
        begin, width = 0, 1
        while begin < ranked.shape[1]:
            due = np.zeros(upper.shape, bool)
            step = slice(begin, begin + width)
            go = (ranked[:, step, None] >= floors[:, None, :]).any(axis=2) & (ranked[:, step] > -np.inf)
            if not go.any():
                break  # bounds fall from left to right, so none comes later
            np.put_along_axis(due, order[:, step], go, axis=1)
            parts = [self._leaf(leaf, np.flatnonzero(due[:, leaf]), ids, labels, queries, own, floors, high, same_label)
                     for leaf in np.flatnonzero(due.any(axis=0))]
            found.add(parts, floors)
            begin, width = begin + width, 2 * width
        return found, floors

    def _leaf(self, leaf, at, ids, labels, queries, own, floors, high, same_label) -> tuple[np.ndarray, ...]:
        rows = self.tree.leaves[leaf]
        score = inner(queries[at], self.x[rows])
        allowed = (labels[at][:, None] == self.labels[rows]) == same_label
        if same_label:
            for i, j in zip(*np.nonzero(allowed & (ids[at][:, None] == self.ids[rows]) & (score == own[at][:, None]))):
                allowed[i, j] = (self.x[rows[j]] != queries[at[i]]).any()
        inside = allowed[:, :, None] & (score[:, :, None] >= floors[at][:, None, :]) & (score[:, :, None] <= high[at][:, None, :])
        i, j, w = np.nonzero(inside)
        return at[i], w, score[i, j], self.ids[rows[j]]

"""Cover trees over integer vectors and the dual-tree search for the largest inner products.

A node of level i stands at one of its rows and covers rows within 2**i of it.  Its children have level i - 1 at most:
the node's own row is the first child (nesting), every row lies within 2**(i - 1) of its child's row (covering), and
the children's rows are farther than that from each other (separation).  Levels at which nothing parts are left out.
"""

from __future__ import annotations

import heapq
import math

import numpy as np

#: Rows that a node keeps unsplit, centres tried at once, and queries scored at once.
LEAF, TRIED, ASKED = 16, 64, 1_024
#: Below any score.
LOWEST = np.iinfo(np.int64).min + 1


class Node:
    """``centre`` (a row), the exact distance to its farthest row, and children or rows.

    ``loose`` holds the rows of all children of one row, ``kids`` the other children; a leaf has ``loose`` only."""

    __slots__ = ("row", "level", "centre", "radius", "norm", "kids", "loose", "centres", "radii", "norms", "n", "leaf", "members")

    def __init__(self, row: int, level: int, centre: np.ndarray, radius: float, kids: list[Node], loose: np.ndarray, leaf: bool) -> None:
        self.row, self.level, self.centre, self.radius, self.kids, self.loose, self.leaf = row, level, centre, radius, kids, loose, leaf
        self.norm = float(np.sqrt((centre * centre).sum()))
        self.centres = np.stack([c.centre for c in kids]) if kids else np.empty((0, len(centre)))
        self.radii, self.norms = np.array([c.radius for c in kids]), np.array([c.norm for c in kids])
        self.members = np.concatenate([loose, *(c.members for c in kids)])
        self.n = len(self.members)

    def bounds(self, centre: np.ndarray, norm: float, radius: float) -> np.ndarray:
        """For each of ``kids``: no pair of it and the ball has a larger inner product."""
        return self.centres @ centre + norm * self.radii + self.norms * radius + radius * self.radii


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> Node:
    squares = (x * x).sum(axis=1)

    def far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of rows a to rows b; exact, as all terms are whole numbers."""
        return np.sqrt(np.maximum(squares[a][:, None] + squares[b][None, :] - 2 * (x[a] @ x[b].T), 0))

    def grow(own: np.ndarray, dist: np.ndarray) -> Node:
        """The node at row own[0], whose rows are at ``dist`` from it."""
        most = float(dist.max())
        level = math.ceil(math.log2(most)) if most else 0
        if len(own) <= leaf or not most:
            return Node(int(own[0]), level, x[own[0]], most, [], own, True)
        cover = 2.0 ** (level - 1)
        parts = [(own[dist <= cover], dist[dist <= cover])]
        rest = own[dist > cover]
        while len(rest):
            tried = rest[:TRIED]
            d = far(tried, rest)
            near = d <= cover
            centres: list[int] = []
            for i in range(len(tried)):
                if not near[centres, i].any():
                    centres.append(i)
            owner = near[centres].argmax(axis=0)
            covered = near[centres].any(axis=0)
            for k, i in enumerate(centres):
                mine = np.flatnonzero(covered & (owner == k))
                first = np.concatenate([[i], mine[mine != i]])  # the centre leads
                parts.append((rest[first], d[i, first]))
            rest = rest[~covered]
        loose = np.array([p[0] for p, _ in parts if len(p) == 1], dtype=np.int64)
        return Node(int(own[0]), level, x[own[0]], most, [grow(p, d) for p, d in parts if len(p) > 1], loose, False)

    every = np.arange(len(x))
    return grow(every, far(every[:1], every)[0])


class Best:
    """The k best (score, smaller id first) of each query, fed block by block; ``scored`` counts the pairs fed."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None) -> None:
        self.k, self.scored = k, 0
        self.scores = np.full((n, k), LOWEST)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)
        self.kth = np.full(n, -np.inf) if floor is None else floor.astype(np.float64).copy()

    def feed(self, who: np.ndarray, scores: np.ndarray, ids: np.ndarray, skip: np.ndarray) -> None:
        """scores: (queries, rows); ``skip`` holds the queries' own ids, which take no part."""
        self.scored += scores.size
        scores = np.where(ids[None, :] == skip[:, None], LOWEST, scores)
        least = np.maximum(self.kth[who], float(LOWEST + 1))
        if scores.shape[1] > self.k:
            least = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k])
        q, r = np.nonzero(scores >= least[:, None])
        if not len(q):
            return
        touched = np.unique(q)
        own = who[touched]
        row = np.concatenate([np.repeat(np.arange(len(touched)), self.k), np.searchsorted(touched, q)])
        score = np.concatenate([self.scores[own].ravel(), scores[q, r]])
        ident = np.concatenate([self.ids[own].ravel(), ids[r]])
        order = np.lexsort((ident, -score, row))
        counts = np.bincount(row)
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        take = order[(first[:, None] + np.arange(self.k)[None, :])]
        self.scores[own], self.ids[own] = score[take], ident[take]
        self.kth[own] = np.maximum(self.kth[own], np.where(score[take][:, -1] == LOWEST, -np.inf, score[take][:, -1]))


def bound(a: Node, b: Node) -> float:
    """No pair below the two nodes has a larger inner product."""
    return float(a.centre @ b.centre) + a.norm * b.radius + b.norm * a.radius + a.radius * b.radius


def dual_search(queries: Node, qx: np.ndarray, qid: np.ndarray, data: Node, dx: np.ndarray, did: np.ndarray, best: Best) -> None:
    """Feed ``best`` with every pair that can count.

    Node pairs are taken in order of their bound and dropped when it is below the worst kth score among the query
    node's members (a small margin covers rounding; ties are never dropped).  Where the query side has no more nodes
    below, its members go down the data node together, each with the balls its own kth score admits."""
    worst = lambda node: float(best.kth[node.members].min())
    slack = lambda top: 1e-6 * (1 + np.abs(top))

    def ask(who: np.ndarray, d: Node) -> None:
        if len(d.loose):
            for s in range(0, len(who), ASKED):
                part = who[s : s + ASKED]
                best.feed(part, np.rint(qx[part] @ dx[d.loose].T).astype(np.int64), did[d.loose], qid[part])
        if d.kids:
            norms = np.sqrt((qx[who] ** 2).sum(axis=1))
            tops = qx[who] @ d.centres.T + norms[:, None] * d.radii[None, :]
            for k in np.argsort(-tops.max(axis=0), kind="stable").tolist():
                alive = tops[:, k] + slack(tops[:, k]) >= best.kth[who]
                if alive.any():
                    ask(who[alive], d.kids[k])

    heap, tick = [(-bound(queries, data), 0, queries, data)], 0
    while heap:
        top, _, q, d = heapq.heappop(heap)
        if -top + slack(top) < worst(q):
            continue
        if q.leaf:
            ask(q.members, d)
            continue
        if not d.kids or q.radius > d.radius:
            if len(q.loose):
                ask(q.loose, d)
            pairs = [(c, d) for c in q.kids]
            tops = q.bounds(d.centre, d.norm, d.radius)
        else:
            pairs = [(q, c) for c in d.kids]
            tops = d.bounds(q.centre, q.norm, q.radius)
            if len(d.loose):  # rows of their own: balls of radius zero under the same query node
                rows = dx[d.loose]
                near = d.loose[rows @ q.centre + np.sqrt((rows * rows).sum(axis=1)) * q.radius + slack(0) >= worst(q)]
                if len(near):
                    ask(q.members, Node(int(near[0]), 0, dx[near[0]], 0.0, [], near, True))
        for t, pair in zip(tops.tolist(), pairs):
            tick += 1
            heapq.heappush(heap, (-t, tick, *pair))

"""Vantage-point trees over bit fingerprints: routing between shards and exact search within one.

A fingerprint is a row of uint64 words.  A node holds a vantage point and a distance ``mu``: rows with
d(row, vp) <= mu go left, the others right.  By the triangle inequality a neighbour within ``radius`` of a query at
distance d can lie left only if d - radius <= mu and right only if d + radius > mu.
"""

from __future__ import annotations

import numpy as np

LEAF = 256


def hamming(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Differing bits between each row and one point (both of the same number of words)."""
    return np.bitwise_count(rows ^ point).sum(axis=1, dtype=np.int32)


def build(rows: np.ndarray, depth: int, seed: int = 7) -> list[tuple]:
    """A tree of at most ``depth`` levels over sample rows, as a list of (vp, mu, left, right); a leaf is None.

    Of a few candidate vantage points the one is taken whose split sends the fewest rows across its boundary.
    """
    rng, nodes = np.random.default_rng(seed), []

    def grow(own: np.ndarray, level: int) -> int:
        at = len(nodes)
        nodes.append(None)
        if level == 0 or len(own) < 8:
            return at
        best = None
        for vp in own[rng.choice(len(own), min(6, len(own)), replace=False)]:
            d = hamming(own, vp)
            mu = int(np.median(d))
            if (d <= mu).all():
                mu = int(d.max()) - 1
            if mu < 0:
                continue
            spread = float(d.std())
            if best is None or spread > best[0]:
                best = (spread, vp, mu, d <= mu)
        if best is None:
            return at
        _, vp, mu, left = best
        a, b = grow(own[left], level - 1), grow(own[~left], level - 1)
        nodes[at] = (vp, mu, a, b)
        return at

    grow(rows, depth)
    return nodes


def route(nodes: list, rows: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, home): the leaf each row belongs to, and every further leaf its neighbours may lie in."""
    out: list[tuple[np.ndarray, int, np.ndarray]] = []
    stack = [(0, np.arange(len(rows)), np.ones(len(rows), dtype=bool))]
    while stack:
        at, who, home = stack.pop()
        if not len(who):
            continue
        if nodes[at] is None:
            out.append((who, at, home))
            continue
        vp, mu, left, right = nodes[at]
        d = hamming(rows[who], vp)
        near = d <= mu
        for child, mine, reach in ((left, near, d - radius <= mu), (right, ~near, d + radius > mu)):
            stack.append((child, who[reach], home[reach] & mine[reach]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    return (np.concatenate([w for w, _, _ in out]), np.concatenate([np.full(len(w), leaf, np.int64) for w, leaf, _ in out]), np.concatenate([h for _, _, h in out]))


class Forest:
    """Disjoint sets with unions by arrays of pairs; memory grows with the nodes, never with the pairs."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        la, lb = self.roots(a), self.roots(b)
        apart = la != lb
        if not apart.any():
            return
        n = len(self.label)
        codes = np.unique(np.minimum(la[apart], lb[apart]) * n + np.maximum(la[apart], lb[apart]))
        label = self.label
        for x, y in zip((codes // n).tolist(), (codes % n).tolist()):
            while label[x] != x:
                label[x] = label[label[x]]
                x = label[x]
            while label[y] != y:
                label[y] = label[label[y]]
                y = label[y]
            if x != y:
                label[max(x, y)] = min(x, y)

    def roots(self, who: np.ndarray) -> np.ndarray:
        out = self.label[who]
        while True:
            up = self.label[out]
            if (up == out).all():
                return out
            out = up


def link(members: np.ndarray, queries: np.ndarray, prefix_radius: int, radius: int, forest: Forest) -> None:
    """Join every query (forest nodes from len(members) on, members included first) with the members in reach.

    ``queries`` holds the members, then the visitors.  A pair is in reach if its first words differ in at most
    ``prefix_radius`` bits and the whole fingerprints in at most ``radius``.
    """
    prefix_m, prefix_q = members[:, :1], queries[:, :1]
    stack = [(np.arange(len(members)), np.arange(len(queries)), 1)]
    rng = np.random.default_rng(11)
    while stack:
        own, who, salt = stack.pop()
        if not len(own) or not len(who):
            continue
        split = None
        if len(own) > LEAF:
            for vp in prefix_m[own[rng.choice(len(own), 3)]]:
                d = hamming(prefix_m[own], vp)
                mu = int(np.median(d))
                left = d <= mu
                if left.all():
                    mu = int(d.max()) - 1
                    left = d <= mu
                if left.any() and not left.all():
                    split = (vp, mu, left)
                    break
        if split is not None:
            vp, mu, left = split
            dq = hamming(prefix_q[who], vp)
            a, b = who[dq - prefix_radius <= mu], who[dq + prefix_radius > mu]
            if len(a) + len(b) < 1.97 * len(who) or len(own) > 16 * LEAF:
                stack += [(own[left], a, salt + 1), (own[~left], b, salt + 1)]
                continue
        step = max(1, (1 << 19) // len(own))
        mine = prefix_m[own, 0]
        for s in range(0, len(who), step):
            some = who[s : s + step]
            q, m = np.nonzero(np.bitwise_count(prefix_q[some, 0][:, None] ^ mine[None, :]) <= prefix_radius)
            q, m = some[q], own[m]
            keep = q != m
            q, m = q[keep], m[keep]
            if members.shape[1] > 1 and len(q):
                for t in range(0, len(q), 1 << 16):
                    qq, mm = q[t : t + (1 << 16)], m[t : t + (1 << 16)]
                    apart = forest.roots(qq) != forest.roots(mm)
                    qq, mm = qq[apart], mm[apart]
                    close = np.bitwise_count(queries[qq] ^ members[mm]).sum(axis=1, dtype=np.int32) <= radius
                    forest.join(qq[close], mm[close])
            else:
                forest.join(q, m)

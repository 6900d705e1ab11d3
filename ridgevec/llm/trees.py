"""Binary space-partition trees over unit vectors, fitted on a bounded sample.

Two kinds share one shape - a signed margin per inner node, left where it is
negative:

* :func:`fit_bisecting` - bisecting k-means: the leaf of largest dispersion is
  split by 2-means again and again; a node's margin is the signed distance to
  the plane midway between its two child centres.
* :func:`fit_kd` - a kd-tree over a few stable (Gaussian) projections; a
  node's margin is one projected coordinate less the median at the node.

A vector is routed to its home leaf and on to the nearest other leaves, by the
sum of the squared margins of the planes that lie between.

:func:`compact_leaves` goes on where a bounded sample can't: a task splits the
vectors of one leaf by 2-means, all nodes of a level at once, until every node
is compact.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np


@dataclass
class SplitTree:
    """``left``/``right`` hold a child's index, or ``-1 - leaf`` for a leaf."""

    normal: np.ndarray  # (nodes, f) for planes, or (nodes,) feature numbers
    offset: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaves: int
    depth: int

    def margins(self, feats: np.ndarray, node: np.ndarray) -> np.ndarray:
        if self.normal.ndim == 1:
            return feats[np.arange(len(feats)), self.normal[node]] - self.offset[node]
        return np.einsum("ij,ij->i", feats, self.normal[node]) - self.offset[node]

    def descend(self, feats: np.ndarray, node: np.ndarray, trace: bool = False):
        """Leaf of each row from its start node; with ``trace`` also the nodes
        passed and the margins there, ``inf`` beyond the leaf."""
        n = len(feats)
        node = node.copy()
        nodes = np.full((n, self.depth), -1, np.int32) if trace else None
        margin = np.full((n, self.depth), np.inf, np.float32) if trace else None
        for level in range(self.depth):
            at = np.flatnonzero(node >= 0)
            if not len(at):
                break
            cur = node[at]
            m = self.margins(feats[at], cur)
            if trace:
                nodes[at, level], margin[at, level] = cur, m
            node[at] = np.where(m < 0, self.left[cur], self.right[cur])
        leaf = -1 - node
        return (leaf, nodes, margin) if trace else leaf

    def probe(self, feats: np.ndarray, probes: int | None, stop=None):
        """``(row, leaf, rank)`` of the home leaf (rank 0) and of further
        leaves, nearest first: the squared margins of all planes crossed on the
        way add up to a bound of the squared distance to a leaf. A row goes on
        until ``stop(bound, crossed)`` is true for its nearest leaf left, or it
        has seen ``probes`` leaves (None: the test alone decides)."""
        n = len(feats)
        if not self.depth:
            z = np.zeros(n, np.int32)
            return np.arange(n), z, z
        home, nodes, margin = self.descend(feats, np.zeros(n, np.int32), trace=True)
        rows, leaves, ranks = [np.arange(n)], [home], [np.zeros(n, np.int32)]
        limit = self.leaves if probes is None else min(probes, self.leaves)

        def across(at, nodes, margin, start, crossed):
            cost = start[:, None] + margin.astype(np.float32) ** 2
            return cost, self._other(nodes, margin), np.broadcast_to((crossed + 1)[:, None], cost.shape)

        cost, child, crossed = across(np.arange(n), nodes, margin, np.zeros(n, np.float32), np.zeros(n, np.int32))
        at = np.arange(n)
        for r in range(1, limit):
            best = np.argmin(cost, axis=1)
            own = np.arange(len(at))
            bound, steps = cost[own, best], crossed[own, best]
            go = np.isfinite(bound)
            if stop is not None:
                go &= ~stop(bound, steps)
            if not go.any():
                break
            if not go.all():
                at, best, bound, steps = at[go], best[go], bound[go], steps[go]
                cost, child, crossed = cost[go], child[go], crossed[go]
                own = np.arange(len(at))
            leaf, nodes, margin = self.descend(feats[at], child[own, best], trace=True)
            cost[own, best] = np.inf
            rows.append(at)
            leaves.append(leaf)
            ranks.append(np.full(len(at), r, np.int32))
            if r + 1 < limit:
                more = across(at, nodes, margin, bound, steps)
                cost, child, crossed = (np.concatenate([x, y], axis=1) for x, y in zip((cost, child, crossed), more))
                # no more than the leaves still to be seen matter
                keep = limit - 1 - r
                if probes is not None and cost.shape[1] > 2 * keep + 8:
                    pick = np.argpartition(cost, keep, axis=1)[:, : keep + 1]
                    cost, child, crossed = (np.take_along_axis(x, pick, axis=1) for x in (cost, child, crossed))
        return np.concatenate(rows), np.concatenate(leaves), np.concatenate(ranks)

    def _other(self, nodes: np.ndarray, margin: np.ndarray) -> np.ndarray:
        """The child on the far side of each node passed."""
        return np.where(margin < 0, self.right[nodes], self.left[nodes])


def _two_means(x: np.ndarray, rounds: int, rng: np.random.Generator):
    """Plane of a 2-means split, or None where the points don't differ."""
    c = x.mean(0)
    a = x[np.argmax(((x - c) ** 2).sum(1))] if len(x) <= 64 else x[rng.integers(len(x))]
    b = x[np.argmax(((x - a) ** 2).sum(1))]
    for _ in range(rounds):
        w = b - a
        side = x @ w - (w @ (a + b)) / 2 >= 0
        k = int(side.sum())
        if k in (0, len(x)):
            break
        a, b = x[~side].mean(0), x[side].mean(0)
    w = b - a
    size = float(np.linalg.norm(w))
    if size < 1e-9:
        return None
    w = w / size
    off = float(w @ (a + b)) / 2
    side = x @ w - off >= 0
    # a very uneven split would make deep trees and large leaves
    if min(side.sum(), len(x) - side.sum()) < max(1, len(x) // 16):
        proj = x @ w
        off = float(np.median(proj))
        side = proj - off >= 0
        if side.all() or not side.any():
            return None
    return w.astype(np.float32), off, side


def fit_bisecting(x: np.ndarray, leaves: int, max_leaf: int, seed: int = 11, rounds: int = 6) -> SplitTree:
    """Splits the node of largest dispersion (sum of squared distances to its
    centre) until there are ``leaves`` of them; a node of more than
    ``max_leaf`` sample points is split even where it is compact, so that a
    hot group is spread over many leaves."""
    rng = np.random.default_rng(seed)
    x = np.asarray(x, np.float32)

    def dispersion(rows):
        p = x[rows]
        c = p.mean(0)
        return float(((p - c) ** 2).sum())

    nodes: list = []  # [normal, offset, left, right]
    heap: list = []
    slots: dict[int, tuple] = {}  # leaf ticket -> (parent, side, rows, depth)
    ticket = 0

    def push(parent, side, rows, depth):
        nonlocal ticket
        slots[ticket] = (parent, side, rows, depth)
        d = dispersion(rows) if len(rows) else 0.0
        heapq.heappush(heap, (0 if len(rows) > max_leaf else 1, -d, ticket))
        ticket += 1

    push(-1, 0, np.arange(len(x)), 0)
    done, deepest = 0, 0
    final: list[int] = []
    while heap:
        forced, disp, t = heapq.heappop(heap)
        parent, side, rows, depth = slots[t]
        enough = len(final) + len(heap) + 1 >= leaves
        split = None
        if len(rows) >= 2 and not (enough and forced):
            split = _two_means(x[rows], rounds, rng)
        if split is None:
            final.append(t)
            continue
        w, off, right = split
        nodes.append([w, off, 0, 0])
        me = len(nodes) - 1
        if parent >= 0:
            nodes[parent][2 + side] = me
        deepest = max(deepest, depth + 1)
        del slots[t]
        push(me, 0, rows[~right], depth + 1)
        push(me, 1, rows[right], depth + 1)
    for leaf, t in enumerate(final):
        parent, side, _, _ = slots[t]
        if parent >= 0:
            nodes[parent][2 + side] = -1 - leaf
    return _pack(nodes, len(final), deepest, x.shape[1] if x.ndim == 2 else 0)


def _pack(nodes, leaves, depth, width) -> SplitTree:
    if not nodes:
        return SplitTree(np.zeros((0, width), np.float32), np.zeros(0, np.float32), np.zeros(0, np.int32), np.zeros(0, np.int32), 1, 0)
    normal = np.array([n[0] for n in nodes])
    return SplitTree(
        normal.astype(np.float32) if normal.ndim == 2 else normal.astype(np.int32),
        np.array([n[1] for n in nodes], np.float32),
        np.array([n[2] for n in nodes], np.int32),
        np.array([n[3] for n in nodes], np.int32),
        leaves,
        depth,
    )


def fit_kd(p: np.ndarray, max_leaf: int) -> SplitTree:
    """kd-tree over projected points: each node of more than ``max_leaf``
    sample points is cut at the median of its widest coordinate."""
    nodes: list = []
    leaves, deepest = 0, 0
    stack = [(-1, 0, np.arange(len(p)), 0)]
    while stack:
        parent, side, rows, depth = stack.pop()
        me = None
        if len(rows) > max_leaf:
            q = p[rows]
            d = int(np.argmax(q.std(0)))
            cut = float(np.median(q[:, d]))
            right = q[:, d] - np.float32(cut) >= 0
            if right.any() and not right.all():
                nodes.append([d, cut, 0, 0])
                me = len(nodes) - 1
                stack += [(me, 0, rows[~right], depth + 1), (me, 1, rows[right], depth + 1)]
                deepest = max(deepest, depth + 1)
        if me is None:
            me = -1 - leaves
            leaves += 1
        if parent >= 0:
            nodes[parent][2 + side] = me
    return _pack(nodes, leaves, deepest, 0)


def _first_in(segment: np.ndarray, hit: np.ndarray, count: int) -> np.ndarray:
    """Position of the first row of each segment where ``hit`` holds."""
    at = np.flatnonzero(hit)
    seg = segment[at]
    new = np.ones(len(at), bool)
    new[1:] = seg[1:] != seg[:-1]
    out = np.zeros(count, np.int64)
    out[seg[new]] = at[new]
    return out


def _along(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, y)


def compact_leaves(x: np.ndarray, limit: float, floor: int = 1, rounds: int = 2):
    """``(leaf, medoid, low)`` of unit rows: bisecting k-means over all of them.
    A node is a leaf when each of its rows is at least ``limit`` similar to its
    medoid, the row nearest to its centre; ``low`` is the least such
    similarity. Every other node is split by 2-means: as each has to be, the
    order doesn't matter, and a whole level is split at once. What is left of
    nodes of at most ``floor`` rows becomes leaves of one row each."""
    n, width = x.shape
    leaf = np.zeros(n, np.int64)
    medoids, lows, done = [], [], 0
    rows, start = np.arange(n), np.zeros(min(n, 1), np.int64)
    level = 0
    while len(rows):
        size = np.diff(np.append(start, len(rows)))
        node = np.repeat(np.arange(len(start)), size)
        y = x[rows]
        centre = np.add.reduceat(y, start, axis=0)
        centre /= np.maximum(np.sqrt(_along(centre, centre)), 1e-20)[:, None]
        near = _along(y, centre[node])
        medoid = _first_in(node, near == np.maximum.reduceat(near, start)[node], len(start))
        to_medoid = _along(y, y[medoid][node])
        to_medoid[medoid] = 1.0
        low = np.minimum.reduceat(to_medoid, start)
        good = (low >= limit) | (size == 1)
        if good.any():
            number = np.cumsum(good) - 1 + done
            at = good[node]
            leaf[rows[at]] = number[node[at]]
            medoids.append(rows[medoid[good]])
            lows.append(np.where(size[good] == 1, 1.0, low[good]))
            done += int(good.sum())
        loose = ~good & (size <= floor)
        if loose.any():
            single = rows[loose[node]]
            leaf[single] = done + np.arange(len(single))
            medoids.append(single)
            lows.append(np.ones(len(single)))
            done += len(single)
        left = ~good & ~loose
        if not left.any():
            break
        keep = left[node]
        rows, y, near, size = rows[keep], y[keep], near[keep], size[left]
        start = np.cumsum(size) - size
        node = np.repeat(np.arange(len(size)), size)
        a = y[_first_in(node, near == np.minimum.reduceat(near, start)[node], len(size))]
        far = _along(y, a[node])
        b = y[_first_in(node, far == np.minimum.reduceat(far, start)[node], len(size))]
        for r in range(rounds + 1):
            lean = _along(y, (b - a)[node])
            side = lean >= 0
            if r == rounds:
                break
            ones = np.add.reduceat(y * side[:, None], start, axis=0)
            rest = np.add.reduceat(y, start, axis=0) - ones
            for c in (ones, rest):
                c /= np.maximum(np.sqrt(_along(c, c)), 1e-20)[:, None]
            a, b = rest, ones
        right = np.add.reduceat(side, start, dtype=np.int64)
        stuck = (right == 0) | (right == size)
        if level >= 24:  # an end for what 2-means only peels
            stuck |= np.minimum(right, size - right) < size // 4
        if stuck.any():
            order = np.lexsort((lean, node))
            place = np.empty(len(rows), np.int64)
            place[order] = np.arange(len(rows)) - start[node]
            side = np.where(stuck[node], place >= (size // 2)[node], side)
        order = np.lexsort((side, node))
        rows = rows[order]
        cut = node[order] * 2 + side[order]
        start = np.flatnonzero(np.append(True, cut[1:] != cut[:-1]))
        level += 1
    cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return leaf, cat(medoids, np.int64), cat(lows, np.float64)

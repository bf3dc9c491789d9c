"""A cover tree over norm-augmented vectors, and its search by many queries at once.

A vector x gets one more component, sqrt(M * M - |x| * |x|), so that all have the length M of the longest; a query gets a zero.
Then |q - x|^2 = |q|^2 + M^2 - 2 q.x: a node's centre and covering radius bound the inner products of all its vectors from both sides.

A node's children have centres that cover its vectors within half of its radius, its own centre being the first of them; each vector
belongs to its nearest centre, and the covering radius that is kept is the one reached. A node of few vectors, and
a centre that covers itself alone, hold vectors directly.

Queries descend together, best first: of the open nodes the one with the largest bound of any query that still needs it comes next. A query
needs a node as long as some window of its wanted scores meets the node's bounds and could still take one of its vectors.
Vectors' scores are sums of integers below 2 ** 52, so doubles hold them exactly.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

#: Vectors of a node that isn't split.
LEAF = 32
#: Room for rounding in bounds, as a part of |q|^2 + M^2.
SLACK = 1e-6
NONE = np.iinfo(np.int64).max


@dataclass
class Tree:
    """Vectors with ids and labels; per node its centre, covering radius, children and own vectors."""

    vectors: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    longest: float
    centre: list[int]
    radius: list[float]
    children: list[np.ndarray]
    own: list[np.ndarray]


def build(vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray, leaf: int = LEAF) -> Tree:
    x = vectors.astype(np.float64)
    norms = (x * x).sum(axis=1)
    top = float(norms.max(initial=0))
    extra = np.sqrt(top - norms)
    gram = x @ x.T + np.outer(extra, extra)  # a block of bounded size
    far = lambda c, rows: np.sqrt(np.maximum(2 * top - 2 * gram[c, rows], 0))
    tree = Tree(vectors, ids, labels, top, [], [], [], [])
    todo = [(0, np.arange(len(x)), None)] if len(x) else []
    while todo:
        c, rows, parent = todo.pop()
        near = far(c, rows)
        node = len(tree.centre)
        tree.centre.append(c)
        tree.radius.append(float(near.max()))
        tree.children.append(np.zeros(0, np.int64))
        tree.own.append(np.zeros(0, np.int64))
        if parent is not None:
            tree.children[parent] = np.append(tree.children[parent], node)
        reach = tree.radius[node] / 2
        if len(rows) <= leaf or reach * reach <= SLACK * top:
            tree.own[node] = rows
            continue
        centres, of = [c], np.zeros(len(rows), np.int64)
        while near.max() > reach:
            centres.append(int(rows[np.argmax(near)]))
            d = far(centres[-1], rows)
            closer = d < near
            near[closer], of[closer] = d[closer], len(centres) - 1
        size = np.bincount(of, minlength=len(centres))
        tree.own[node] = rows[size[of] == 1]
        order = np.argsort(of, kind="stable")
        edge = np.r_[0, np.cumsum(size)]
        todo += [(centres[k], rows[order[edge[k] : edge[k + 1]]], node) for k in np.flatnonzero(size > 1).tolist()]
    return tree


class Top:
    """Of each query and window [low, high] the best ``k`` (score, id): higher scores first, then smaller ids."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low.astype(np.float64), high.astype(np.float64), k
        self.score = np.full((*low.shape, k), -np.inf)
        self.id = np.full((*low.shape, k), NONE, np.int64)

    def needs(self, rows: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Whether these queries can still take scores from [least, most]; the two may have more axes."""
        out = np.zeros(most.shape, bool)
        for w in range(self.low.shape[1]):
            floor = np.maximum(self.low[rows, w], self.score[rows, w, -1])
            high = self.high[rows, w]
            if most.ndim > 1:
                floor, high = floor[:, None], high[:, None]
            out |= (most >= floor) & (least <= high)
        return out

    def offer(self, rows: np.ndarray, scores: np.ndarray, allowed) -> None:
        """Scores (query, vector); ``allowed(i, j)`` gives which of these pairs count, and the ids of their vectors."""
        width = self.low.shape[1]
        floor = np.maximum(self.low[rows], self.score[rows, :, -1])
        q, c = np.nonzero((scores >= floor.min(axis=1)[:, None]) & (scores <= self.high[rows].max(axis=1)[:, None]))
        ok, ids = allowed(rows[q], c)
        q, c, ids = q[ok], c[ok], ids[ok]
        found = scores[q, c]
        for w in range(width):
            on = np.flatnonzero((found >= floor[q, w]) & (found <= self.high[rows[q], w]))
            if not len(on):
                continue
            if len(on) > 8 * self.k * len(rows):  # at first: only what is among a query's best here
                part = np.full(scores.shape, -np.inf)
                part[q[on], c[on]] = found[on]
                bar = np.partition(part, -min(self.k, part.shape[1]), axis=1)[:, -min(self.k, part.shape[1])]
                on = on[found[on] >= bar[q[on]]]
            touched = np.unique(q[on])
            at = rows[touched]
            owner = np.concatenate([np.repeat(touched, self.k), q[on]])
            score = np.concatenate([self.score[at, w].ravel(), found[on]])
            ident = np.concatenate([self.id[at, w].ravel(), ids[on]])
            order = np.lexsort((ident, -score, owner))
            owner, score, ident = owner[order], score[order], ident[order]
            take = np.searchsorted(owner, touched)[:, None] + np.arange(self.k)
            self.score[at, w], self.id[at, w] = score[take], ident[take]


def search(tree: Tree, queries: np.ndarray, norms: np.ndarray, top: Top, allowed) -> int:
    """Offer to ``top`` all that it needs of the tree; ``allowed(queries, ids, labels)`` tells which pairs count. Returns the scores computed."""
    if not tree.centre:
        return 0
    done = 0
    everyone = np.arange(len(queries))
    wide = np.full(len(queries), np.inf)
    heap = [(-np.inf, 0, everyone, -wide, wide)]
    while heap:
        _, node, rows, least, most = heapq.heappop(heap)
        on = top.needs(rows, least, most)
        rows = rows[on]
        if not len(rows):
            continue
        own, kids = tree.own[node], tree.children[node]
        places = np.concatenate([own, np.array([tree.centre[k] for k in kids], np.int64)])
        scores = queries[rows] @ tree.vectors[places].astype(np.float64).T
        done += scores.size
        if len(own):
            top.offer(rows, scores[:, : len(own)], lambda i, j, at=own: (allowed(i, tree.ids[at[j]], tree.labels[at[j]]), tree.ids[at[j]]))
        if len(kids):
            radius = np.array([tree.radius[k] for k in kids])
            whole = (norms[rows] + tree.longest)[:, None]
            d = np.sqrt(np.maximum(whole - 2 * scores[:, len(own) :], 0))
            room = SLACK * whole + 1e-3
            most = (whole - np.maximum(d - radius, 0) ** 2) / 2 + room
            least = (whole - (d + radius) ** 2) / 2 - room
            need = top.needs(rows, least, most)
            for j, k in enumerate(kids.tolist()):
                n = need[:, j]
                if n.any():
                    heapq.heappush(heap, (-float(most[n, j].max()), k, rows[n], least[n, j], most[n, j]))
    return done

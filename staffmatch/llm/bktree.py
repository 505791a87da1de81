"""Burkhard-Keller trees over 64-bit fingerprints, many trees at a time in flat arrays.

A child hangs on its parent by the integer Hamming distance between them. A search within radius r from a node
at distance d follows only the edges d-r to d+r.
"""

from __future__ import annotations

import numpy as np


class Forest:
    """One tree per shard; `roots[i]` is the index of the root of item i's tree. Values differ within a tree."""

    def __init__(self, values: np.ndarray, roots: np.ndarray) -> None:
        self.values, self.roots = values, roots
        n = len(values)
        self.parent, self.edge = np.full(n, -1), np.full(n, -1)
        at, waiting = roots.copy(), np.flatnonzero(np.arange(n) != roots)
        while waiting.size:  # all items that wait at a node got there in the same step
            gap = np.bitwise_count(values[waiting] ^ values[at[waiting]]).astype(np.int64)
            _, first, place = np.unique(at[waiting] * 65 + gap, return_index=True, return_inverse=True)
            child = waiting[first]
            self.parent[child], self.edge[child] = at[child], gap[first]
            goes_to = child[place]
            on = waiting != goes_to
            waiting = waiting[on]
            at[waiting] = goes_to[on]
        hung = np.flatnonzero(self.parent >= 0)
        keys = self.parent[hung] * 65 + self.edge[hung]
        order = np.argsort(keys, kind="stable")
        self.children, self.keys = hung[order], keys[order]

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, other) of item indices at most `radius` apart in the query's own tree, query < other."""
        found_q, found_n = [], []
        q, node = queries, self.roots[queries]
        while q.size:
            gap = np.bitwise_count(self.values[q] ^ self.values[node]).astype(np.int64)
            hit = (gap <= radius) & (q < node)
            found_q.append(q[hit])
            found_n.append(node[hit])
            low = np.searchsorted(self.keys, node * 65 + np.maximum(gap - radius, 1))
            high = np.searchsorted(self.keys, node * 65 + np.minimum(gap + radius, 64), side="right")
            many = high - low
            ends = np.cumsum(many)
            q = np.repeat(q, many)
            node = self.children[np.arange(len(q)) - np.repeat(ends - many, many) + np.repeat(low, many)]
        return np.concatenate(found_q or [queries[:0]]), np.concatenate(found_n or [queries[:0]])


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the pairs: every item points to the smallest item of its set."""
    while True:
        la, lb = labels[a], labels[b]
        if np.array_equal(la, lb):
            return labels
        low = np.minimum(la, lb)
        np.minimum.at(labels, la, low)
        np.minimum.at(labels, lb, low)
        while not np.array_equal(up := labels[labels], labels):
            labels = up

"""The first k of many queries, kept while rows stream by: what a task holds does not grow with what it reads."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Scores nearer than this to the k-th may tie with it once they are rounded to 6 digits.
EDGE = 2e-6
#: Cells of a matrix of scores that is looked at at once, and candidates that wait at least before they are cut.
CELLS, WAITING = 1 << 21, 1 << 18


class Best:
    """Candidates (query, key, scores) of ``n`` queries; of each what is among the first ``k`` by any of the scores
    stays, ties within EDGE included. What lies below all edges known so far is not even held."""

    def __init__(self, n: int, k: int, by: int = 1):
        self.n, self.k = n, k
        self.edges = np.full((by, n), -np.inf)
        self.held: list[tuple[np.ndarray, ...]] = []
        self.waiting, self.most = 0, max(WAITING, 2 * n * k * by)

    def add(self, q: np.ndarray, keys: np.ndarray, *scores: np.ndarray) -> None:
        if not len(q):
            return
        keep = np.zeros(len(q), bool)
        for edge, score in zip(self.edges, scores, strict=True):
            keep |= score >= edge[q]
        if keep.any():
            self.held.append((q[keep], keys[keep], *(s[keep] for s in scores)))
            self.waiting += len(self.held[-1][0])
            if self.waiting > self.most:
                self.cut()

    def add_matrix(self, scores: np.ndarray, keys: np.ndarray, q: np.ndarray, again: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> None:
        """A row of scores for each of the queries ``q``; -inf is no candidate. ``again`` gives the scores of
        candidates (queries, columns) anew, where a product of matrices is not exact to the last digit."""
        over = (scores >= self.edges[0, q, None]) & (scores > -np.inf)
        if scores.shape[1] > self.k and over.sum() > self.k * len(scores):
            over &= scores >= np.partition(scores, -self.k, axis=1)[:, -self.k, None] - EDGE
        row, at = np.nonzero(over)
        self.add(q[row], keys[at], again(q[row], at) if again else scores[row, at])

    def cut(self) -> None:
        q, keys, *scores = (np.concatenate(x) for x in zip(*self.held, strict=True))
        keep = np.zeros(len(q), bool)
        for edge, score in zip(self.edges, scores, strict=True):
            order = np.lexsort((-score, q))
            place = np.arange(len(q)) - np.searchsorted(q[order], q[order], "left")
            at = order[place == self.k - 1]
            edge[q[at]] = np.maximum(edge[q[at]], score[at] - EDGE)
            keep |= score >= edge[q]
        self.held = [(q[keep], keys[keep], *(s[keep] for s in scores))]
        self.waiting = int(keep.sum())
        self.most = max(self.most, 2 * self.waiting)  # many ties

    def result(self) -> tuple[np.ndarray, ...] | None:
        """query, key and scores of all that stays; None without any."""
        if not self.held:
            return None
        self.cut()
        return self.held[0]

"""Balanced centroids of unit vectors and a graph over them that is searched in memory."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: rounds of priced assignment after the bisection
ROUNDS = 6
#: edges a centroid keeps, edges looked at for that, and places a search opens at once
DEGREE, LOOKED_AT, WIDTH = 16, 48, 4
#: vectors that are searched together
TOGETHER = 256


def unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def halves(x: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Two parts of given shares, cut across the line between the centres of two-means."""
    far = int(np.argmin(x @ x.mean(axis=0)))
    ends = np.stack([x[far], x[int(np.argmin(x @ x[far]))]])
    for _ in range(4):
        near = np.argmax(x @ ends.T, axis=1)
        if near.min() == near.max():
            break
        ends = unit(np.stack([x[near == i].mean(axis=0) for i in (0, 1)]))
    order = np.argsort(x @ (ends[1] - ends[0]), kind="stable")
    cut = round(len(x) * share)
    return order[:cut], order[cut:]


def bisected(x: np.ndarray, lists: int) -> np.ndarray:
    """Means of `lists` parts of equal size, neighbours in the order of the cuts."""
    if lists == 1:
        return x.mean(axis=0, keepdims=True)
    one, two = halves(x, (lists // 2) / lists)
    return np.concatenate([bisected(x[one], lists // 2), bisected(x[two], lists - lists // 2)])


def balanced_centroids(x: np.ndarray, lists: int) -> np.ndarray:
    """Unit centroids of unit vectors: bisection, then rounds in which a full list asks a higher price."""
    centres, price = unit(bisected(x, lists)), np.zeros(lists, x.dtype)
    for _ in range(ROUNDS):
        near = np.concatenate([np.argmax(x[i:i + 1024] @ centres.T - price, axis=1) for i in range(0, len(x), 1024)])
        size = np.bincount(near, minlength=lists)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = np.where(size[:, None] > 0, unit(total), centres)
        price += (0.05 * np.clip(size * lists / len(x) - 1, -1, 1)).astype(x.dtype)
    return centres


@dataclass
class Graph:
    """Centroids, the neighbours of each (padded with the number of centroids), and the hubs a search starts from."""

    centres: np.ndarray
    near: np.ndarray
    hubs: np.ndarray

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The centroids nearest to each unit vector that a best-first search with `beam` places ends with.

        Returns ids and cosines, nearest first; places that stay empty have the id -1.
        """
        how = self._scan if 4 * beam >= len(self.centres) else self._search
        parts = [how(x[i:i + TOGETHER], beam) for i in range(0, len(x), TOGETHER)]
        return tuple(np.concatenate(p) for p in zip(*parts))

    def _scan(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """All centroids are looked at: a search that holds a quarter of them would open most, one by one."""
        cos = x @ self.centres.T
        ids = np.sort(np.argpartition(-cos, min(beam, cos.shape[1]) - 1, axis=1)[:, :beam], axis=1)
        cos = np.take_along_axis(cos, ids, 1)
        order = np.argsort(-cos, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(cos, order, 1)

    def _search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        n, count = len(x), len(self.centres)
        centres = np.vstack([self.centres, np.zeros((1, self.centres.shape[1]), self.centres.dtype)])
        rows = np.arange(n)[:, None]
        ids, cos = np.full((n, beam), count), np.full((n, beam), -np.inf)
        opened, seen = np.ones((n, beam), bool), np.zeros((n, count + 1), bool)
        seen[:, count] = True
        found = np.broadcast_to(self.hubs, (n, len(self.hubs)))
        live = np.arange(n)
        while len(live):
            found = np.sort(found, axis=1)
            fresh = ~seen[live[:, None], found]
            fresh[:, 1:] &= found[:, 1:] != found[:, :-1]
            seen[live[:, None], found] = True
            score = np.where(fresh, np.einsum("nd,nkd->nk", x[live], centres[found]), -np.inf)
            every = np.hstack([cos[live], score])
            best = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
            at = np.arange(len(live))[:, None]
            cos[live] = every[at, best]
            ids[live] = np.hstack([ids[live], found])[at, best]
            opened[live] = np.hstack([opened[live], ~fresh])[at, best]
            waiting = np.where(opened, -np.inf, cos)
            live = np.flatnonzero((waiting > -np.inf).any(axis=1))
            if len(live):
                width = min(WIDTH, beam)
                pick = np.argpartition(-waiting[live], width - 1, axis=1)[:, :width]
                held = np.where(opened[live[:, None], pick], count, ids[live[:, None], pick])
                opened[live[:, None], pick] = True
                found = np.vstack([self.near, np.full((1, self.near.shape[1]), count)])[held].reshape(len(live), -1)
        order = np.argsort(-cos, axis=1, kind="stable")
        ids, cos = ids[rows, order], cos[rows, order]
        return np.where(cos > -np.inf, ids, -1), cos


def graph_over(centres: np.ndarray) -> Graph:
    """Links each centroid to near ones that lie in different directions, both ways, and to the next in order."""
    n = len(centres)
    looked_at = min(LOOKED_AT, n - 1)
    links = [set() for _ in range(n)]
    for at in range(0, n, 512):
        cos = centres[at:at + 512] @ centres.T
        cos[np.arange(len(cos)), np.arange(at, at + len(cos))] = -np.inf
        if not looked_at:
            break
        nearest = np.argpartition(-cos, looked_at - 1, axis=1)[:, :looked_at]
        for i, row in enumerate(nearest):
            row = row[np.argsort(-cos[i, row], kind="stable")]
            among = centres[row] @ centres[row].T
            kept: list[int] = []
            for k in range(len(row)):
                if len(kept) < DEGREE and (among[k, kept] < cos[i, row[k]]).all():
                    kept.append(k)
            rest = [k for k in range(len(row)) if k not in kept]
            links[at + i].update(row[(kept + rest)[:DEGREE]].tolist())
    for i in range(n):
        for j in list(links[i]):
            if len(links[j]) < 2 * DEGREE:
                links[j].add(i)
        if i + 1 < n:
            links[i].add(i + 1)
            links[i + 1].add(i)
    near = np.full((n, max(1, max(map(len, links)))), n)
    for i, held in enumerate(links):
        near[i, :len(held)] = sorted(held)
    step = max(1, round(n ** 0.5))
    return Graph(centres, near, np.arange(step // 2, n, step))

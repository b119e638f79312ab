"""Linear-chain conditional random fields: fitting on a small table, Viterbi decoding in numpy batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Chain:
    """Feature names to rows of `emit` (features x labels), and label-to-label weights."""

    labels: list[str]
    index: dict[str, int]
    emit: np.ndarray
    move: np.ndarray

    def emissions(self, sequence: list[list[str]]) -> np.ndarray:
        """(tokens, labels): sums of the weights of each token's known features."""
        out = np.zeros((len(sequence), len(self.labels)))
        for t, features in enumerate(sequence):
            at = [self.index[f] for f in features if f in self.index]
            if at:
                out[t] = self.emit[at].sum(axis=0)
        return out


def best_paths(emissions: list[np.ndarray], move: np.ndarray) -> list[np.ndarray]:
    """The best label path of each sequence, all sequences in step; ties go to the first label.

    Sequences are sorted by length, so that those that have ended drop out of the step.
    """
    if not emissions:
        return []
    order = sorted(range(len(emissions)), key=lambda i: -len(emissions[i]))
    lens = np.array([len(emissions[i]) for i in order])
    longest, n_labels = int(lens[0]), move.shape[0]
    score = np.zeros((len(order), n_labels))
    back = []
    alive = [int((lens > t).sum()) for t in range(longest)]
    for t in range(longest):
        now = np.stack([emissions[i][t] for i in order[:alive[t]]])
        if t:
            step = score[:alive[t], :, None] + move[None]
            from_ = step.argmax(axis=1)
            score[:alive[t]] = step.max(axis=1) + now
            back.append(from_.astype(np.int16))
        else:
            score[:alive[0]] = now
    paths: list[np.ndarray] = [np.zeros(0, int)] * len(emissions)
    for row, i in enumerate(order):
        n = int(lens[row])
        path = np.zeros(n, int)
        if n:
            path[-1] = int(score[row].argmax())
            for t in range(n - 1, 0, -1):
                path[t - 1] = back[t - 1][row, path[t]]
        paths[i] = path
    return paths


def log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis)
    return top + np.log(np.exp(a - np.expand_dims(top, axis)).sum(axis=axis))


def fitted(table: list[tuple[list[list[str]], list[str]]], labels: list[str], epochs: int = 12, rate: float = 0.5,
           shrink: float = 1e-3, seed: int = 9) -> Chain:
    """Adagrad on the conditional likelihood of (features per token, label per token) sequences."""
    index = {f: i for i, f in enumerate(sorted({f for seq, _ in table for fs in seq for f in fs}))}
    n = len(labels)
    place = {x: i for i, x in enumerate(labels)}
    chain = Chain(labels, index, np.zeros((len(index), n)), np.zeros((n, n)))
    g_emit, g_move = np.full(chain.emit.shape, 1e-6), np.full((n, n), 1e-6)
    rows = [([[index[f] for f in fs] for fs in seq], np.array([place[x] for x in y]), ) for seq, y in table if seq]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            seq, y = rows[r]
            size = len(seq)
            flat = np.concatenate([np.asarray(fs, int) for fs in seq])
            owner = np.repeat(np.arange(size), [len(fs) for fs in seq])
            e = np.zeros((size, n))
            np.add.at(e, owner, chain.emit[flat])
            ahead, behind = e.copy(), np.zeros((size, n))
            for t in range(1, size):
                ahead[t] += log_sum(ahead[t - 1][:, None] + chain.move, 0)
            for t in range(size - 2, -1, -1):
                behind[t] = log_sum(chain.move + (e[t + 1] + behind[t + 1])[None], 1)
            total = log_sum(ahead[-1], 0)
            grad = np.exp(ahead + behind - total)
            grad[np.arange(size), y] -= 1
            d_move = np.zeros((n, n))
            for t in range(1, size):
                d_move += np.exp(ahead[t - 1][:, None] + chain.move + (e[t] + behind[t])[None] - total)
                d_move[y[t - 1], y[t]] -= 1
            used, inverse = np.unique(flat, return_inverse=True)
            d_emit = np.zeros((len(used), n))
            np.add.at(d_emit, inverse, grad[owner])
            d_emit += shrink * chain.emit[used]
            g_emit[used] += d_emit ** 2
            g_move += d_move ** 2
            chain.emit[used] -= rate * d_emit / np.sqrt(g_emit[used])
            chain.move -= rate * (d_move + shrink * chain.move) / np.sqrt(g_move)
    return chain

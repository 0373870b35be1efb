"""A linear-chain conditional random field in numpy: batched training and batched Viterbi decoding."""

from __future__ import annotations

import numpy as np


def pad(chains: list[np.ndarray], fill: int = -1) -> np.ndarray:
    """Chains of equal-width rows, padded to the longest."""
    out = np.full((len(chains), max(map(len, chains)), *chains[0].shape[1:]), fill)
    for row, c in zip(out, chains, strict=True):
        row[: len(c)] = c
    return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


class LinearChain:
    """Emission weights (features x labels), transitions and start weights. Feature -1 is no feature."""

    def __init__(self, features: int, labels: int):
        self.labels = labels
        self.w = np.zeros((features + 1, labels))  # the last row is for -1
        self.trans, self.start = np.zeros((labels, labels)), np.zeros(labels)

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """x: (chains, steps, features per step) feature numbers."""
        return self.w[x].sum(2)

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.08, l2: float = 1e-3) -> None:
        """Maximum likelihood by Adam. y: labels, -1 beyond the end of a chain."""
        n, steps = y.shape
        live = y >= 0
        rows = np.arange(n)
        gold = np.zeros((n, steps, self.labels))
        gold[live, y[live]] = 1
        params = [self.w, self.trans, self.start]
        m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        pair = live[:, 1:]
        gold_trans = np.zeros_like(self.trans)
        np.add.at(gold_trans, (y[:, :-1][pair], y[:, 1:][pair]), 1)
        for t in range(1, rounds + 1):
            e = self.emissions(x)
            alpha = np.empty_like(e)
            alpha[:, 0] = self.start + e[:, 0]
            for k in range(1, steps):
                step = _lse(alpha[:, k - 1, :, None] + self.trans, 1) + e[:, k]
                alpha[:, k] = np.where(live[:, k, None], step, alpha[:, k - 1])
            z = _lse(alpha[:, -1], 1)
            beta = np.zeros_like(e)
            expected = np.zeros_like(self.trans)
            for k in range(steps - 2, -1, -1):
                ahead = e[:, k + 1] + beta[:, k + 1]
                beta[:, k] = np.where(live[:, k + 1, None], _lse(self.trans + ahead[:, None, :], 2), 0)
                both = np.exp(alpha[:, k, :, None] + self.trans + ahead[:, None, :] - z[:, None, None])
                expected += (both * live[:, k + 1, None, None]).sum(0)
            p = np.exp(alpha + beta - z[:, None, None]) * live[:, :, None]
            diff = (p - gold) * live[:, :, None]
            gw = np.zeros_like(self.w)
            for f in range(x.shape[2]):
                np.add.at(gw, x[:, :, f][live], diff[live])
            gw[-1] = 0
            grads = [gw / n + l2 * self.w, (expected - gold_trans) / n + l2 * self.trans, (p[rows, 0] - gold[rows, 0]).mean(0)]
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.99 * s[k] + 0.01 * g * g
                params[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8)

    def decode(self, x: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """The most likely labels of each chain, by Viterbi over the whole batch at once."""
        e = np.concatenate([self.emissions(x[:, k : k + 4096]) for k in range(0, x.shape[1], 4096)], 1)
        n, steps, _ = e.shape
        best, back = self.start + e[:, 0], np.zeros((n, steps, self.labels), np.int16)
        for k in range(1, steps):
            options = best[:, :, None] + self.trans
            back[:, k] = options.argmax(1)
            best = np.where((k < lengths)[:, None], options.max(1) + e[:, k], best)
        path = np.zeros((n, steps), np.int64)
        last = best.argmax(1)
        for k in range(steps - 1, -1, -1):
            path[:, k] = last
            last = np.where(k < lengths, back[np.arange(n), k, last], last) if k else last
        return [p[:m] for p, m in zip(path, lengths, strict=True)]

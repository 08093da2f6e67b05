"""A two-label linear-chain conditional random field over ragged sequences, in numpy.

A position's label is 0 or 1; `u` holds each position's score for label 1 against label 0, and `trans`
the log weights of label pairs. forward_backward gives exact marginals for many sequences at once: it
steps through positions, working on all sequences that are still running.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Below this many running sequences a step costs less in plain floats.
FEW = 6


def _order(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
    by_length = np.argsort(-lengths, kind="stable")
    return starts[by_length], lengths[by_length]


def forward_backward(u: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginal of label 1, forward filter of label 1, backward message of label 1), each per position.

    u: scores, sequences end to end; lengths: theirs, zeros allowed; trans: 2x2 log weights.
    """
    e = np.exp(np.clip(u, -30.0, 30.0))
    m00, m01, m10, m11 = np.exp(trans).ravel().tolist()
    starts, sizes = _order(np.asarray(lengths, np.int64))
    p, q = np.empty(len(u)), np.full(len(u), 0.5)
    longest = int(sizes[0]) if len(sizes) else 0
    running = np.searchsorted(-sizes, -np.arange(longest), "left")  # sequences longer than t
    few = int(np.searchsorted(-running, -FEW, "left")) if longest else 0  # from here on at most FEW run
    prev = np.zeros(0)
    for t in range(few):
        at = starts[: running[t]] + t
        x = e[at]
        if t:
            prev = prev[: running[t]]
            one, zero = x * (m01 + prev * (m11 - m01)), m00 + prev * (m10 - m00)
        else:
            one, zero = x, 1.0
        prev = one / (one + zero)
        p[at] = prev
    for s, n in zip(starts.tolist(), sizes.tolist()):
        if n <= few:
            break
        values, out = e[s + few : s + n].tolist(), []
        if few:
            a = float(p[s + few - 1])
        else:
            a = values[0] / (values[0] + 1.0)
            out.append(a)
            values = values[1:]
        for x in values:
            one, zero = x * (m01 + a * (m11 - m01)), m00 + a * (m10 - m00)
            a = one / (one + zero)
            out.append(a)
        p[s + few : s + n] = out
        values, out, b = e[s + few : s + n].tolist(), [], 0.5
        for x in reversed(values):
            out.append(b)
            one, zero = x * b, 1.0 - b
            up, down = m11 * one + m10 * zero, m01 * one + m00 * zero
            b = up / (up + down)
        q[s + few : s + n] = out[::-1]
        if few:
            q[s + few - 1] = b
    for t in range(few - 1, 0, -1):
        at = starts[: running[t]] + t
        one = e[at] * q[at]
        zero = 1.0 - q[at]
        up, down = m11 * one + m10 * zero, m01 * one + m00 * zero
        q[at - 1] = up / (up + down)
    one, zero = p * q, (1.0 - p) * (1.0 - q)
    return one / np.maximum(one + zero, 1e-300), p, q


def pair_marginals(u, lengths, trans, p, q) -> np.ndarray:
    """Expected counts of the four label pairs, summed over all sequences."""
    keep = np.ones(len(u), bool)
    keep[np.cumsum(lengths)[lengths > 0] - 1] = False
    at = np.flatnonzero(keep)
    e, m = np.exp(np.clip(u[at + 1], -30, 30)), np.exp(trans)
    one, zero = e * q[at + 1], 1 - q[at + 1]
    parts = np.stack([(1 - p[at]) * m[0, 0] * zero, (1 - p[at]) * m[0, 1] * one, p[at] * m[1, 0] * zero, p[at] * m[1, 1] * one])
    return (parts / parts.sum(0)).sum(1).reshape(2, 2)


@dataclass
class CRF:
    """weights of `size` binary features (a position's score is the sum over its active features), and trans."""

    size: int
    weights: np.ndarray = field(default=None)
    trans: np.ndarray = field(default=None)

    def fit(self, features: np.ndarray, labels: np.ndarray, lengths: np.ndarray, *, epochs: int = 60, rate: float = 0.2, l2: float = 1e-4) -> CRF:
        """Full-batch Adam on the log likelihood. features: (positions, k) feature numbers, -1 for none."""
        lengths = np.asarray(lengths, np.int64)
        columns = [(np.flatnonzero(f >= 0), f) for f in features.T]
        columns = [(at, f[at].astype(np.int64)) for at, f in columns]
        w, t = np.zeros(self.size), np.zeros((2, 2))
        keep = np.ones(len(labels), bool)
        keep[np.cumsum(lengths)[lengths > 0] - 1] = False
        at = np.flatnonzero(keep)
        seen = np.bincount(labels[at] * 2 + labels[np.minimum(at + 1, len(labels) - 1)], minlength=4).reshape(2, 2)
        n = max(1, len(labels))
        m = [np.zeros_like(w), np.zeros_like(t)]
        v = [np.zeros_like(w), np.zeros_like(t)]
        for k in range(1, epochs + 1):
            u = np.zeros(len(labels))
            for rows, cells in columns:
                u[rows] += w[cells]
            marginal, p, q = forward_backward(u, lengths, t)
            left = labels - marginal
            gw = sum(np.bincount(cells, left[rows], self.size) for rows, cells in columns) / n - l2 * w
            gt = (seen - pair_marginals(u, lengths, t, p, q)) / n - l2 * t
            for i, (x, g) in enumerate(((w, gw), (t, gt))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                x += rate * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.999**k)) + 1e-9)
        self.weights, self.trans = w, t - t[0, 0]
        return self

    def scores(self, features: np.ndarray) -> np.ndarray:
        """A position's score, a feature column at a time."""
        out = np.zeros(len(features))
        for f in features.T:
            out += np.where(f >= 0, self.weights[f], 0.0)
        return out


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 30) -> np.ndarray:
    """Newton's method; the last weight is the intercept. One class only gives that class' share."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    pull = np.full(x.shape[1], l2 * max(1, len(x)))
    pull[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - pull * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(h, g)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(x))]) @ w, -30, 30)))

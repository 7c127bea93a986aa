"""Expectation-maximisation over the votes of overlapping labellers."""

from __future__ import annotations

import numpy as np


def posteriors(patterns: dict[str, int], labellers: int, steps: int = 500, start: tuple[float, float] = (0.9, 0.02), most: bool = False) -> tuple[dict[str, float], np.ndarray, float]:
    """Pattern of votes -> probability of class 1, from the counts of all patterns.

    A pattern has a digit for each labeller: 1 and 2 vote for these classes, 0 for none. Also returns how each
    labeller votes, [class - 1, labeller, vote], and the share of class 1. Starts from "1 where any labeller says
    so", or (`most`) where more labellers say 1 than 2; a labeller may not come to vote 1 more often on members of
    class 2, nor (`most`) 2 more often on members of class 1; and (`most`) what no labeller says 1 of doesn't become
    more probable than at the start, however well it stands out.
    """
    if not patterns:
        return {}, np.full((2, labellers, 3), 1 / 3), 0.5
    keys = sorted(patterns)
    v = np.array([[int(c) for c in k] for k in keys])
    n = np.array([patterns[k] for k in keys], float)
    one = np.stack([v == x for x in range(3)], -1).astype(float)
    first = np.where((v == 1).sum(1) > (v == 2).sum(1) if most else (v == 1).any(1), *start)
    share = 0.5
    for _ in range(steps):
        share = ((n * first).sum() + 1) / (n.sum() + 10)
        rate = np.stack([np.einsum("p,plv->lv", n * q, one) + 1 for q in (first, 1 - first)])
        rate /= rate.sum(-1, keepdims=True)
        rate[1, :, 1] = np.minimum(rate[1, :, 1], rate[0, :, 1])
        if most:
            rate[0, :, 2] = np.minimum(rate[0, :, 2], rate[1, :, 2])
        ll = np.einsum("plv,clv->pc", one, np.log(rate)) + np.log([share, 1 - share])
        first = 1 / (1 + np.exp(np.clip(ll[:, 1] - ll[:, 0], -500, 500)))
        if most:
            first = np.where((v == 1).any(1), first, np.minimum(first, start[1]))
    return dict(zip(keys, first.tolist(), strict=True)), rate, float(share)


def fit(x: np.ndarray, y: np.ndarray, steps: int = 400, decay: float = 2e-5) -> np.ndarray:
    """Weights and, last, the bias of a logistic model of soft labels y, by accelerated gradient descent. The last
    column of x is ones: the caller makes it, as x may be large."""
    w = z = np.zeros(x.shape[1], np.float32)
    rate = 4 / max(float(np.einsum("ij,ij->", x, x)) / max(len(x), 1), 1e-9)
    for i in range(steps):
        g = x.T @ (1 / (1 + np.exp(-np.clip(x @ z, -50, 50))) - y).astype(np.float32) / max(len(x), 1)
        g[:-1] += decay * z[:-1]
        step = z - rate * g
        z, w = step + i / (i + 3) * (step - w), step
    return w

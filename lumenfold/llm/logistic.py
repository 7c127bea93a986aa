"""Logistic models of tables of any size: executors sum the loss and its slope over all rows, the driver holds weights alone."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumenfold.llm.common import sliced

#: Steps of a descent at most, kept pairs of steps and slopes, and the share of the loss that a step must gain to go on.
STEPS, PAIRS, GAIN = 60, 10, 1e-4


def summed(rows: DataFrame, part: Callable[[pa.RecordBatch, np.ndarray], tuple[float, np.ndarray]], w: np.ndarray) -> tuple[float, np.ndarray]:
    """The sums of part(batch, w) over all rows: a loss and its slope. A task gives one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, slope = 0.0, np.zeros(len(w))
        for b in sliced(batches, 256):  # what is made of so many rows stays in cache
            some, way = part(b, w)
            loss, slope = loss + some, slope + way
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([slope.tobytes()], pa.binary())], names=["loss", "slope"])

    found = rows.mapInArrow(run, "loss double, slope binary").collect()
    return math.fsum(x[0] for x in found), sum((np.frombuffer(x[1]) for x in found), np.zeros(len(w)))


def losses(s: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row its logistic loss, for a soft label y, and the slope of that in s."""
    return np.logaddexp(0, s) - y * s, 1 / (1 + np.exp(-np.clip(s, -50, 50))) - y


def descended(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], size: int, first: float, decay: float, steps: int = STEPS) -> np.ndarray:
    """The weights of least loss (w -> loss, slope) plus decay x half their squares, the last one (a bias) not among
    these: L-BFGS from zero, its first step `first` x slope. A call of loss is a pass over the rows."""

    def whole(w: np.ndarray) -> tuple[float, np.ndarray]:
        value, slope = loss(w)
        return value + decay / 2 * float(w[:-1] @ w[:-1]), slope + decay * np.append(w[:-1], 0.0)

    w = np.zeros(size)
    value, slope = whole(w)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way, shares = -slope, []
        for s, g in reversed(pairs):
            shares.append((s @ way) / (s @ g))
            way = way - shares[-1] * g
        way = way * ((pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else first)
        for (s, g), a in zip(pairs, reversed(shares), strict=True):
            way = way + (a - (g @ way) / (s @ g)) * s
        down, much = float(slope @ way), 1.0
        while True:
            there = w + much * way
            new, turned = whole(there)
            if new <= value + 1e-4 * much * down or much < 1e-6:
                break
            # the least of the parabola through both losses and the slope here
            much *= min(max(-down * much / (2 * (new - value - down * much)), 0.1), 0.5)
        if not new < value:
            break
        if (s := there - w) @ (g := turned - slope) > 0:
            pairs = [*pairs[1 - PAIRS :], (s, g)]
        gained = value - new
        w, value, slope = there, new, turned
        if gained < GAIN * value:
            break
    return w

"""Operator 3: a quality classifier taught by overlapping heuristic labellers.

1. LABELLERS look at statistics of a whole text; each says junk, good or nothing.
2. The votes of all documents are counted by pattern (at most 3^10 rows, whatever the corpus).
   Expectation-maximisation over these counts estimates how each labeller votes on junk and on good
   documents, and gives each pattern its posterior probability of being good.
3. A linear model over hashed character n-grams learns the posteriors of all documents, equal ones once, and
   then scores every document. Their features are written once, and each step of the fit reads them all: executors
   sum the loss and its slope, and the driver holds weights alone.

Null texts count as empty ones; an empty text scores 0 and is rejected, as it holds nothing to train
on. Copies and repeated rows get equal scores; a score of exactly THRESHOLD is kept. Documents without an id are
documents like others. Texts are read whole, one at a time. Empty tables give empty results. Other
columns of the input pass through when `keep_columns` asks for them, whatever their names but for `names`.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.llm.common import code_points, drop_written, grams, map_rows, written
from lumenfold.llm.logistic import descended, losses, summed
from lumenfold.llm.weak_labels import posteriors

#: Hash buckets of the scorer; score from which a document is kept; steps of the fit, and its decay.
BUCKETS, THRESHOLD, STEPS, DECAY = 2048, 0.5, 30, 2e-5
LABELLERS = ("shouting", "exclaiming", "symbols", "table cells", "repeated lines", "repeated words", "digits", "prose marks", "sentence case", "varied words")
#: Features are scaled by it for the descent.
SCALE = 5

_LETTER, _UPPER, _SPACE, _DIGIT, _OTHER = range(5)
_CLASS = np.array([_SPACE if c.isspace() else _DIGIT if c.isdigit() else _UPPER if c.isupper() else _LETTER if c.isalpha() else _OTHER for c in map(chr, range(0x2000))], np.uint8)


def statistics(text: str, codes: np.ndarray) -> dict[str, float]:
    """Shares that the labellers look at, over the whole text."""
    kinds = np.bincount(_CLASS[np.minimum(codes, 0x1FFF)], minlength=5) / max(len(codes), 1)
    words, lines = text.split(), text.split("\n")
    w = max(len(words), 1)
    # windows of 100 words: the share of different words in a whole text falls with its length
    varied = sum(len(set(words[i : i + 100])) for i in range(0, len(words), 100)) / w
    repeats = sum(map(str.__eq__, words, words[1:])) / w
    return {
        "upper": kinds[_UPPER], "bang": text.count("!") / w, "other": kinds[_OTHER], "cells": text.count("|") / w, "digits": kinds[_DIGIT],
        "same lines": 1 - len(set(lines)) / len(lines) if len(lines) > 3 else 0.0, "varied": varied if w >= 20 else 1.0, "repeats": repeats, "long": float(w >= 20),
    }


def votes(s: dict[str, float]) -> str:
    """What each of LABELLERS says, given statistics(): 1 junk, 2 good, 0 nothing."""
    junk = (s["upper"] > 0.25, s["bang"] > 0.1, s["other"] > 0.12, s["cells"] > 0.1, s["same lines"] > 0.4, s["varied"] < 0.5 or s["repeats"] > 0.2, s["digits"] > 0.4)
    good = (0.005 < s["other"] < 0.06, 0.002 < s["upper"] < 0.1, s["long"] and s["varied"] > 0.75)
    return "".join("1" if x else "0" for x in junk) + "".join("2" if x else "0" for x in good)


def _hashed(codes: np.ndarray, s: dict[str, float], buckets: int) -> tuple[np.ndarray, list[int]]:
    """Counts of one to three characters by bucket, and the buckets of the statistics' bins."""
    h = np.concatenate([grams(codes, 1), grams(codes, 2), grams(codes, 3)])
    bins = [crc32(f"{name} {min(int(value * 10), 9)}".encode()) % buckets for name, value in s.items()]
    return np.bincount((h & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets), bins


def features(codes: np.ndarray, s: dict[str, float], buckets: int = BUCKETS) -> np.ndarray:
    """Square roots of hashed counts of one to three characters, at unit length (less for short texts, which
    say little), and hashed bins of the statistics."""
    counts, bins = _hashed(codes, s, buckets)
    x = np.sqrt(counts.astype(np.float32))
    x /= max(float(np.sqrt(x @ x)), 30.0)
    for i in bins:
        x[i] += 0.5
    return x


def packed(codes: np.ndarray, s: dict[str, float]) -> bytes:
    """What features() are made of: the counts, in as few bytes each as the largest needs; the bins; the sum of counts."""
    counts, bins = _hashed(codes, s, BUCKETS)
    most = int(counts.max())
    return counts.astype("u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes() + np.array(bins, "<u2").tobytes() + np.array([counts.sum()], "<u4").tobytes()


def loss_of(rows: list[bytes], y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Logistic loss of w over features() x SCALE of packed rows, with a bias last, and its slope. Roots of counts are
    never scaled as an array: what they are multiplied with is."""
    total, slope = 0.0, np.zeros(BUCKETS + 1)
    sizes = np.array([len(x) for x in rows])
    for size in np.unique(sizes).tolist():
        on = np.flatnonzero(sizes == size)
        raw = np.frombuffer(b"".join([rows[i] for i in on.tolist()]), np.uint8).reshape(len(on), size)
        width = size // BUCKETS
        root = np.sqrt(raw[:, : width * BUCKETS].view(f"<u{width}"), dtype=np.float32, casting="unsafe")
        bins = raw[:, width * BUCKETS : -4].view("<u2")
        scale = SCALE / np.maximum(np.sqrt(raw[:, -4:].copy().view("<u4")[:, 0].astype(np.float64)), 30)
        s = scale * (root @ w[:-1].astype(np.float32)) + SCALE / 2 * w[bins].sum(1) + w[-1]
        loss, e = losses(s, y[on])
        total += float(loss.sum())
        slope[:-1] += root.T @ (scale * e).astype(np.float32)
        slope[:-1] += np.bincount(bins.ravel(), np.repeat(SCALE / 2 * e, bins.shape[1]), BUCKETS)
        slope[-1] += e.sum()
    return total, slope


def train(docs: DataFrame, text: str = "text") -> dict:
    """The model: from one pass over the texts votes and features of all documents, from these the fit."""
    schema = T.StructType([T.StructField("pattern", T.StringType()), T.StructField("x", T.BinaryType())])

    def looked_at():
        def row(t):
            codes = code_points(t or "")
            s = statistics(t or "", codes)
            return votes(s), packed(codes, s)

        return row

    # equal documents are a row; each counts in the votes
    seen = map_rows(docs.select(F.col(text).alias("_text")), schema, [], looked_at, ["_text"])
    seen = written(seen.groupBy("pattern", "x").agg(F.count(F.lit(1)).alias("size")), "votes", codec="zstd")
    found = seen.groupBy("pattern").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    junk, rate, share = posteriors({r["pattern"]: r["size"] for r in found}, len(LABELLERS))
    n = sum(r["n"] for r in found)
    if not n:
        drop_written(seen)
        return {"w": np.zeros(BUCKETS + 1, np.float32), "rate": rate, "share": share}

    def part(b: pa.RecordBatch, w: np.ndarray) -> tuple[float, np.ndarray]:
        loss, slope = loss_of(b.column("x").to_pylist(), 1 - np.array([junk[p] for p in b.column("pattern").to_pylist()]), w)
        return loss / n, slope / n

    # a row's features have about the square SCALE^2 and the column of ones: a step that can't go too far
    w = descended(lambda w: summed(seen, part, w), BUCKETS + 1, 4 / (2 * SCALE**2), DECAY, STEPS)
    drop_written(seen)
    return {"w": w.astype(np.float32), "rate": rate, "share": share}


def score(docs: DataFrame, model: dict, text: str = "text", keep_columns: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("quality_score", "keep")) -> DataFrame:
    """The score (0 to 1) of every document and whether to keep it; names: of these columns."""
    w = model["w"]

    def scorer():
        def row(t):
            codes = code_points(t or "")
            s = 1 / (1 + float(np.exp(-np.clip(SCALE * (features(codes, statistics(t, codes)) @ w[:-1]) + w[-1], -50, 50)))) if len(codes) else 0.0
            return s, s >= THRESHOLD

        return row

    schema = T.StructType([*(docs.schema[c] for c in keep_columns), T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.BooleanType())])
    cols = list(dict.fromkeys([*keep_columns, text]))
    return map_rows(docs.select(*cols), schema, list(keep_columns), scorer, [text])

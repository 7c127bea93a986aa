"""Operator 4: a linear toxicity classifier over character n-grams scaled by naive Bayes log-count ratios.

Learnt from labelled texts only, and from all of them: every hashed n-gram is counted by class; its log-count
ratio r says how much more common it is in toxic texts, and its z-score whether that is more than chance. The n-grams
of the largest |z| stay, and a logistic model over presence x r learns their weights. What a text holds of these is
written once, and each step of the fit reads it all: executors sum the loss and its slope.

A score is a function of the text alone, so copies and repeated rows agree. Null texts count as empty; an empty text
gets the model's base rate. Without labels of both classes, or with empty tables, every score is the (smoothed) base
rate. Copies of one label are learnt from once; labels without an id, and documents without one, teach nothing; of
several labels of one id the toxic one holds. Texts are read whole, one at a time, so a very long one takes its own
length in memory. N-grams of equal |z| go by bucket. Columns beside key, text and label are ignored or, when
`keep_columns` asks for them, passed through; `names` must not be among these.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.llm.common import code_points, counted, drop_written, grams, map_rows, sized, sliced, written
from lumenfold.llm.logistic import descended, losses, summed

#: log2 of the hash buckets; n-gram lengths; n-grams kept; score from which a text is toxic.
BITS, LENGTHS, KEPT, THRESHOLD = 20, (3, 4, 5, 6), 4096, 0.7
#: Counts are gathered in so many blocks of buckets, by so many tasks or one for so many texts; a block's places fit 16 bits.
BLOCKS, TASKS, TEXTS = 32, 8, 50_000
#: Of the fit: the weights' decay.
DECAY = 3e-4


def buckets(text: str, bits: int = BITS) -> np.ndarray:
    """The hashed character n-grams of a text, in lower case and with a space around it; repeats stay. The second
    time that an n-gram of five or more stands in a text is an n-gram of its own: it says more than the first."""
    codes = code_points(f" {text} ".lower() if text else "")
    parts = []
    for n in LENGTHS:
        h = grams(codes, n)
        parts.append(h >> np.uint64(64 - bits))
        if n >= 5:
            h = np.sort(h)
            parts.append((h[1:][h[1:] == h[:-1]] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits))
    return np.concatenate(parts).astype(np.int64)


def held_out(key: str = "doc_id") -> F.Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> dict:
    """The model, from the rows of labels (key, label); the caller leaves held-out rows out."""
    told, seen = counted(labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max(label).alias("label")).where("id is not null"))
    told = written(told, "told")
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(sized(told), F.col("_id") == F.col("id"))
    rows = rows.select((F.col("label") > 0).cast("int").alias("label"), F.coalesce("_text", F.lit("")).alias("t"))
    # the labelled texts, written once: the corpus is read once to learn and once to score; copies teach nothing new
    rows, labelled = counted(rows.distinct().coalesce(max(TASKS, seen.get["n"] // TEXTS)))
    rows = written(rows, "labelled")
    drop_written(told)
    size = (1 << BITS) // BLOCKS

    def count(batches):
        """Of this task's texts, how many of each class hold each n-gram: only those that some hold, by block."""
        c, n, flags = np.zeros((2, 1 << BITS), np.uint32), [0, 0], np.zeros(1 << BITS, bool)
        for b in sliced(batches, 64):
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                flags[buckets(t)] = True
                on = np.flatnonzero(flags)
                flags[on] = False
                c[y][on] += 1
                n[y] += 1
        for y in (0, 1):
            if n[y]:
                on = np.flatnonzero(c[y])
                cuts = np.searchsorted(on, np.arange(BLOCKS + 1) * size)
                parts = [on[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(BLOCKS), pa.int32()), pa.array([y] * BLOCKS, pa.int32()), pa.array([n[y]] * BLOCKS, pa.int64()), pa.array([(p % size).astype(np.uint16).tobytes() for p in parts], pa.binary()), pa.array([c[y][p].tobytes() for p in parts], pa.binary())],
                    names=["block", "label", "n", "at", "counts"],
                )

    def ratio(key_, t):
        c, n = np.zeros((2, size)), np.zeros(2)
        for y, m, at, raw in zip(*(t.column(x).to_pylist() for x in ("label", "n", "at", "counts")), strict=True):
            c[y][np.frombuffer(at, np.uint16)] += np.frombuffer(raw, np.uint32)
            n[y] += m
        r, z = log_count_ratios(c, n)
        top = np.argsort(-np.abs(z), kind="stable")[:KEPT]
        top = top[np.abs(z[top]) > 3]
        return pa.table([pa.array(top + key_[0].as_py() * size, pa.int32()), pa.array(r[top]), pa.array(z[top])], names=["bucket", "r", "z"])

    by_block = rows.select("label", "t").mapInArrow(count, "block int, label int, n long, at binary, counts binary")
    # the most telling of all blocks, picked by the executors
    found = by_block.groupBy("block").applyInArrow(ratio, "bucket int, r double, z double").orderBy(F.desc(F.abs("z")), "bucket").limit(KEPT).collect()
    table = np.full(1 << BITS, -1, np.int16)
    for i, x in enumerate(found):
        table[x[0]] = i
    r = np.array([x[1] for x in found], np.float32)

    def present():
        return lambda t: (np.unique((j := table[buckets(t)])[j >= 0]).tobytes(),)

    shown = map_rows(rows, T.StructType([T.StructField("label", T.IntegerType()), T.StructField("on", T.BinaryType())]), ["label"], present, ["t"])
    # equal ones count once; in an order of their own, so that sums don't depend on how texts were dealt
    dealt = shown.repartition(max(1, -(-labelled.get["n"] // TEXTS)), "label", "on").distinct().sortWithinPartitions("label", "on")
    different = written(dealt, "presence")
    drop_written(rows)
    n = dict(different.groupBy("label").count().collect())
    no, yes = n.get(0, 0), n.get(1, 0)
    if not len(found) or not no or not yes:
        drop_written(different)
        base = float(np.log((yes + 0.5) / (no + 0.5))) if no + yes else 0.0
        return {"table": table, "w": np.zeros(max(len(r), 1)), "bias": base}
    model = {"table": table, **_fit(different, (no, yes), r)}
    drop_written(different)
    return model


def log_count_ratios(c: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts of each class (n) and those of them that hold each n-gram (c): log ratio of the shares, and its z-score
    (0 where fewer than three texts hold it)."""
    q, p = (c[1] + 0.5) / (n[1] + 1), (c[0] + 0.5) / (n[0] + 1)
    r = np.log(q / p)
    return r, np.where(c.sum(0) >= 3, r / np.sqrt(1 / (c[1] + 0.5) + 1 / (c[0] + 0.5)), 0)


def _fit(rows: DataFrame, n: tuple[int, int], r: np.ndarray) -> dict:
    """Logistic regression over presence x r, from (label, on) of n rows of each label; classes weigh alike by half."""
    toxic = np.sqrt(n[0] / n[1])
    weights = np.array([1, toxic]) / (n[0] + toxic * n[1])

    def part(b: pa.RecordBatch, w: np.ndarray) -> tuple[float, np.ndarray]:
        y, on = b.column("label").to_numpy(), [np.frombuffer(x, np.int16) for x in b.column("on").to_pylist()]
        lengths = np.array([len(x) for x in on])
        at = np.repeat(np.arange(len(on)), lengths)
        j = np.concatenate(on).astype(np.int64)
        value = r[j] / np.maximum(np.sqrt(lengths), 1)[at] * 4
        loss, e = losses(np.bincount(at, value * w[j], len(on)) + w[-1], y)
        e *= weights[y]
        return float(loss @ weights[y]), np.append(np.bincount(j, value * e[at], len(r)), e.sum())

    w = descended(lambda w: summed(rows, part, w), len(r) + 1, 0.5, DECAY)
    return {"w": w[:-1] * r * 4, "bias": float(w[-1])}


def score(docs: DataFrame, model: dict, text: str = "text", keep_columns: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The score (0 to 1) of every document and whether it reaches THRESHOLD (1 or 0); names: of these columns."""
    table, w, bias = model["table"], model["w"], model["bias"]

    def scorer():
        def row(t):
            j = table[buckets(t)]
            j = np.unique(j[j >= 0])
            s = bias + (float(w[j].sum()) / np.sqrt(len(j)) if len(j) else 0.0)
            s = 1 / (1 + float(np.exp(-np.clip(s, -50, 50))))
            return s, int(s >= THRESHOLD)

        return row

    schema = T.StructType([*(docs.schema[c] for c in keep_columns), T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])
    return map_rows(docs.select(*dict.fromkeys([*keep_columns, text])), schema, list(keep_columns), scorer, [text])

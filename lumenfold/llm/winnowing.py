"""Operator 2: document fingerprints by winnowing.

Every k-gram of characters is hashed; in every window of w neighbouring k-grams the least hash is chosen,
the rightmost of equal ones. So two texts that share w + k - 1 characters in a row share a fingerprint hash,
and nothing shorter than k is matched. Positions are kept.

A fingerprint is written as 10 hex digits for each chosen k-gram, in order: 8 of its hash, 2 of its distance
from the one before (the first: from the start), which is at most w < 256. parsed() reads it. A text shorter
than k has one gram, its whole; an empty text has none. Likeness is the Jaccard similarity of two
fingerprints' hashes; two empty ones are alike (1).

compare_neighbours() sets each document against an edited version of itself and against the next document.
Documents are dealt by ranges of ids and streamed in order, so no task holds more than two of them; each
range also gets the first document of the next. Null ids come first, repeated ids are ordered by text, null
texts count as empty, and a table of one document is its own next one. Rows of one id (or of none) are one run of the
order, so they share a range however many they are. Texts are fingerprinted whole, two at a time. An empty table gives
an empty result. Columns beside id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.llm.common import code_points, map_rows, mixed, sliced

#: Characters of a gram; grams of a window: runs of 64 characters are always found.
K, W = 20, 45
_BASE = 0x9E3779B97F4A7C15


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """32-bit hashes of all k-grams, joined from halves so that it takes log(k) steps."""
    n = len(codes) - k + 1
    part, width, power = codes.astype(np.uint64) + np.uint64(1), 1, _BASE
    whole, done = None, 0
    while True:
        if k & width:
            if whole is None:
                whole, done = part, width
            else:
                m = len(part) - done
                whole, done = part[:m] + whole[width : width + m] * np.uint64(power), done + width
        if done == k:
            return (mixed(whole[:n]) >> np.uint64(32)).astype(np.uint32)
        part = part[:-width] + part[width:] * np.uint64(power)
        width, power = 2 * width, power * power % (1 << 64)


def winnow(codes: np.ndarray, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the chosen grams, by position."""
    if not len(codes):
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    h = gram_hashes(codes, min(k, len(codes)))
    w = min(w, len(h))
    at = np.arange(len(h))
    size, low, best = 1, h, at
    while size < w:
        step = min(size, w - size)
        right = low[step:] <= low[:-step]
        low, best = np.where(right, low[step:], low[:-step]), np.where(right, best[step:], best[:-step])
        size += step
    chosen = best[np.concatenate([[True], best[1:] != best[:-1]])]
    return h[chosen], chosen


def written_out(hashes: np.ndarray, positions: np.ndarray) -> str:
    rows = np.zeros((len(hashes), 5), np.uint8)
    rows[:, :4] = hashes.astype(">u4").view(np.uint8).reshape(-1, 4)
    rows[:, 4] = np.diff(positions, prepend=0)
    return rows.tobytes().hex()


def parsed(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, 5)
    return rows[:, :4].copy().view(">u4").ravel().astype(np.uint32), np.cumsum(rows[:, 4].astype(np.int64))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Of sets of hashes."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, text: str = "text", keep_columns: tuple[str, ...] = ("doc_id",), k: int = K, w: int = W) -> DataFrame:
    """The fingerprint of every text."""
    schema = T.StructType([*(docs.schema[c] for c in keep_columns), T.StructField("fingerprint", T.StringType())])
    return map_rows(docs.select(*dict.fromkeys([*keep_columns, text])), schema, list(keep_columns), lambda: lambda t: (written_out(*winnow(code_points(t or ""), k, w)),), [text])


def _dealt(docs: DataFrame, rows_each: int, most: int) -> DataFrame:
    """docs (_id, _text) with _range and _guest: each range of ids also gets, as guests, the first rows of the next; the last gets those of the first."""
    low = -(1 << 63)
    ids = docs.select(F.coalesce(F.col("_id").cast("long"), F.lit(low)).alias("i"))
    ranges = int(min(max(docs.count() // rows_each, 1), most))
    # at most `most` numbers, from a sketch of all ids
    cuts = ids.agg(F.percentile_approx("i", [j / ranges for j in range(1, ranges)], 100_000)).first()[0] if ranges > 1 else []
    cuts = sorted(set(cuts or []))

    @F.pandas_udf("int")
    def range_of(i: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, i, side="right").astype(np.int32))

    firsts = sorted((r[0], r[1]) for r in ids.groupBy(range_of("i").alias("r")).agg(F.min("i")).collect())
    hosts = {first: firsts[j - 1][0] for j, (_, first) in enumerate(firsts)}  # the first's host is the last range

    @F.pandas_udf("int")
    def host_of(i: pd.Series) -> pd.Series:
        return i.map(hosts).astype("Int32")

    placed = docs.withColumn("_i", F.coalesce(F.col("_id").cast("long"), F.lit(low)))
    own, host = F.struct(range_of("_i").alias("_range"), F.lit(False).alias("_guest")), F.struct(host_of("_i").alias("_range"), F.lit(True).alias("_guest"))
    placed = placed.withColumn("_place", F.explode(F.array(own, host))).where("_place._range is not null")
    return placed.select("_id", "_i", "_text", "_place._range", "_place._guest")


def compare_neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, w: int = W, rows_each: int = 2048, most: int = 20_000) -> DataFrame:
    """Each document against its edited text (the last quarter replaced by as many first characters of the next document) and the next document."""
    rows = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *map(T.StructField, names, [T.LongType(), T.StringType(), T.StringType(), T.StringType(), T.DoubleType(), T.DoubleType()])])
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def described(t: str):
        hashes, at = winnow(code_points(t), k, w)
        return t, written_out(hashes, at), np.unique(hashes)

    def against(own, after):
        t, mine, mine_set = own
        cut = len(t) // 4
        edited = described(t[: len(t) - cut] + after[0][:cut])
        return len(t), hashlib.sha256(edited[0].encode()).hexdigest(), mine, edited[1], likeness(mine_set, edited[2]), likeness(mine_set, after[2])

    def run(batches):
        held = served = None  # the row that waits for its next one; a range whose guest has come
        for b in sliced(batches):
            ids, made = [], []
            for i, t, r, guest in zip(*(b.column(c).to_pylist() for c in ("_id", "_text", "_range", "_guest")), strict=True):
                if guest and served == r:
                    continue
                now = described(t)
                if held and held[1] == r:
                    ids.append(held[0])
                    made.append(against(held[2], now))
                held, served = (None, r) if guest else ((i, r, now), None)
            if made:
                cols = [pa.array(c, kind) for c, kind in zip(zip(*made, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field("_id").type), *cols], names=[key, *names])

    dealt = _dealt(rows, rows_each, most)
    return dealt.repartition("_range").sortWithinPartitions("_range", "_guest", "_i", "_text").mapInArrow(run, schema)

"""Operator 8: documents packed into token sequences, first-fit decreasing.

Each document is tokenized once, where it lies, and ends with an end id. It is cut into full sequences and one
remainder; only the pieces' sizes move, and they are written once, as they are counted before they are dealt. A
piece's draw is a hash of its document's id, its ids and its start, so that it is the same wherever the document lies
and however often a task runs. Draws are dealt into groups of about `group` pieces; what more than twice as many
equal draws would make too large (rows repeated very often) is dealt on by place in the written table. Each group is
packed by itself: longest piece first, each into the first open bin with room, which a tournament tree of free room
finds in log(bins) steps.

Null texts count as empty (a document of the end id alone). Texts of any length are tokenized whole, one at a time.
Repeated rows and repeated ids are packed row by row; null ids are ids like others. Pieces of equal length go by
draw, then id and start. An empty table gives no pieces. Columns beside key and text are ignored, whatever their
names.
"""

from __future__ import annotations

import base64
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.llm.common import counted, sized, sliced, written

#: Tokens of a sequence; the id that ends a document; pieces in a group, about; bits of a bin's number.
LENGTH, END, GROUP, BIN_BITS = 1024, 0, 8192, 24

#: Where both tokenizer libraries certainly agree on letters, digits and white space; other texts go the slow way.
_PLAIN = re.compile("[^\x00-\x1b\x20-ɏ]")
_MADE: dict[tuple[str, str], object] = {}


def tokenizer(json_path: str, ranks_path: str):
    """text -> uint32 ids, as the tokenizers library gives for json_path; ranks_path has the same vocabulary as ranks."""
    if (json_path, ranks_path) in _MADE:
        return _MADE[json_path, ranks_path]
    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(json_path)
    exact.no_truncation()
    exact.no_padding()
    special = {t.content: i for i, t in exact.get_added_tokens_decoder().items()}
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(text: str) -> np.ndarray:
        if _PLAIN.search(text):
            return np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return fast.encode_to_numpy(text, allowed_special="all").astype(np.uint32, copy=False)

    _MADE[json_path, ranks_path] = ids
    return ids


def first_fit_decreasing(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; pieces of equal size go by position."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    width = 1 << max(int(len(sizes) - 1).bit_length(), 0) if len(sizes) else 1
    tree = [room] * (2 * width)  # tree[1] is the most room of any bin; bin b is leaf width + b
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, at = int(sizes[i]), 1
        while at < width:
            at *= 2
            if tree[at] < size:
                at += 1
        bins[i], offsets[i] = at - width, room - tree[at]
        tree[at] -= size
        while at > 1:
            at //= 2
            best = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == best:
                break
            tree[at] = best
    return bins, offsets


_PIECES = [("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("doc_tokens", T.LongType())]


def pieces(docs: DataFrame, json_path: str, ranks_path: str, text: str = "text", key: str = "doc_id", length: int = LENGTH, end: int = END) -> DataFrame:
    """A row for each piece of at most `length` ids, with its draw."""
    schema = T.StructType([T.StructField("id", docs.schema[key].dataType), *(T.StructField(n, t) for n, t in _PIECES), T.StructField("draw", T.LongType())])
    rest = [n for n, _ in _PIECES]

    def run(batches):
        encode = tokenizer(json_path, ranks_path)
        for b in sliced(batches):
            rows, take = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                ids = np.append(encode(t) if t else np.empty(0, np.uint32), np.uint32(end)).astype("<u4")
                for s in range(0, len(ids), length):
                    rows.append((s, min(length, len(ids) - s), crc32(ids[s : s + length].tobytes()), len(ids)))
                    take.append(i)
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(rest)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int64())), *(pa.array(c, pa.int64()) for c in cols)], names=["id", *rest])

    cut = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, T.StructType(schema.fields[:-1]))
    return cut.withColumn("draw", F.xxhash64(F.lit(17), "id", "start", "ids_crc32", "doc_tokens"))


def pack(docs: DataFrame, json_path: str, ranks_path: str, text: str = "text", key: str = "doc_id", length: int = LENGTH, end: int = END, group: int = GROUP) -> DataFrame:
    """Pieces with sequence_id and offset. A sequence is as long as its pieces together, and is padded to
    `length` unless that is a power of two."""
    cut, seen = counted(pieces(docs, json_path, ranks_path, text, key, length, end))
    cut = written(cut, "pieces")
    groups = max(1, -(-seen.get["n"] // group))
    dealt = cut.withColumn("group", F.pmod("draw", F.lit(groups)))
    # few: at most a row for each `2 x group` pieces
    large = written(dealt.groupBy("group").count().where(F.col("count") > 2 * group).select("group", F.ceil(F.col("count") / group).alias("parts")), "large", groups)
    dealt = dealt.withColumn("place", F.monotonically_increasing_id()).join(sized(large), "group", "left")
    dealt = dealt.withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("place"), "parts")).otherwise(0)).drop("place", "parts")
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *(T.StructField(n, t) for n, t in _PIECES), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def fill(t: pa.Table) -> pa.Table:
        t = t.sort_by([("draw", "ascending"), ("id", "ascending"), ("start", "ascending")])
        bins, offsets = first_fit_decreasing(t.column("length").to_numpy(), length)
        if len(bins) >> BIN_BITS:
            raise OverflowError(f"a group has more than 2^{BIN_BITS} pieces")
        # a group's parts take every other number of groups, so that no two share a sequence
        numbered = (t.column("group").to_numpy() + groups * t.column("part").to_numpy() << BIN_BITS) + bins
        return t.select(["id", *(n for n, _ in _PIECES)]).append_column("sequence_id", pa.array(numbered, pa.int64())).append_column("offset", pa.array(offsets, pa.int64())).rename_columns(schema.names)

    return dealt.groupBy("group", "part").applyInArrow(fill, schema)

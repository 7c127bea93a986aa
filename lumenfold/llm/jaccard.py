"""Operator 6: a self-join of documents by the Jaccard similarity of their five-word shingles, by MinHash LSH forest.

1. Texts of equal words (in lower case, split at white space) are copies; one of each class goes on.
2. Signatures: for each of TREES tries, DEPTH MinHash values, kept as a byte each: a number whose leading bytes are
   a path from the trie's root.
3. The tries are sorted once, by trie and signature, over ranges that split any run of equal signatures. Neighbours
   in that order tell how deep each text meets another one; texts that meet none down to the floor go.
4. The matched prefix is shortened from DEPTH, level by level, until the neighbours of all tries together show that
   no shorter one, down to the floor, would bring any texts together that don't meet yet. The floor is the level at
   which any pair at the threshold meets in some trie with the chance RECALL. Nothing is sampled.
5. Texts that share a prefix of this length in a trie are a bucket. Within it, sketches weed out texts that only
   share a passage. Connected components over all tries are the candidate groups.
6. Each candidate group's shingle sets are brought together once, and every pair is verified exactly. The
   verified links give each text's number of links, and by connected components its class.

Buckets and groups of any size are cut into blocks and each pair of blocks is a task's work, so none is capped, no
pair is written out and no task holds more than two blocks: a block gives the edges of a spanning forest and, in
verification, the number of links of each text.

Null texts count as empty. Texts without words are copies of each other. Texts of under five words have
one shingle, all their words. Texts of any length are read whole, and one takes its share of memory alone. Repeated
rows and repeated ids are rows of their own; null ids sort first as everywhere in Spark and don't hinder. Ties
(equal ids, which would name a class alike) go to the lesser hash of id and text. An empty table gives an empty
result. Columns beside id and text are ignored by classes() and kept by survivors(), whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import code_points, counted, drop_written, mixed, sized, sliced, tidy, unused, written
from lumenfold.llm.components import components

#: Words of a shingle; similarity from which texts are linked (as a fraction).
WORDS, SIMILARITY = 5, (4, 5)
#: Tries, values of each (bytes of a long), and the share of pairs that must meet.
TREES, DEPTH, RECALL = 32, 8, 0.9999
#: Rows of one bucket that measured_level() looks at.
SAMPLE_BUCKET = 64
#: Texts, or shingles, of a block in verification; texts of a block where sketches are compared.
BLOCK, BLOCK_SHINGLES, SKETCHED = 2048, 2_000_000, 65_536

_SPACE = np.array([chr(c).isspace() for c in range(0x3001)])
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2^64, and of its inverse."""
    if len(_POWERS[0]) < n:
        for i, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, 1 << 16), b, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, in order."""
    codes = code_points(text.lower())
    if not len(codes):
        return np.empty(0, np.uint64)
    gap = _SPACE[np.minimum(codes, 0x3000)] & (codes <= 0x3000)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]])))
    start, end = edge[::2], edge[1::2]
    up, down = _powers(len(codes) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:-1])])
    return mixed((total[end] - total[start]) * down[start])


def shingles(words: np.ndarray, k: int = WORDS) -> np.ndarray:
    """The distinct shingles, in ascending order; one of all words if there are fewer than k."""
    if not len(words):
        return words
    k = min(k, len(words))
    h = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        h = mixed(h * np.uint64(0xD1342543DE82EF95) + words[i : len(words) - k + 1 + i])
    return np.unique(h)


def copy_key(words: np.ndarray) -> bytes:
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest()


def floor_level(similarity: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix that a pair at the threshold shares in some trie with this chance: no need to go below it."""
    for k in range(depth, 0, -1):
        if 1 - (1 - similarity**k) ** trees >= recall:
            return k
    raise ValueError("more tries are needed for this recall")


class MinHash:
    """Signatures of `count` values; each is the least of a keyed hash over a set."""

    def __init__(self, count: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.add = rng.integers(0, 1 << 32, count, np.uint32)
        self.times = rng.integers(0, 1 << 31, count, np.uint32) * np.uint32(2) + np.uint32(1)

    def signature(self, items: np.ndarray) -> np.ndarray:
        x = (items >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.add), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), 256):  # a block of this size stays in cache
            h = (x[i : i + 256, None] ^ self.add) * self.times
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            np.minimum(least, h.min(0), out=least)
        return least


def paths(hashing: MinHash, items: np.ndarray) -> np.ndarray:
    """Of a set, its path in each trie: DEPTH values of a byte, the first the most significant."""
    labels = mixed(hashing.signature(items).astype(np.uint64)).astype(np.uint8)
    return labels.view(">u8").astype(np.uint64).view(np.int64)


def _described(docs: DataFrame) -> DataFrame:
    """Of each row: its key, copy class, number of shingles, and paths in the tries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = MinHash(TREES * DEPTH)
        for b in sliced(batches):
            copies, ns, found = [], [], []
            for t in b.column("_text").to_pylist():
                words = word_hashes(t)
                items = shingles(words)
                copies.append(copy_key(words))
                ns.append(len(items))
                found.append(paths(hashing, items) if len(items) else [])
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_key"), pa.array(copies, pa.binary()), pa.array(ns, pa.int32()), pa.array(found, pa.list_(pa.int64()))], names=["_id", "_key", "copy", "n", "paths"])

    schema = f"_id {docs.schema['_id'].dataType.simpleString()}, _key long, copy binary, n int, paths array<long>"
    return docs.select("_id", "_key", "_text").mapInArrow(run, schema)


def levels(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading bytes two arrays of paths share."""
    x = (a ^ b).view(np.uint64)
    return sum(((x >> np.uint64(64 - 8 * k)) == 0).astype(np.int32) for k in range(1, DEPTH + 1))


def sorted_tries(texts: DataFrame, floor: int) -> DataFrame:
    """(tree, path, _key, met, before, edge) of the texts that meet another one at least `floor` levels deep in a trie;
    met: how deep; before: how deep they meet the one before in the order.

    The order is by ranges of (tree, path, _key), so equal paths may go over several tasks. What lies beyond a task's
    first and last row (edge) isn't known there: these rows stay, as if met at full depth; the first has no `before`.
    """

    schema = pa.schema([("tree", pa.int32()), ("path", pa.int64()), ("_key", pa.int64()), ("met", pa.int32()), ("before", pa.int32()), ("edge", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, True  # held: the last row, with how deep it met the one before
        for b in batches:
            if not b.num_rows:
                continue
            tree, path, key = (b.column(c).to_numpy() for c in ("tree", "path", "_key"))
            if held:
                tree, path, key = (np.concatenate([[h], x]) for h, x in zip(held[:3], (tree, path, key), strict=True))
            before = np.full(len(tree), DEPTH, np.int32)
            before[1:] = np.where(tree[1:] == tree[:-1], levels(path[1:], path[:-1]), 0)
            if held:
                before[0] = held[3]
            met = np.maximum(before[:-1], before[1:])
            held = (tree[-1], path[-1], key[-1], before[-1])
            on = np.flatnonzero(met >= floor)
            edge = (on == 0) & first
            first = first and not len(met)
            columns = [x[on] for x in (tree, path, key, met)]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(columns, schema.types, strict=False)), pa.array(before[on], pa.int32(), mask=edge), pa.array(edge)], schema=schema)
        if held:
            last = (*held[:3], DEPTH, None if first else held[3], True)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(last, schema.types, strict=True)], schema=schema)

    order = ["tree", "path", "_key"]
    entries = texts.select("_key", F.posexplode("paths").alias("tree", "path")).select(*order)
    return entries.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "tree int, path long, _key long, met int, before int, edge boolean")


def _prefix(level: int) -> F.Column:
    """The first `level` bytes of a path."""
    return F.shiftrightunsigned("path", 8 * (DEPTH - level))


def measured_level(rows: list[tuple[int, int, int]], paths_of: dict[int, np.ndarray], similarity: float, floor: int, recall: float) -> tuple[int, dict[int, float]]:
    """The longest prefix at which a sample shows this recall, and the lower bounds that were measured on the way: to
    look at tries by hand. No query takes its prefix from it; see matched_level().

    rows: (tree, prefix, key) of the sample. Its pairs are those of a bucket that are similar by their sketches; a
    pair counts as found at a level if it meets that deep in a trie other than the one that brought it here.
    """
    buckets: dict[tuple[int, int], list[int]] = {}
    for tree, prefix, key in rows:
        members = buckets.setdefault((tree, prefix), [])
        if len(members) < SAMPLE_BUCKET:
            members.append(key)
    found, n = np.zeros(DEPTH + 2, np.int64), 0
    for (tree, _), members in buckets.items():
        p = np.stack([paths_of[k] for k in members])
        for i in range(len(p) - 1):
            deep = levels(p[i + 1 :], p[i])
            same = (p[i + 1 :].view(np.uint8) == p[i].view(np.uint8)).mean(1)
            deep[:, tree] = 0
            near = deep[same >= similarity].max(1)
            n += len(near)
            found += (near[:, None] >= np.arange(DEPTH + 2)).sum(0)
    seen = {}
    for level in range(DEPTH, floor, -1):
        share = found[level] / n if n else 0.0
        # Wilson's lower bound of a share
        z = 1.645
        seen[level] = float((share + z * z / (2 * n) - z * np.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)) if n else 0.0
        if seen[level] >= recall:
            return level, seen
    return floor, seen


def matched_level(tries: DataFrame, floor: int) -> int:
    """Shorten the matched prefix until its buckets, over all tries, are those of the floor: no neighbours in the order
    share more than what the floor asks for, but less than this prefix. So no text is lost that the floor would find."""
    inside = [r["before"] for r in tries.where(F.col("before") >= floor).select("before").distinct().collect()]
    # between tasks: the last row of one and the first of the next; a task's own two share no more than what is inside
    edges = tries.where("edge").select("tree", "path", "_key").orderBy("tree", "path", "_key").toArrow()
    tree, path = edges.column("tree").to_numpy(), edges.column("path").to_numpy()
    across = np.where(tree[1:] == tree[:-1], levels(path[1:], path[:-1]), 0).tolist()
    return min((k for k in (*inside, *across) if k >= floor), default=DEPTH)


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Of rows sorted by keys, the rows of each key; a run may go over batches."""
    held: list[pa.RecordBatch] = []

    def same(a: pa.RecordBatch, i: int, b: pa.RecordBatch, j: int) -> bool:
        return all(a.column(k)[i] == b.column(k)[j] for k in keys)

    for b in batches:
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows - 1, bool)
        for k in keys:
            v = b.column(k).to_numpy(zero_copy_only=False)
            change |= v[1:] != v[:-1]
        starts = [0, *(np.flatnonzero(change) + 1).tolist(), b.num_rows]
        for s, e in zip(starts, starts[1:], strict=False):
            part = b.slice(s, e - s)
            if held and not (s == 0 and same(held[-1], 0, part, 0)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges (node, root) of a spanning forest of a symmetric Boolean matrix."""
    return _spanning(len(linked), lambda i, left: linked[i, left])


def _spanning(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """The same, where near(i, left) tells which of the nodes `left` are linked to i: a node is only compared to those
    that no one has reached, so that alike nodes take linear time."""
    left, out = np.arange(n), []
    while len(left):
        root, left = int(left[0]), left[1:]
        front = [root]
        while front and len(left):
            hit = near(front.pop(), left)
            new, left = left[hit].tolist(), left[~hit]
            out += [(j, root) for j in new]
            front += new
    return out


def _blocked(rows: DataFrame, key: str, blocks: F.Column, member: str) -> DataFrame:
    """Each row once for every pair of blocks that its own block is in: columns _i <= _j, and _b, its own."""
    own = F.pmod(F.xxhash64(F.lit(3), member), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), (blocks - 1).cast("int")), lambda o: F.struct(F.least(o, F.col("_b")).alias("_i"), F.greatest(o, F.col("_b")).alias("_j")))
    return rows.withColumn("_b", own).withColumn("_pair", F.explode(pairs)).select("*", "_pair._i", "_pair._j").drop("_pair")


def _grouped(rows: DataFrame, keys: list[str], f: Callable, schema: str) -> DataFrame:
    """f over the rows of each key, many keys a task and in one pass: for very many small groups."""
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(f, schema)


def _candidates(tries: DataFrame, texts: DataFrame, level: int, similarity: float) -> DataFrame:
    """Edges (u, v) between texts that may be similar, enough to connect whatever is."""
    met = tries.where(F.col("met") >= level).select("tree", _prefix(level).alias("prefix"), "_key")
    sizes = met.groupBy("tree", "prefix").agg(F.ceil(F.count("*") / SKETCHED).alias("blocks"))
    # few: at most a row for SKETCHED rows of tries
    large = sized(written(sizes.where("blocks > 1"), "large", SKETCHED))
    dealt = _blocked(met.join(large, ["tree", "prefix"], "left"), "tree", F.coalesce("blocks", F.lit(1)), "_key").drop("blocks", "_b")
    # the last four levels of each trie are the sketch
    sketches = texts.select("_key", F.transform("paths", lambda p: F.shiftright(F.shiftleft(p, 32), 32).cast("int")).alias("sketch"))
    keys = ["tree", "prefix", "_i", "_j"]

    def run(batches):
        us, vs = [], []
        for t in _runs(batches, keys):
            if t.num_rows < 2:
                continue
            t = t.combine_chunks()
            nodes, first = np.unique(t.column("_key").to_numpy(), return_index=True)
            s = t.column("sketch").chunk(0).flatten().to_numpy().view(np.uint8).reshape(t.num_rows, -1)[first]
            # a pair at the threshold falls below this bound once in about a million
            bound = (similarity - 4.8 * np.sqrt(similarity * (1 - similarity) / s.shape[1])) * s.shape[1]
            for a, b in _spanning(len(nodes), lambda i, left: (s[left] == s[i]).sum(1) >= bound):
                us.append(int(nodes[a]))
                vs.append(int(nodes[b]))
            if len(us) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])
                us, vs = [], []
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return _grouped(dealt.join(sketches, "_key").select(*keys, "_key", "sketch"), keys, run, "u long, v long")


def _sets(rows: DataFrame) -> DataFrame:
    """group, blocks, _key, size and the shingles of each text."""

    def run(batches):
        for b in sliced(batches):
            # a key that two rows share by chance is told by the copy class
            words = [word_hashes(t) for t in b.column("_text").to_pylist()]
            right = [i for i, (w, c) in enumerate(zip(words, b.column("copy").to_pylist(), strict=True)) if copy_key(w) == c]
            sets = pa.array([shingles(words[i]).tobytes() for i in right], pa.binary())
            b = b.take(pa.array(right, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("group"), b.column("blocks"), b.column("_key"), b.column("size"), sets], names=["group", "blocks", "_key", "size", "items"])

    return rows.select("group", "blocks", "_key", "size", "copy", "_text").mapInArrow(run, "group long, blocks long, _key long, size long, items binary")


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, width: int = 4096) -> np.ndarray:
    """The number of items that each set of `left` shares with each of `right`."""
    at = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    items = np.concatenate(sets)
    _, ids, counts = np.unique(items, return_inverse=True, return_counts=True)
    shared = counts[ids] > 1
    at, ids = at[shared], ids[shared]
    _, ids = np.unique(ids, return_inverse=True)
    order = np.argsort(ids, kind="stable")
    at, ids = at[order], ids[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, int(ids[-1]) + 1 if len(ids) else 0, width):
        s, e = np.searchsorted(ids, [lo, lo + width])
        m = np.zeros((len(sets), min(width, int(ids[-1]) + 1 - lo)), np.float32)
        m[at[s:e], ids[s:e] - lo] = 1
        out += m[left] @ m[right].T
    return out.astype(np.int64)


def _verified(rows: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Of each pair of blocks: rows (u, texts, docs), how many texts and documents u is linked to there; and rows (u, v), a spanning forest."""
    p, q = similarity

    def run(batches):
        for t in _runs(batches, ["group", "_i", "_j"]):
            nodes, first = np.unique(t.column("_key").to_numpy(), return_index=True)
            if len(nodes) < 2:
                continue
            t = t.take(pa.array(first, pa.int64()))
            own, size = t.column("_b").to_numpy(), t.column("size").to_numpy()
            i, j = t.column("_i")[0].as_py(), t.column("_j")[0].as_py()
            sets = [np.frombuffer(x, np.uint64) for x in t.column("items").to_pylist()]
            left, right = (np.flatnonzero(own == k) for k in (i, j))
            n = np.array([len(x) for x in sets])
            both = overlaps(sets, left, right)
            either = n[left][:, None] + n[right][None, :] - both
            linked = both * q >= either * p
            if i == j:
                np.fill_diagonal(linked, False)
                us, texts, docs = nodes[left], linked.sum(1), linked @ size[right]
                whole = linked
                order = left
            else:
                us = np.concatenate([nodes[left], nodes[right]])
                texts = np.concatenate([linked.sum(1), linked.sum(0)])
                docs = np.concatenate([linked @ size[right], size[left] @ linked])
                a, b = linked.shape
                whole = np.zeros((a + b, a + b), bool)
                whole[:a, a:], whole[a:, :a] = linked, linked.T
                order = np.concatenate([left, right])
            some = texts > 0
            edges = _forest(whole)
            u = np.concatenate([us[some], nodes[order[[e[0] for e in edges]]] if edges else np.empty(0, np.int64)]).astype(np.int64)
            k = int(some.sum())
            v = pa.array([None] * k + [int(nodes[order[e[1]]]) for e in edges], pa.int64())
            counts = [pa.array([*x[some].tolist(), *([0] * len(edges))], pa.int64()) for x in (texts, docs)]
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), v, *counts], names=["u", "v", "texts", "docs"])

    return _grouped(rows, ["group", "_i", "_j"], run, "u long, v long, texts long, docs long")


@tidy
def _classed(docs: DataFrame, similarity: tuple[int, int], recall: float) -> DataFrame:
    """docs (_id, _text, _key) -> of each row _id, _key, class_id, class_key (those of its class's first row) and the counts."""
    ratio = similarity[0] / similarity[1]
    described, seen = counted(_described(docs))
    rows = written(described, "signatures")
    n = seen.get["n"]
    copies = rows.groupBy("copy").agg(F.min(F.struct("_id", "_key")).alias("first"), F.count("*").alias("size"), F.min("n").alias("n"))
    copies = written(copies.select("copy", F.col("first._id").alias("_id"), F.col("first._key").alias("_key"), "size", "n"), "copies", n)
    texts = rows.where("n > 0").join(copies.select("_key", "copy").hint("merge"), ["_key", "copy"], "left_semi").select("_key", "paths")
    floor = floor_level(ratio, recall=recall)
    tries, seen = counted(sorted_tries(texts, floor))
    tries = written(tries, "tries", n * TREES)
    met = seen.get["n"]
    near = components(_candidates(tries, texts, matched_level(tries, floor), ratio), met)

    group = near.join(copies, near["node"] == copies["_key"]).select("component", "_key", "copy", "size", "n")
    sizes = group.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    # only those of more than one block are looked up, so that a large group isn't brought together for it
    large = sized(written(sizes.where("blocks > 1"), "sizes", n))
    members, seen = counted(group.join(large, "component", "left").select(F.col("component").alias("group"), F.coalesce("blocks", F.lit(1).cast("long")).alias("blocks"), "_key", "copy", "size"))
    members = written(members, "members", n)
    brought = docs.select("_key", "_text").join(sized(members), "_key")
    dealt = _blocked(_sets(brought), "group", F.col("blocks"), "_key")
    links = written(_verified(dealt, similarity).coalesce(max(8, seen.get["n"] // 1024)), "links")

    degree = links.where("v is null").groupBy("u").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    joined = components(links.where("v is not null").select("u", "v"))
    linked = joined.join(copies, joined["node"] == copies["_key"])
    named = linked.groupBy("component").agg(F.min(F.struct("_id", "_key")).alias("class"), F.sum("size").alias("class_size"))
    linked = linked.join(sized(written(named, "named", n)), "component").join(degree, F.col("node") == F.col("u"))
    linked = linked.select("copy", "size", F.col("class._id").alias("class_id"), F.col("class._key").alias("class_key"), "class_size", "docs", "texts")
    # a row a class of copies, so that a hot one is the skewed side of a plain join
    alone = copies.join(linked.select("copy"), "copy", "left_anti").select("copy", "size", F.col("_id").alias("class_id"), F.col("_key").alias("class_key"), F.col("size").alias("class_size"), F.lit(0).alias("docs"), F.lit(0).alias("texts"))
    whole = written(linked.union(alone).select("copy", "class_id", "class_key", "class_size", (F.col("size") - 1 + F.col("docs")).alias("n_links"), F.col("texts").cast("long").alias("n_text_links")), "classes", n)
    return written(rows.select("_id", "_key", "copy").join(whole.hint("merge"), "copy").drop("copy"), "rows", n)


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: tuple[int, int] = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row a document: key, class_id (the least id of its class), class_size (documents), n_links (documents
    that it is linked to, copies among them) and n_text_links (different texts that it is linked to)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("_id"), whole.alias("_text"), F.xxhash64(F.col(key), whole).alias("_key"))
    return _classed(rows, similarity, recall).select(F.col("_id").alias(key), "class_id", "class_size", "n_links", "n_text_links")


def survivors(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: tuple[int, int] = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """docs without all but one document of each class: the one of the least id. Of equal rows one stays.

    What goes is less than what stays, so it is what is joined: the texts stay where they are while few go.
    """
    k, i = unused(docs, "_key", "_id")
    whole = docs.withColumn(k, F.xxhash64(F.col(key), F.coalesce(F.col(text), F.lit(""))))
    rows = whole.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.col(k).alias("_key"))
    classed = _classed(rows, similarity, recall)
    ids = classed.select(F.col("_id").alias(i), F.col("_key").alias(k), (F.col("_key") == F.col("class_key")).alias("first"))
    same = lambda few: (whole[k] == few[k]) & whole[key].eqNullSafe(few[i])
    n = classed.count()
    gone = sized(written(ids.where("not first").select(i, k).distinct(), "gone", n))
    kept = whole.join(gone, same(gone), "left_anti")
    repeated = written(ids.where("first").groupBy(i, k).count().where("count > 1").select(i, k), "repeated", n)
    drop_written(classed)
    if not repeated.isEmpty():
        again = sized(repeated)
        kept = kept.join(again, same(again), "left_anti").unionByName(kept.join(again, same(again), "left_semi").dropDuplicates([k]))
    return kept.drop(k)

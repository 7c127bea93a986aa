"""Operator 1: approximate nearest neighbours by an adaptive dimension scan (largest inner product first).

Inner products become distances by one more coordinate, which gives all vectors the same length. Vectors are
turned by a random rotation, so that every block of columns is a random sample of the squared distance, and
dealt to the lists of the nearest centroids. A query probes its nearest lists; in a list, distances grow
column block by column block, and after each block the hypothesis "not farther than the threshold" is tested:
candidates whose partial distance, scaled up, is too large are abandoned. What survives all blocks is scored
exactly, in double precision, on the original vectors. The threshold is the distance of the k-th nearest found
so far: it falls while a list is scanned, and what the nearest lists (home) give is where the others start.

Centroids and the number of probes come from a bounded sample (16 sqrt(N) vectors, at least SAMPLE and at most
MOST, the first by a hash of id): the probes are the fewest that find `recall` of the sample's own neighbours.
There are sqrt(N) lists, up to an eighth of the sample. Every vector is indexed, and every answer comes from the
scan of lists. Lists are cut into chunks of candidates and of queries, each pair a task's work of its own.

Vectors that are null, zero, of another length than most (of equally many: the shorter), or hold null or non-finite
components take no part; neither do null ids. Of several vectors of one id the least (compared component by
component) counts. Repeated rows count once; equal vectors of different ids each count, ties going to the smaller id.
Fewer candidates than k: all that the probes find are returned. An empty table gives an empty result. Columns beside
id and vector are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import bounded_sample, tidy, written

#: Vectors that centroids are fitted on, at least and at most; share of the sample's neighbours that probing must find.
SAMPLE, MOST, RECALL = 8192, 65_536, 0.98
#: Columns of a block; how many deviations a partial distance may be above the threshold; rows of a chunk.
COLUMNS, EPSILON, CANDIDATES, QUERIES = 16, 2.1, 8192, 8192
#: Queries and candidates that are scanned at a time; share of candidates alive from which a block is computed for all.
ASKED, TILE, DENSE = 256, 512, 0.1


def usable(vectors: DataFrame, is_query: F.Column, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """(id, v, asks) of the vectors that take part, one an id, and their dimension."""
    fine = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("asks")).where("id is not null and v is not null")
    fine = fine.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    sizes = fine.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = sizes[0] if sizes else 0
    return fine.where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v"), F.max("asks").alias("asks")), dim


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def nearest_lists(a: np.ndarray, centroids: np.ndarray, probes: int = 1, rows: int = 1024) -> np.ndarray:
    """Of each row, its nearest centroids, nearest first."""
    out = np.empty((len(a), probes), np.int32)
    for i in range(0, len(a), rows):
        d = _squared(a[i : i + rows], centroids)
        out[i : i + rows] = d.argmin(1)[:, None] if probes == 1 else d.argsort(1, kind="stable")[:, :probes]
    return out


class Index:
    """What every task needs: the rotation and the centroids."""

    def __init__(self, sample: np.ndarray, longest: float, count: int, k: int, recall: float):
        self.k, self.longest, self.dim = k, longest, sample.shape[1]
        self.turn = rotation(self.dim + 1)
        placed = self.place(sample)
        rng = np.random.default_rng(3)
        lists = int(np.clip(np.sqrt(count), 1, max(len(sample) // 8, 1)))
        c = placed[np.sort(rng.choice(len(sample), lists, replace=False))].copy()
        for _ in range(8):
            near = nearest_lists(placed, c)[:, 0]
            n = np.bincount(near, minlength=lists)
            total = np.zeros_like(c)
            np.add.at(total, near, placed)
            c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c).astype(np.float32)
        self.centroids = c
        self.probes = self._probes(sample, placed, recall)
        #: Lists that are scanned first: they hold about four times k vectors.
        self.home = int(np.clip(-(-4 * k * lists // max(count, 1)), 1, self.probes))

    def _probes(self, sample: np.ndarray, placed: np.ndarray, recall: float, asked: int = 1000) -> int:
        """The fewest probes that find this share of neighbours within the sample, for a thousand of its vectors."""
        k = min(self.k, len(sample) - 1)
        if k < 1:
            return len(self.centroids)
        own, q, ranks = nearest_lists(placed, self.centroids)[:, 0], self.queried(sample[:asked]), []
        for i in range(0, len(q), 100):
            d = -(sample[i : min(i + 100, asked)] @ sample.T)
            d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
            found = np.argpartition(d, k - 1, 1)[:, :k]
            order = _squared(q[i : i + 100], self.centroids).argsort(1).argsort(1)
            ranks.append(np.take_along_axis(order, own[found], 1).ravel())
        return int(np.quantile(np.concatenate(ranks), recall, method="higher")) + 1

    def place(self, v: np.ndarray) -> np.ndarray:
        """Candidates, all made as long as the longest, and rotated."""
        last = np.sqrt(np.maximum(self.longest**2 - (v.astype(np.float64) ** 2).sum(1), 0))
        return (np.hstack([v, last[:, None]]) @ self.turn).astype(np.float32)

    def queried(self, v: np.ndarray) -> np.ndarray:
        """Queries at unit length (which changes no order), rotated."""
        unit = v / np.linalg.norm(v.astype(np.float64), axis=1)[:, None] * self.longest
        return (np.hstack([unit, np.zeros((len(v), 1))]) @ self.turn).astype(np.float32)

    def distance(self, score: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The squared distance that stands for a score of a query of this length."""
        return 2 * self.longest**2 - 2 * self.longest * score / length


def survivors(placed: np.ndarray, q: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) that no test rejects: by column blocks, each followed by the test against limit (of each query).

    While many are alive, a block's distances are one product of matrices; then only those alive are looked at.
    """
    dim = placed.shape[1]
    total = np.zeros((len(q), len(placed)), np.float32)
    alive = np.ones(total.shape, bool)
    pairs = None
    for lo in range(0, dim, COLUMNS):
        a, b = q[:, lo : lo + COLUMNS], placed[:, lo : lo + COLUMNS]
        seen = min(lo + COLUMNS, dim)
        bound = limit * (1 + EPSILON / np.sqrt(seen)) ** 2 * seen / dim if seen < dim else limit * (1 + 1e-5) + 1e-6 * (q[0] @ q[0])
        if pairs is None:
            total += _squared(a, b)
            alive &= total <= bound[:, None]
            if alive.mean() < DENSE:
                pairs = np.nonzero(alive)
                part = total[pairs]
        else:
            i, j = pairs
            d = a[i] - b[j]
            part = part + np.einsum("ij,ij->i", d, d)
            on = part <= bound[i]
            pairs, part = (i[on], j[on]), part[on]
            if not len(part):
                break
    return pairs if pairs is not None else np.nonzero(alive)


def leading(q: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows (query, score, id): the places of the k best of each query, ordered, and their rank from 0; ties to smaller ids."""
    order = np.lexsort((ids, -score, q))
    rank = np.arange(len(order)) - np.searchsorted(q[order], q[order])
    on = rank < k
    return order[on], rank[on]


def scan(index: Index, x: np.ndarray, ids: np.ndarray, v: np.ndarray, own: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (query, id, score): the k best of candidates (x, ids) for each query (v, own id) that the tests don't reject.
    The thresholds start at limit and fall as candidates are found."""
    placed, asked, length = index.place(x), index.queried(v), np.linalg.norm(v, axis=1)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for s in range(0, len(v), ASKED):
        part = slice(s, s + ASKED)
        q, far = asked[part], limit[part].astype(np.float64).copy()
        who, which, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for lo in range(0, len(x), TILE):
            i, j = survivors(placed[lo : lo + TILE], q, far)
            i, j = i[(other := ids[lo + j] != own[s + i])], j[other]
            if not len(i):
                continue
            # row by row, so that equal vectors get equal scores
            made = np.concatenate([(v[s + i[c : c + 65_536]] * x[lo + j[c : c + 65_536]]).sum(1) for c in range(0, len(i), 65_536)])
            who, which, score = np.concatenate([who, i]), np.concatenate([which, ids[lo + j]]), np.concatenate([score, made])
            top, rank = leading(who, score, which, index.k)
            who, which, score = who[top], which[top], score[top]
            last = rank == index.k - 1
            far[who[last]] = np.minimum(far[who[last]], index.distance(score[last], length[s + who[last]]))
        out.append((who + s, which, score))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def _matrix(col: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float64).reshape(-1, dim)


def build(vectors: DataFrame, k: int, recall: float = RECALL, sample: int = SAMPLE, most: int = MOST) -> Index | None:
    count, longest = vectors.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    if not count:
        return None
    rows = bounded_sample(vectors.select("id", "v"), "id", int(np.clip(16 * np.sqrt(count), sample, max(most, sample)))).toArrow()
    v = rows.column("v").combine_chunks()
    v = v.flatten().to_numpy().reshape(rows.num_rows, -1)
    # copies would bend the centroids; one of each stays
    v = v[np.sort(np.unique(v, axis=0, return_index=True)[1])]
    return Index(v, float(np.sqrt(longest)) * (1 + 1e-12), count, k, recall)


@tidy
def search(vectors: DataFrame, is_query: F.Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row of vectors where is_query (over its columns), among all other rows."""
    spark = vectors.sparkSession
    fine, dim = usable(vectors, is_query, key, vector)
    fine = written(fine, "vectors")
    index = build(fine, k, recall, sample)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for b in batches:
            if b.num_rows:
                v = b.column("v").flatten().to_numpy().reshape(-1, dim)
                lists = nearest_lists(ix.place(v), ix.centroids)[:, 0]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("asks"), pa.array(lists, pa.int32()), pa.array([x.tobytes() for x in v], pa.binary())], names=["id", "asks", "list", "v"])

    placed = written(fine.mapInArrow(place, "id long, asks boolean, list int, v binary"), "placed")

    def probe(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A query once for each list: the home lists, or the others that it probes."""
            ix = shared.value
            for b in batches:
                if b.num_rows:
                    near = nearest_lists(ix.queried(_matrix(b.column("v"), dim)), ix.centroids, ix.probes)
                    near = near[:, : ix.home] if first else near[:, ix.home :]
                    at = pa.array(np.repeat(np.arange(len(near)), near.shape[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(near.ravel(), pa.int32()), *(b.column(c).take(at) for c in ("id", "limit", "v"))], names=["list", "id", "limit", "v"])

        return run

    def look(t: pa.Table) -> pa.Table:
        ask = np.array(t.column("limit").is_valid())
        stored, wanted = t.filter(pa.array(~ask)), t.filter(pa.array(ask))
        q = i = np.empty(0, np.int64)
        s = np.empty(0)
        if stored.num_rows and wanted.num_rows:
            own = wanted.column("id").to_numpy()
            q, i, s = scan(shared.value, _matrix(stored.column("v"), dim), stored.column("id").to_numpy(), _matrix(wanted.column("v"), dim), own, wanted.column("limit").to_numpy())
            q = own[q]
        return pa.table([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

    def scanned(asked: DataFrame, first: bool) -> DataFrame:
        probed = written(asked.mapInArrow(probe(first), "list int, id long, limit double, v binary"), "probes")
        # a row a list
        sizes = placed.groupBy("list").agg(F.ceil(F.count("*") / CANDIDATES).alias("c")).join(probed.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).alias("q")), "list")
        sizes = F.broadcast(sizes)

        def cut(rows, own, other, name, far):
            part = F.pmod(F.xxhash64(F.lit(9), "id"), F.col(own)).cast("int")
            return rows.join(sizes, "list").withColumn(name, part).withColumn(far, F.explode(F.sequence(F.lit(0), (F.col(other) - 1).cast("int")))).select("list", "_c", "_q", "limit", "id", "v")

        stored = cut(placed.select("list", F.lit(None).cast("double").alias("limit"), "id", "v"), "c", "q", "_c", "_q")
        return stored.unionByName(cut(probed, "q", "c", "_q", "_c")).groupBy("list", "_c", "_q").applyInArrow(look, "query_id long, vec_id long, score double")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    asked = placed.where("asks").select("id", "v")
    home = written(scanned(asked.withColumn("limit", F.lit(float("inf"))), True), "home")
    found = home
    if index.probes > index.home:
        # what the k-th nearest at home is as a distance; the length of the query is a factor of its scores
        last = home.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), "score")

        def started(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ix = shared.value
            for b in batches:
                if b.num_rows:
                    score = b.column("score").to_numpy(zero_copy_only=False)
                    limit = ix.distance(score, np.linalg.norm(_matrix(b.column("v"), dim), axis=1))
                    yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.where(np.isnan(score), np.inf, limit)), b.column("v")], names=["id", "limit", "v"])

        found = home.union(scanned(asked.join(last, "id", "left").mapInArrow(started, "id long, limit double, v binary"), False))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    out = written(ranked, "neighbours")
    shared.destroy()
    return out

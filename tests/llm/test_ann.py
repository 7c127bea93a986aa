import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import ann


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1.0) for i, v in rows], "vec_id long, embedding array<float>, label int, score double")


def brute(x, ids, q, k):
    s = (x.astype(np.float32).astype(float) * x[q].astype(np.float32).astype(float)).sum(1)
    s[q] = -np.inf
    top = np.lexsort((ids, -s))[:k]
    return ids[top].tolist(), s[top]


@pytest.mark.parametrize("kind", ["random", "clusters", "lengths", "copies"])
def test_recall_against_brute_force(spark, kind):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 32))
    if kind == "clusters":
        x = x * 0.3 + rng.normal(size=(10, 32))[rng.integers(0, 10, 3000)]
    if kind == "lengths":
        x *= rng.uniform(0.1, 3, 3000)[:, None]
    if kind == "copies":
        x[rng.choice(3000, 1000, replace=False)] = x[0]
    ids = rng.permutation(3000)
    found = ann.search(table(spark, zip(ids.tolist(), x.tolist(), strict=True)), F.col("vec_id") % 20 == 0, 20, sample=500).collect()
    by = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hit = n = 0
    for q in np.flatnonzero(ids % 20 == 0):
        mine = by[ids[q]]
        assert len(mine) == 20 and ids[q] not in [v for v, _ in mine]
        assert mine == sorted(mine, key=lambda v: (-v[1], v[0]))
        want, scores = brute(x, ids, q, 20)
        hit += len(set(want) & {v for v, _ in mine})
        n += 20
        if mine[0][0] == want[0]:
            assert mine[0][1] == pytest.approx(scores[0], rel=1e-12)
    assert hit / n >= 0.9


def test_unusable_vectors_and_few_candidates(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0]), (7, [1.0]), (40, None), (1, [0.5, 0.5]), (None, [1.0, 1.0])]
    found = ann.search(table(spark, rows), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found] == [(0, 1, 1, 0.5), (0, 2, 20, 0.0), (20, 1, 1, 0.5), (20, 2, 0, 0.0)]
    assert ann.search(table(spark, rows).limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_partial_distances_reject_only_what_is_far():
    rng = np.random.default_rng(2)
    ix = ann.Index(rng.normal(size=(200, 64)), 20.0, 200, 20, 0.98)
    raw, asked = rng.normal(size=(5000, 64)), rng.normal(size=(3, 64))
    x, q = ix.place(raw), ix.queried(asked)
    d = ((x[None] - q[:, None]) ** 2).sum(2)
    limit = np.sort(d, 1)[:, 19]
    i, j = ann.survivors(x, q, limit.astype(float))
    for n in range(3):
        near = set(np.argsort(d[n])[:20].tolist())
        assert len(near & set(j[i == n].tolist())) >= 18 and (i == n).sum() <= 25
    everything = ann.survivors(x, q, np.full(3, np.inf))
    assert len(everything[0]) == 15_000


def test_thresholds_fall_while_scanning(monkeypatch):
    rng = np.random.default_rng(3)
    ix = ann.Index(rng.normal(size=(200, 64)), 20.0, 200, 20, 0.98)
    x, v = rng.normal(size=(5000, 64)), rng.normal(size=(300, 64))
    seen, plain = [], ann.survivors

    def watched(placed, q, limit):
        seen.append(limit.copy())
        return plain(placed, q, limit)

    monkeypatch.setattr(ann, "survivors", watched)
    q, ids, s = ann.scan(ix, x, np.arange(5000), v, np.full(300, -1), np.full(300, np.inf))
    first = [f for f in seen if len(f) == ann.ASKED]
    assert np.isinf(first[0]).all() and all((b <= a).all() for a, b in zip(first, first[1:], strict=False)) and (first[-1] < first[1]).mean() > 0.9
    hit = sum(len(set(ids[q == i]) & set(np.argsort(-(x @ v[i]))[:20])) for i in range(300))
    assert hit / 6000 > 0.95 and np.bincount(q).max() == 20
    assert np.allclose(s, (x[ids] * v[q]).sum(1), rtol=1e-12)


def test_answers_come_from_the_scan_alone(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(300, 8)))]
    df = table(spark, rows)
    assert ann.search(df, F.col("vec_id") % 20 == 0).count() == 300
    monkeypatch.setattr(ann.Index, "_probes", lambda self, *a: 0)
    assert ann.search(df, F.col("vec_id") % 20 == 0).count() == 0  # no list is scanned


def test_names_that_clash_and_ids_with_several_vectors(spark):
    rows = [(i, [float(i % 7 + 1), 1.0 + i], 1, 2, True, 3, 0.5) for i in range(40)] + [(3, [-9.0, 0.5], 1, 2, True, 3, 0.5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int, v int, asks boolean, list int, score double")
    got = ann.search(df, F.col("vec_id") % 20 == 0, 50).orderBy("query_id", "rank").collect()
    assert len(got) == 2 * 39 and got[0]["query_id"] == 0
    x = {i: v for i, v, *_ in rows}  # the last of id 3 is its least
    for r in got:
        assert r["score"] == sum(a * b for a, b in zip(x[r["query_id"]], x[r["vec_id"]], strict=True))

"""Models that are fitted on all rows: what lies beyond any bounded share of them is learnt, too."""

import random

import numpy as np

from pyspark.sql import functions as F

from lumenfold.llm import logistic, quality, toxicity


def last_by_hash(spark, n, most):
    """Of the ids 0 to n - 1, those that a sample of `most` by a hash of the id leaves out."""
    ids = [r[0] for r in spark.range(n).orderBy(F.xxhash64(F.lit(7), "id"), "id").collect()]
    return set(ids[most:])


def test_quality_is_learnt_from_all_documents(spark, make_prose):
    rng = random.Random(41)
    junk = last_by_hash(spark, 4200, 4000)
    rows = [(i, " ".join(w.upper() + "!!" for w in make_prose(rng, 30).split()) if i in junk else make_prose(rng, 30)) for i in range(4200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in quality.score(docs, quality.train(docs)).where("keep").collect()}
    assert len(kept & junk) < 0.05 * len(junk) and len(kept) > 0.99 * (4200 - len(junk))


def test_toxicity_is_learnt_from_all_labels(spark, make_prose):
    rng = random.Random(42)
    bad = last_by_hash(spark, 12_200, 12_000)
    docs = spark.createDataFrame([(i, make_prose(rng, 4) + (" Despicable vermin." if i in bad else "")) for i in range(12_200)], "doc_id long, text string")
    labels = docs.select("doc_id", F.col("text").contains("vermin").cast("int").alias("toxic"))
    found = {r["doc_id"] for r in toxicity.score(docs, toxicity.train(docs, labels)).where("predicted = 1").collect()}
    assert found == bad


def test_loss_of_packed_rows_is_that_of_features(make_prose):
    rng, draw = random.Random(43), np.random.default_rng(43)
    texts = ["", "a", "a" * 300, "b" * 70_000] + [make_prose(rng, 50) for _ in range(6)]
    both = [(c, quality.statistics(t, c)) for t in texts for c in [quality.code_points(t)]]
    rows = [quality.packed(*x) for x in both]
    assert len({len(r) for r in rows}) == 3  # counts of one, two and four bytes
    x = np.ones((len(texts), quality.BUCKETS + 1))
    x[:, :-1] = np.stack([quality.features(*a) for a in both]) * quality.SCALE
    y, w = draw.random(len(texts)), draw.normal(size=quality.BUCKETS + 1)
    loss, e = logistic.losses(x @ w, y)
    mine, slope = quality.loss_of(rows, y, w)
    assert abs(mine - loss.sum()) < 1e-3 and np.allclose(slope, x.T @ e, atol=1e-3)


def test_descent_reaches_the_least_loss():
    draw = np.random.default_rng(44)
    x = np.hstack([draw.normal(size=(200, 12)) * np.geomspace(0.1, 3, 12), np.ones((200, 1))])
    y = 1 / (1 + np.exp(-(x @ draw.normal(size=13)))) * 0.9 + 0.05

    def loss(w):
        a, e = logistic.losses(x @ w, y)
        return float(a.mean()), x.T @ e / len(x)

    whole = lambda w: loss(w)[0] + 1e-4 / 2 * float(w[:-1] @ w[:-1])
    w = np.zeros(13)
    for _ in range(20_000):
        g = loss(w)[1]
        g[:-1] += 1e-4 * w[:-1]
        w -= 0.3 * g
    assert whole(logistic.descended(loss, 13, 0.1, 1e-4)) <= whole(w) + 1e-3
    assert logistic.descended(lambda w: (0.0, np.zeros(3)), 3, 1.0, 0.0).tolist() == [0, 0, 0]

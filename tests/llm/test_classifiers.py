import random

import numpy as np

from lumenfold.llm import quality, toxicity, weak_labels

BAD = ["vermin", "imbecile", "filthy", "despicable"]


def test_posteriors_recover_accuracies():
    rng = np.random.default_rng(5)
    truth = rng.random(20_000) < 0.2
    accuracy = [0.95, 0.85, 0.7]
    votes = []
    for a in accuracy:
        right = rng.random(len(truth)) < a
        votes.append(np.where(rng.random(len(truth)) < 0.2, 0, np.where(truth == right, 1, 2)))
    patterns = {}
    for v in zip(*votes, strict=True):
        k = "".join(map(str, v))
        patterns[k] = patterns.get(k, 0) + 1
    first, rate, share = weak_labels.posteriors(patterns, 3)
    assert abs(share - 0.2) < 0.05
    for i, a in enumerate(accuracy):
        assert abs(rate[0, i, 1] / (rate[0, i, 1] + rate[0, i, 2]) - a) < 0.07
    assert first["111"] > 0.9 and first["222"] < 0.05 and abs(first["000"] - share) < 0.1


def test_quality_separates_junk_from_prose(spark, make_prose):
    rng = random.Random(6)
    rows = []
    for i in range(600):
        t = make_prose(rng, rng.choice([30, 100, 400]))
        kind = i % 10
        if kind == 0:
            t = " ".join(w.upper() + "!!" for w in t.split())
        elif kind == 1:
            t = " ".join(w + rng.choice(["***", "%%%", "&&&"]) for w in t.split())
        elif kind == 2:
            t = "\n".join([make_prose(rng, 6)] * 30)
        rows.append((i, t, kind > 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string, clean boolean")
    model = quality.train(docs.select("doc_id", "text"))
    got = quality.score(docs, model, keep_columns=("doc_id", "clean")).collect()
    clean, junk = [r for r in got if r["clean"]], [r for r in got if not r["clean"]]
    assert np.mean([r["keep"] for r in clean]) > 0.99 and np.mean([r["keep"] for r in junk]) < 0.05


def test_toxicity_on_held_out_texts(spark, make_prose):
    rng = random.Random(7)
    rows = []
    for i in range(900):
        words = make_prose(rng, rng.choice([20, 80, 300])).split()
        bad = i % 7 == 0
        for _ in range(2 * bad):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs.select("doc_id", "text"), docs.where(~toxicity.held_out()).select("doc_id", "toxic"))
    got = [r for r in toxicity.score(docs.where(toxicity.held_out()), model, keep_columns=("doc_id", "toxic")).collect()]
    assert np.mean([r["predicted"] == r["toxic"] for r in got]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_toxicity_uses_only_the_labels_it_is_given(spark, make_prose):
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, make_prose(rng, 40) + (" vermin" if i % 3 == 0 else "")) for i in range(90)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    few = labels.where(~toxicity.held_out())
    a = toxicity.train(docs, few)
    b = toxicity.train(docs.where(~toxicity.held_out()), few)
    assert np.allclose(a["w"], b["w"]) and a["bias"] == b["bias"]


def logistic_loss(w, x, y, weight, decay):
    s = x @ w
    return float((weight * (np.logaddexp(0, s) - y * s)).sum() + decay / 2 * (w[:-1] ** 2).sum())


def descended(x, y, weight, decay, steps=20_000):
    """Plain gradient descent, long enough."""
    w = np.zeros(x.shape[1])
    rate = 1 / ((weight[:, None] * x * x).sum() / 4 + decay)
    for _ in range(steps):
        g = x.T @ (weight * (1 / (1 + np.exp(-(x @ w))) - y))
        g[:-1] += decay * w[:-1]
        w -= rate * g
    return w


def test_votes_of_documents_are_weighed_as_by_a_plain_estimation(make_prose):
    """The posterior of each document by expectation-maximisation over documents, against that over patterns."""
    import math

    rng = random.Random(32)
    texts = [make_prose(rng, 40) if i % 4 else " ".join(w.upper() + "!!" for w in make_prose(rng, 30).split()) for i in range(120)]
    rows = [quality.votes(quality.statistics(t, quality.code_points(t))) for t in texts]
    n = len(quality.LABELLERS)
    p = [0.9 if "1" in r else 0.02 for r in rows]
    for _ in range(50):
        share = (sum(p) + 1) / (len(rows) + 10)
        rate = [[None] * n, [None] * n]
        for c in (0, 1):
            q = p if c == 0 else [1 - x for x in p]
            for j in range(n):
                m = [sum(x for x, r in zip(q, rows, strict=True) if r[j] == v) + 1 for v in "012"]
                rate[c][j] = [x / sum(m) for x in m]
        for j in range(n):
            rate[1][j][1] = min(rate[1][j][1], rate[0][j][1])
        p = []
        for r in rows:
            a, b = (math.prod(rate[c][j][int(v)] for j, v in enumerate(r)) * s for c, s in ((0, share), (1, 1 - share)))
            p.append(a / (a + b))
    first, _, _ = weak_labels.posteriors({r: rows.count(r) for r in set(rows)}, n, steps=50)
    assert all(abs(first[r] - x) < 1e-9 for r, x in zip(rows, p, strict=True))
    assert all((x > 0.5) == (i % 4 == 0) for i, x in enumerate(p))


def test_scorer_is_the_least_loss():
    rng = np.random.default_rng(33)
    x = np.hstack([rng.normal(size=(80, 6)), np.ones((80, 1))]).astype(np.float32)
    y = 1 / (1 + np.exp(-(x @ rng.normal(size=7)))) * 0.9 + 0.05  # soft labels
    weight = np.full(80, 1 / 80)
    mine, plain = weak_labels.fit(x, y, steps=3000), descended(x.astype(float), y, weight, 2e-5)
    assert logistic_loss(mine, x, y, weight, 2e-5) <= logistic_loss(plain, x, y, weight, 2e-5) + 1e-4


def test_toxicity_model_is_that_of_plain_counts(spark, make_prose):
    """Log-count ratios from sets of n-grams, the most telling ones, and a plain logistic fit over presence x ratio."""
    rng = random.Random(34)
    rows = []
    for i in range(120):
        words = make_prose(rng, 15).split()
        words[5:5] = [rng.choice(BAD)] if i % 4 == 0 else [rng.choice(["lovely", "gentle", "kindly"])]
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    sets = [(y, set(toxicity.buckets(t).tolist())) for _, t, y in rows]
    n = [sum(y == c for y, _ in sets) for c in (0, 1)]
    counts = {}
    for y, s in sets:
        for b in s:
            counts.setdefault(b, [0, 0])[y] += 1
    ratio = {b: np.log((c[1] + 0.5) / (n[1] + 1)) - np.log((c[0] + 0.5) / (n[0] + 1)) for b, c in counts.items()}
    z = {b: ratio[b] / np.sqrt(1 / (c[1] + 0.5) + 1 / (c[0] + 0.5)) for b, c in counts.items() if sum(c) >= 3}
    kept = sorted((b for b in z if abs(z[b]) > 3), key=lambda b: (-abs(z[b]), b))[: toxicity.KEPT]
    assert np.flatnonzero(model["table"] >= 0).tolist() == sorted(kept)
    at = {b: int(model["table"][b]) for b in kept}
    # the fit: equal presence vectors count once
    different = sorted({(y, tuple(sorted(at[b] for b in s if b in at))) for y, s in sets})
    y = np.array([d[0] for d in different], float)
    r = np.zeros(len(kept))
    for b in kept:
        r[at[b]] = ratio[b]
    x = np.zeros((len(y), len(kept) + 1))
    x[:, -1] = 1
    for i, (_, on) in enumerate(different):
        for j in on:
            x[i, j] = r[j] * 4 / max(np.sqrt(len(on)), 1)
    weight = np.where(y > 0, np.sqrt((y == 0).sum() / y.sum()), 1.0)
    weight /= weight.sum()
    plain = descended(x, y, weight, 3e-4, steps=4000)
    mine = np.append(model["w"] / (r * 4), model["bias"])
    assert logistic_loss(mine, x, y, weight, 3e-4) <= logistic_loss(plain, x, y, weight, 3e-4) + 1e-3
    scores = {d["doc_id"]: d["score"] for d in toxicity.score(docs, model).collect()}
    assert all((scores[i] >= 0.5) == bool(t) for i, _, t in rows)

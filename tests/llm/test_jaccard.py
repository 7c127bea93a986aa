import collections
import random

import numpy as np
import pytest

from lumenfold.llm import components as C
from lumenfold.llm import jaccard as J


def brute(docs):
    """Links and classes by an inverted index over word shingles."""
    sets, index = {}, collections.defaultdict(set)
    for i, t in docs:
        w = (t or "").lower().split()
        sets[i] = set(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else {tuple(w)}
        for s in sets[i]:
            index[s].add(i)
    links = collections.defaultdict(set)
    for i in sets:
        for j, n in collections.Counter(j for s in sets[i] for j in index[s] if j != i).items():
            if 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n):
                links[i].add(j)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in links:
        for j in links[i]:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: (find(i), len(links[i])) for i in sets}


def corpus(make_prose, seed, near, edits):
    rng = random.Random(seed)
    docs = [make_prose(rng, rng.choice([3, 30, 120])) for _ in range(60)]
    base = make_prose(rng, 150).split()
    passage = make_prose(rng, 60)
    for _ in range(near):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = "".join(rng.choices("abcdefg", k=5))
        docs.append(" ".join(w))
    docs += [make_prose(rng, 60) + " " + passage + " " + make_prose(rng, 60) for _ in range(40)]
    docs += [docs[0]] * 30 + ["  " + docs[1].upper() + " "] + ["", None, " "]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("block", [16, 1024])
def test_classes_and_links_are_those_of_brute_force(spark, make_prose, monkeypatch, block):
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "SKETCHED", block)
    docs = corpus(make_prose, 12, 120, 8)
    got = {r["doc_id"]: r for r in J.classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    want = brute(docs)
    assert {i: r["class_id"] for i, r in got.items()} == {i: c for i, (c, _) in want.items()}
    assert {i: r["n_links"] for i, r in got.items()} == {i: n for i, (_, n) in want.items()}
    sizes = collections.Counter(c for c, _ in want.values())
    assert all(r["class_size"] == sizes[r["class_id"]] for r in got.values())


def test_survivors_are_one_of_each_class(spark, make_prose):
    docs = corpus(make_prose, 13, 60, 5)
    docs += docs[:5]  # repeated rows
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, class_id string")
    kept = J.survivors(df)
    assert kept.columns == df.columns
    want = brute(dict(docs).items())
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for c, _ in want.values()})


def test_survivors_without_ids(spark):
    text = "one two three four five six seven"
    rows = [(None, text), (None, text), (None, "another text of some six words"), (None, None), (None, ""), (5, text + " "), (5, None), (6, "another text of some six words")]
    got = sorted(map(str, map(tuple, J.survivors(spark.createDataFrame(rows, "doc_id long, text string")).collect())))
    assert len(got) == 3 and all(g.startswith("(None") for g in got)  # null ids are the least


@pytest.mark.parametrize("most", [0, 10**6])
def test_broadcast_and_shuffle_give_the_same(spark, make_prose, monkeypatch, most):
    from lumenfold.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    docs = corpus(make_prose, 21, 40, 5)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs)
    assert {r["doc_id"]: r["class_id"] for r in J.classes(df).collect()} == {i: c for i, (c, _) in want.items()}
    assert sorted(r["doc_id"] for r in J.survivors(df).collect()) == sorted({c for c, _ in want.values()})


def test_floor_is_the_level_that_assures_recall():
    assert J.floor_level(0.8, 32, 8, 0.9999) == 6
    assert J.floor_level(0.99, 32, 8, 0.9999) == 8
    with pytest.raises(ValueError):
        J.floor_level(0.1, 2, 8, 0.9999)


def pair_sets(rng, similarity, n):
    out = []
    for _ in range(n):
        common = rng.integers(0, 1 << 63, 400, np.uint64)
        k = round(400 * (1 - similarity) / (2 * similarity))
        out += [np.concatenate([common, rng.integers(0, 1 << 63, k, np.uint64)]) for _ in range(2)]
    return out


def test_matched_prefix_shortens_as_recall_demands():
    rng, hashing = np.random.default_rng(22), J.MinHash(J.TREES * J.DEPTH)

    def level(similarity, recall, n=300):
        p = {i: J.paths(hashing, s) for i, s in enumerate(pair_sets(rng, similarity, n))}
        rows = [(0, i // 2, i) for i in p]  # each pair a bucket of its own
        return J.measured_level(rows, p, similarity - 0.1, 3, recall)

    assert level(0.97, 0.98)[0] == J.DEPTH  # alike pairs meet deep
    assert level(0.8, 0.98)[0] == J.DEPTH and level(0.7, 0.98)[0] < J.DEPTH
    deep = [level(0.65, r)[0] for r in (0.4, 0.8, 0.95, 0.98)]
    assert deep == sorted(deep, reverse=True) and deep[0] > deep[-1]
    found, seen = level(0.6, 0.9)
    assert all(v < 0.9 for k, v in seen.items() if k > found)
    assert level(0.97, 0.98, n=5)[0] == 3  # too small a sample to show it: down to the floor
    assert J.measured_level([], {}, 0.8, 6, 0.9)[0] == 6


def test_tries_know_how_deep_texts_meet(spark):
    rng = np.random.default_rng(23)
    paths = rng.integers(-(1 << 63), 1 << 63, (200, J.TREES))
    for i in range(0, 120, 2):  # from 1 to 8 levels in common, in one trie
        same = np.uint64(0xFFFFFFFFFFFFFFFF) << np.uint64(8 * (J.DEPTH - 1 - i % J.DEPTH))
        old, new = (paths[j : j + 1, i % J.TREES].view(np.uint64) for j in (i, i + 1))
        new[:] = (old & same) | (new & ~same)
    df = spark.createDataFrame([(i, [int(x) for x in p]) for i, p in enumerate(paths)], "_key long, paths array<long>")
    got = {(r["tree"], r["_key"]): r["met"] for r in J.sorted_tries(df.repartition(3), 4).collect()}
    for t in range(J.TREES):
        col = paths[:, t].copy()
        for i in range(200):
            deep = int(J.levels(np.delete(col, i), col[i]).max())
            assert got.get((t, i), 0) == deep or got.get((t, i), 0) == J.DEPTH or deep < 4 and (t, i) not in got
            assert deep < 4 or (t, i) in got


def test_recall_at_the_threshold(spark, make_prose):
    rng, docs = random.Random(24), []
    for i in range(150):
        w = [f"w{rng.randrange(10**6)}" for _ in range(204)]  # 200 shingles
        docs += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:-22] + [f"x{rng.randrange(10**6)}" for _ in range(22)]))]  # 178 in common
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert all(0.8 <= 178 / 222 < 0.81 for _ in [0])
    got = {r["doc_id"]: r["n_links"] for r in J.classes(df).collect()}
    assert sum(got.values()) >= 0.99 * 300


def test_word_hashes_follow_split():
    for t in ("", " ", "a", " a  b\tc\n", "Äé x　y z", "a\x1cb\x85c", "same same same"):
        h = J.word_hashes(t)
        words = t.lower().split()
        assert len(h) == len(words)
        assert len(set(h.tolist())) == len(set(words))
    assert J.word_hashes("x word")[1] == J.word_hashes("word and")[0]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(14)
    m = J.MinHash(256)
    for share in (0.2, 0.5, 0.8, 0.95):
        got = []
        for _ in range(20):
            common = rng.integers(0, 1 << 63, 400, np.uint64)
            n = int(400 * (1 - share) / (2 * share))
            a, b = (np.concatenate([common, rng.integers(0, 1 << 63, n, np.uint64)]) for _ in range(2))
            got.append((m.signature(a) == m.signature(b)).mean())
        assert abs(np.mean(got) - 400 / (400 + 2 * n)) < 0.03


def test_overlaps_count_shared_items():
    rng = np.random.default_rng(15)
    sets = [np.unique(rng.integers(0, 300, 80).astype(np.uint64)) for _ in range(12)]
    got = J.overlaps(sets, np.arange(5), np.arange(5, 12), width=16)
    assert got.tolist() == [[len(np.intersect1d(sets[i], sets[j])) for j in range(5, 12)] for i in range(5)]


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(200, 201), (201, 200), (7, 7)]
    got = {r[0]: r[1] for r in C.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}
    assert C.components(spark.createDataFrame([], "u long, v long")).collect() == []


@pytest.mark.parametrize("parts", ["1", "3", "40"])
def test_matched_prefix_is_that_of_all_tries(spark, parts):
    rng = np.random.default_rng(25)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for deep, want in ((None, J.DEPTH), (7, 7), (6, 6), (5, J.DEPTH)):
            for _ in range(3):  # one pair that meets `deep` levels, somewhere among pairs that are alike
                paths = np.repeat(rng.integers(-(1 << 63), 1 << 63, 30), 2)
                if deep:
                    paths[1] ^= np.int64(1 << 8 * (J.DEPTH - 1 - deep))
                df = spark.createDataFrame([(i, [int(p), int(p)]) for i, p in enumerate(paths)], "_key long, paths array<long>")
                assert J.matched_level(J.sorted_tries(df, 6), 6) == want, (deep, parts)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert J.matched_level(J.sorted_tries(df.limit(0), 6), 6) == J.DEPTH


def test_a_link_that_only_short_prefixes_bring_is_found_among_many_copies(spark):
    """200 groups of 16 alike texts, which meet deep and of which any sample consists, and one pair that meets at the floor alone."""
    rng, hashing = np.random.default_rng(26), J.MinHash(J.TREES * J.DEPTH)
    while True:  # a pair at the threshold that no trie brings together by seven or eight levels
        a, b = pair_sets(rng, 0.8, 1)
        deep = J.levels(J.paths(hashing, a), J.paths(hashing, b))
        if deep.max() == 6:
            break
    rows = [(16 * i + k, [int(x) for x in J.paths(hashing, s)]) for i in range(200) for s in [rng.integers(0, 1 << 63, 20, np.uint64)] for k in range(16)]
    rows += [(10_000 + k, [int(x) for x in J.paths(hashing, s)]) for k, s in enumerate((a, b))]
    texts = spark.createDataFrame(rows, "_key long, paths array<long>")
    tries = J.sorted_tries(texts, 6).cache()
    edges = {tuple(sorted(r)) for r in J._candidates(tries, texts, J.matched_level(tries, 6), 0.8).collect()}
    assert (10_000, 10_001) in edges and len(edges) == 200 * 15 + 1

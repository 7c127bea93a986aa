import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenfold.llm import winnowing as W
from lumenfold.llm.common import code_points


def brute(text, k, w):
    c = code_points(text)
    if not len(c):
        return []
    k = min(k, len(c))
    h = [int(W.gram_hashes(c[i : i + k], k)[0]) for i in range(len(c) - k + 1)]
    w = min(w, len(h))
    chosen = {max(j for j in range(i, i + w) if h[j] == min(h[i : i + w])) for i in range(len(h) - w + 1)}
    return [(h[j], j) for j in sorted(chosen)]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abé日 ", max_size=120), st.integers(1, 9), st.integers(1, 12))
def test_winnowing_is_the_definition(text, k, w):
    h, at = W.winnow(code_points(text), k, w)
    assert list(zip(h.tolist(), at.tolist(), strict=True)) == brute(text, k, w)
    again = W.parsed(W.written_out(h, at))
    assert (again[0] == h).all() and (again[1] == at).all()


def test_shared_runs_are_always_found(make_prose):
    rng = random.Random(3)
    for _ in range(30):
        run = make_prose(rng, 40)[: W.K + W.W - 1]
        a, b = make_prose(rng, 50) + run + make_prose(rng, 20), make_prose(rng, 9) + run + make_prose(rng, 60)
        assert len(np.intersect1d(W.winnow(code_points(a))[0], W.winnow(code_points(b))[0])) > 0


@pytest.mark.parametrize("rows_each", [1, 7, 10_000])
def test_neighbours_against_a_plain_loop(spark, make_prose, rows_each):
    rng = random.Random(4)
    docs = [(i * 3, make_prose(rng, rng.choice([0, 3, 30, 200]))) for i in range(60)]
    docs[10] = (30, None)
    rng.shuffle(docs)
    got = {r["doc_id"]: r for r in W.compare_neighbours(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), rows_each=rows_each).collect()}
    order = sorted(docs)
    assert len(got) == len(order)
    for (i, a), (_, b) in zip(order, order[1:] + order[:1], strict=True):
        a, b = a or "", b or ""
        cut = len(a) // 4
        edited = a[: len(a) - cut] + b[:cut]
        r = got[i]
        sets = [{h for h, _ in brute(t, W.K, W.W)} for t in (a, edited, b)]
        like = lambda x, y: 1.0 if not x and not y else len(x & y) / len(x | y)
        assert r["n_chars"] == len(a) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(like(sets[0], sets[1])) and r["near_next"] == pytest.approx(like(sets[0], sets[2]))
        assert W.parsed(r["fingerprint"])[0].tolist() == [h for h, _ in brute(a, W.K, W.W)]

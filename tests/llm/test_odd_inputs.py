"""Every operator over nulls, empty and very long texts, ties, repeated rows, clashing column names and empty tables."""

import collections
import hashlib
import os

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from lumenfold.llm import packing, queries as Q, unigram, winnowing
from lumenfold.llm.common import code_points

from conftest import ODD
from test_jaccard import brute
from test_spans import BASE, base_spans, secret_spans


def tables(tmp_path, spark, docs, labels):
    d = str(tmp_path / "sf")
    os.makedirs(d)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


NAMES = [n for n in Q.queries() if n != "op1_neighbours"]  # its odd vectors are in test_ann.py
SORTED = sorted(ODD, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def of_winnowing():
    texts = [t or "" for _, t in SORTED]
    for (i, _), a, b in zip(SORTED, texts, texts[1:] + texts[:1], strict=True):
        cut = len(a) // 4
        mark = winnowing.written_out(*winnowing.winnow(code_points(a)))
        yield i, len(a), sha(a[: len(a) - cut] + b[:cut]), mark


def of_tokens():
    counter = unigram.Counter(unigram.pieces_of(P.path("piece_bpe_32k.model")))
    return [(i, *counter.count(t or "")) for i, t in ODD]


def of_bpe():
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    import numpy as np

    for i, t in ODD:
        ids = library.encode(t or "", add_special_tokens=False).ids
        yield i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(library.decode(ids, skip_special_tokens=False))


def of_secrets():
    kinds = ("assign", "access", "hex")
    for i, t in ODD:
        found = secret_spans(t or "")
        yield i, *(sum(k == n for _, k, _ in found) for n in range(3)), sha(",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in found))


def of_personal():
    kinds = ("email", "ip", "card", "phone")
    assert len(BASE) == len(kinds)
    for i, t in ODD:
        found = base_spans(t or "")
        yield i, *(sum(k == n for _, k, _ in found) for n in range(4)), sha(",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in found))


WANTED = {
    "op2_winnowing": (("doc_id", "n_chars", "edited_sha256", "fingerprint"), of_winnowing),
    "op5_token_counts": (("doc_id", "n_tokens", "score"), of_tokens),
    "op7_secrets": (("doc_id", "n_assign", "n_access", "n_hex", "base_sha256"), of_secrets),
    "op9_bpe": (("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), of_bpe),
    "op10_pii": (("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"), of_personal),
}


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(name, spark, odd, tmp_path):
    d = tables(tmp_path, spark, odd, [(1, 1, 0), (4, None, None), (None, 1, 1), (10, 0, 1), (10, 0, 1)])
    rows = Q.queries()[name](spark, d).collect()
    if name in WANTED:
        columns, wanted = WANTED[name]
        assert sorted((tuple(r[c] for c in columns) for r in rows), key=str) == sorted(map(tuple, wanted()), key=str)
    elif name == "op3_quality":
        assert sorted(str((r["doc_id"], r["quality_score"] == 0.0 and not r["keep"])) for r in rows) == sorted(str((i, not t)) for i, t in ODD)
        assert all(0 <= r["quality_score"] <= 1 for r in rows)
    elif name == "op4_toxicity":
        assert collections.Counter(r["doc_id"] for r in rows) == collections.Counter(i for i, _ in ODD)
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] in (2, 3)}) == 1  # an empty text and none
    elif name == "op6_jaccard":
        want = brute([(n, t) for n, (_, t) in enumerate(ODD)])
        size, least = collections.Counter(c for c, _ in want.values()), {}
        for n, (i, _) in enumerate(ODD):
            c = want[n][0]
            least[c] = min(least.get(c, (True, 1 << 60)), (i is not None, i or 0))
        got = [(r["doc_id"], r["class_id"], r["class_size"], r["n_links"]) for r in rows]
        assert sorted(got, key=str) == sorted(((i, least[want[n][0]][1] if least[want[n][0]][0] else None, size[want[n][0]], want[n][1]) for n, (i, _) in enumerate(ODD)), key=str)
    else:
        library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
        want = collections.Counter((i, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in ODD)
        assert collections.Counter((r["doc_id"], r["doc_tokens"]) for r in rows if r["start"] == 0) == want
        total = collections.Counter()
        for r in rows:
            total[r["doc_id"]] += r["length"]
        assert total == sum((collections.Counter({i: n * k}) for (i, n), k in want.items()), collections.Counter())


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(name, spark, none, tmp_path):
    assert Q.queries()[name](spark, tables(tmp_path, spark, none, [])).collect() == []


@pytest.mark.parametrize("name", ["op3_quality", "op4_toxicity", "op6_jaccard"])
def test_documents_without_labels_and_all_equal(name, spark, tmp_path):
    docs = spark.createDataFrame([(i, "The very same words in every text.") for i in range(40)], "doc_id long, text string")
    rows = Q.queries()[name](spark, tables(tmp_path, spark, docs, [])).drop("doc_id", "held_out").distinct().collect()
    assert len(rows) == 1  # equal texts, equal results


def test_rows_repeated_without_end_are_more_than_one_group(spark):
    """Equal rows have equal draws; their group is cut all the same."""
    docs = spark.createDataFrame([(7, "the same words")] * 500, "doc_id long, text string")
    rows = packing.pack(docs, P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), length=16, group=50).collect()
    assert len(rows) == 500 and len({r["sequence_id"] >> packing.BIN_BITS for r in rows}) >= 8
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 16


def test_pipeline_columns_may_have_any_name(spark, folder_of):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    names = ["_key", "_id", "_at", "_at2", "_doc", "_spans", "_rules", "_score", "_toxic", "_keep", "score", "keep", "toxic", "doc", "hash", "other", "rules", "spans", "draw", "group", "part", "place", "base", "found", "id", "first"]
    docs = spark.read.parquet(f"{folder_of}/documents.parquet")
    for i, n in enumerate(names):
        docs = docs.selectExpr("*", f"{i} AS `{n}`")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder_of)
        assert out.columns == docs.columns
        docs = out.cache()
        assert docs.count() > 0 and docs.select(names[5]).distinct().collect() == [(5,)]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder_of).count() > 0


@pytest.fixture()
def folder_of(spark, make_prose, tmp_path):
    import random

    rng = random.Random(31)
    texts = [make_prose(rng, 80) + (" despicable vermin" if i % 5 == 0 else "") + (" password: hunter2hunter2" if i % 7 == 0 else "") for i in range(60)]
    texts += texts[:5]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    return tables(tmp_path, spark, docs, [(i, 1, int(i % 5 == 0)) for i in range(60)])

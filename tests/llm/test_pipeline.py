"""The corpus pipeline against a plain version of each stage on the same documents."""

import os
import random

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from lumenfold.llm import quality, secrets, toxicity  # noqa: E402
from lumenfold.llm.common import code_points  # noqa: E402

from test_jaccard import brute  # noqa: E402
from test_spans import secret_spans  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, make_prose, tmp_path_factory):
    rng = random.Random(18)
    docs, labels = [], []
    for i in range(400):
        t = make_prose(rng, rng.choice([20, 100, 300]))
        toxic, junk = i % 9 == 0, i % 11 == 0
        if toxic:
            w = t.split()
            w[len(w) // 2 : len(w) // 2] = ["despicable", "vermin"]
            t = " ".join(w)
        if junk:
            t = " ".join(x.upper() + "!!" for x in t.split())
        if i % 13 == 0:
            t += " password: hunter2hunter2 and more."
        docs.append((i, t, "en", "src1", len(t)))
        if i % 2 == 0:
            labels.append((i, int(not junk), int(toxic)))
    docs += [(1000 + i, docs[i][1] + " Added end.", "en", "src0", docs[i][4] + 11) for i in range(100, 160) if docs[i][4] > 900]
    docs += [(2000 + i, docs[i][1], "en", "src0", docs[i][4]) for i in range(50)]
    docs += [(3000, None, None, None, None), (3001, "", "en", None, 0)]
    d = str(tmp_path_factory.mktemp("sf"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(os.path.join(d, "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(os.path.join(d, "labels.parquet"))
    return d


def test_every_stage_and_the_whole(spark, folder):
    now = spark.read.parquet(f"{folder}/documents.parquet")
    columns = now.columns
    rows = {r["doc_id"]: r["text"] for r in now.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "quality", "near_duplicates", "secrets", "packing"]

    # 1: the model's rule, applied by a loop
    model = toxicity.train(now, spark.read.parquet(f"{folder}/labels.parquet").where(~toxicity.held_out()))

    def toxic(t):
        j = model["table"][toxicity.buckets(t)]
        j = np.unique(j[j >= 0])
        s = model["bias"] + (model["w"][j].sum() / np.sqrt(len(j)) if len(j) else 0)
        return 1 / (1 + np.exp(-s)) >= toxicity.THRESHOLD

    now = stages["toxicity"](spark, now, folder).cache()
    want = {i for i, t in rows.items() if not toxic(t)}
    assert now.columns == columns and {r["doc_id"] for r in now.collect()} == want
    assert not any("vermin" in (rows[i] or "") for i in want)

    # 2
    model = quality.train(now)

    def keeps(t):
        c = code_points(t or "")
        s = quality.SCALE * (quality.features(c, quality.statistics(t, c)) @ model["w"][:-1]) + model["w"][-1] if len(c) else -99
        return 1 / (1 + np.exp(-s)) >= quality.THRESHOLD

    now = stages["quality"](spark, now, folder).cache()
    want = {i for i in want if keeps(rows[i])}
    assert now.columns == columns and {r["doc_id"] for r in now.collect()} == want
    assert not any("!!" in rows[i] for i in want) and len(want) > 300

    # 3
    now = stages["near_duplicates"](spark, now, folder).cache()
    classes = brute([(i, rows[i]) for i in want])
    want = {c for c, _ in classes.values()}
    assert now.columns == columns and sorted(r["doc_id"] for r in now.collect()) == sorted(want)

    # 4
    now = stages["secrets"](spark, now, folder).cache()
    got = {r["doc_id"]: r for r in now.collect()}
    assert now.columns == columns and set(got) == want
    for i in want:
        t, out, at = rows[i], "", 0
        for s, _, e in secret_spans(t):
            out, at = (out + t[at:s] + "[SECRET]", e) if s >= at else (out, max(at, e))
        assert got[i]["text"] == out + t[at:] and got[i]["n_chars"] == len(got[i]["text"])
    assert any("[SECRET]" in r["text"] for r in got.values())
    assert len(secrets.RULES) > 3

    # 5, and run() as a whole
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokens = {i: len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for i, r in got.items()}
    packed = stages["packing"](spark, now, folder)
    whole = corpus_pipeline.run(spark, folder)
    for df in (packed, whole):
        total = {}
        for r in df.collect():
            total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
        assert total == tokens
    key = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, packed.select(*key).collect())) == sorted(map(tuple, whole.select(*key).collect()))


def test_stages_stand_odd_and_empty_documents(spark, odd, none, folder):
    rows = odd.select("doc_id", "text", "lang", "source", "n_chars", "label", "id")
    for docs in (rows, rows.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, folder)
            assert docs.columns == rows.columns
            docs = docs.cache()
            docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() >= 0

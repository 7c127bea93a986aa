import random
from zlib import crc32

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer, models, normalizers

from lumenfold.llm import bpe, packing, unigram

ODD = [chr(c) for c in range(0x250)] + list("日本語ǅ½²́​ ſK̈😀ﬁ①▁▁▁") + ["  ", "   ", "<0x0A>", "the", " the", "'re", "'LL", "<|startoftext|>", "<|endoftext|>", "</w>", "\n\n"]


def texts(make_prose):
    rng = random.Random(9)
    out = [make_prose(rng, n) for n in (1, 5, 80, 900)]
    out += ["".join(rng.choices(ODD, k=rng.randint(0, 60))) for _ in range(1500)]
    return [*out, "", " ", "a" * 3000, "ab" * 700, "!" * 999, "thethethethe" * 50, "İstanbul I", "x" + " " * 400 + "y"]


def test_unigram_counts_are_the_librarys(make_prose):
    pieces = unigram.pieces_of(P.path("piece_bpe_32k.model"))
    library = Tokenizer(models.Unigram(pieces, 0, True))
    library.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    mine = unigram.Counter(pieces)
    assert mine.stretches
    for t in texts(make_prose):
        assert mine.count(t)[0] == len(library.encode(t, add_special_tokens=False).ids), t


def test_unigram_ties_go_to_the_longest_last_piece():
    pieces = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0), ("▁ab", -3.0), *[(f"<0x{i:02X}>", -50.0) for i in range(256)]]
    library = Tokenizer(models.Unigram(pieces, 0, True))
    library.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    mine = unigram.Counter(pieces)
    for t in ("ab", "aab", "abab", "b a ab", "axb", "éa", "a\nb", "ab  ba"):
        assert mine.count(t)[0] == len(library.encode(t, add_special_tokens=False).ids), t
        assert mine.viterbi("▁" + t.replace(" ", "▁")) == mine.count(t)[::-1]


def test_cache_of_bounded_size_changes_nothing(make_prose, monkeypatch):
    t = make_prose(random.Random(1), 500)
    path = P.path("word_bpe_49k.json")
    big, small = bpe.Encoder(path), bpe.Encoder(path)
    monkeypatch.setattr(bpe, "CACHE", 3)
    assert small.encode(t).tolist() == big.encode(t).tolist() and len(small._words) <= 3


def test_bpe_encodes_and_decodes_as_the_library(make_prose):
    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    encoder, decoder = bpe.codec(path)
    for t in texts(make_prose):
        ids = library.encode(t, add_special_tokens=False).ids
        assert encoder.encode(t).tolist() == ids, t
        assert decoder.decode(np.array(ids, np.int64)).decode() == library.decode(ids, skip_special_tokens=False)


def test_bpe_round_trip_through_tables(spark):
    path = P.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(1, "Hello, hello wide World 42!"), (2, None)], "doc_id long, text string")
    back = {r["doc_id"]: r["text"] for r in bpe.decode_table(bpe.encode_table(docs, path), path).collect()}
    assert back[2] == "" and back[1].replace("</w>", "").split() == "hello , hello wide world 4 2 !".split()


def naive_first_fit(sizes, room):
    bins, out = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = next((b for b, left in enumerate(bins) if left >= sizes[i]), len(bins))
        if b == len(bins):
            bins.append(room)
        out[i] = (b, room - bins[b])
        bins[b] -= sizes[i]
    return [out[i] for i in range(len(sizes))]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 400])
def test_tournament_tree_is_first_fit_decreasing(n):
    sizes = np.random.default_rng(n).integers(1, 101, n)
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    assert list(zip(bins.tolist(), offsets.tolist(), strict=True)) == naive_first_fit(sizes.tolist(), 100)


@pytest.mark.parametrize("group", [3, 10_000])
def test_pieces_hold_every_id_once_and_fill_sequences(spark, make_prose, group):
    json_path, ranks = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
    library = Tokenizer.from_file(json_path)
    rng = random.Random(11)
    docs = [(i, make_prose(rng, rng.choice([1, 40, 300, 1500])) if i else None) for i in range(80)] + [(80, "".join(rng.choices(ODD, k=3000)))]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), json_path, ranks, group=group).collect()
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in docs}
    by_doc, by_sequence = {}, {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, x in ids.items():
        assert [s for s, _ in sorted(by_doc[i])] == [0, *np.cumsum([n for _, n in sorted(by_doc[i])])[:-1].tolist()] and sum(n for _, n in by_doc[i]) == len(x)
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    if group > 3:
        total = sum(map(len, ids.values()))
        assert len(by_sequence) * 1024 - total < 1024 + 0.03 * total


def test_plain_texts_are_tokenized_as_by_the_library(make_prose):
    json_path, ranks = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
    library = Tokenizer.from_file(json_path)
    mine = packing.tokenizer(json_path, ranks)
    for t in texts(make_prose):
        assert mine(t).tolist() == library.encode(t, add_special_tokens=False).ids, t

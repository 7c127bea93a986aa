"""Operator 9: exact BPE encoding by backtracking, and decoding by an offset table.

A word is a string of symbols: its bytes, the last one marked where the vocabulary has word ends. One
Aho-Corasick pass finds the longest token that starts at each symbol. The encoder takes longest tokens and
steps back to shorter ones until every neighbouring pair is compatible, that is, until merging the pair's
text by the merge ranks would give just these two tokens. A position that led nowhere isn't tried again, so
the time is linear. Words are independent, so their ids are kept in a cache of bounded size.

Normalising and splitting follow the tokenizer file. Texts of plain letters, digits and marks are split by an
equivalent pattern here; texts with other characters are normalised and split by the library itself. Files of which
ids don't fit 16 bits, or of which two merges make one token, are refused, as this encoder isn't made for them.
Null texts count as empty: no ids, an empty decoded text. Texts are encoded whole, one at a time, in time and memory
linear in their length. A text's ids depend on the text alone, so copies and repeated rows agree. An empty table
gives an empty result. Columns beside the text are dropped or, when `keep_columns` asks for them, passed through.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lumenfold.llm.common import map_rows

#: Words and pairs whose results are kept, at most, before the cache starts anew.
CACHE = 400_000

#: Characters for which this module's normalising and splitting are the library's. Left out: separators that
#: only Python takes as white space, digits that aren't decimal, the capital I with a dot, and all from U+0250 on.
_OTHER = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ɏ]")
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where it is printable, else the next letter from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Words to ids for a BPE model of the tokenizers library."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path) as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.library = Tokenizer.from_file(path)
        if max(vocab.values(), default=0) > 0xFFFF or any(t["id"] > 0xFFFF for t in spec["added_tokens"]):
            raise ValueError("this encoder is for vocabularies of at most 65,536 ids")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        marks = {t[:2] for t in self.special}
        self._first_special = lambda text: any(m in text for m in marks)
        self._stand_in = {letter: b for b, letter in byte_letters().items()}
        # tokens are numbered by rank: first the symbols, then the merges in order
        text: list[str] = []
        ids: list[int] = []
        rank: dict[str, int] = {}
        for mark, suffix in ((0, ""), (256, self.end)) if self.end else ((0, ""),):
            for b, letter in byte_letters().items():
                if (name := letter + suffix) in vocab:
                    rank[name] = len(text)
                    text.append(chr(b + mark))
                    ids.append(vocab[name])
        self.first = len(text)
        self.parts: list[tuple[int, int]] = [(i, i) for i in range(self.first)]
        self.joined: dict[tuple[int, int], int] = {}
        for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
            pair, name = (rank[a], rank[b]), a + b
            if name in rank:
                raise ValueError(f"two merges make {name!r}; this encoder needs one each")
            rank[name] = self.joined[pair] = len(text)
            text.append(text[pair[0]] + text[pair[1]])
            ids.append(vocab[name])
            self.parts.append(pair)
        self.size, self.ids = [len(t) for t in text], ids
        by_text = {t: i for i, t in enumerate(text)}
        self.shorter = [next((by_text[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in by_text), -1) for t in text]
        self.matches = ahocorasick.Automaton()
        for i, t in enumerate(text):
            self.matches.add_word(t, i)
        self.matches.make_automaton()
        self._pairs: dict[tuple[int, int], bool] = {}
        self._words: dict[str, bytes] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the text of token a followed by that of b gives a and b again.

        Undoes the merges of both sides, latest first, and looks at each pair that met at the border: if it has
        a merge that came earlier than whatever was undone there, the border would have been merged away.
        """
        got = self._pairs.get((a, b))
        if got is not None:
            return got
        at, before, fine = (a, b), 1 << 62, True
        while True:
            left, right = at
            if self.joined.get(at, before) < before:
                fine = False
                break
            undo_left = left >= self.first and (left > right or right < self.first)
            if undo_left:
                before, at = left, (self.parts[left][1], right)
            elif right >= self.first:
                # the right side's merges lie further on: at equal rank the border's pair would go first
                before, at = right + 1, (left, self.parts[right][0])
            else:
                break
        if len(self._pairs) > CACHE:
            self._pairs.clear()
        self._pairs[a, b] = fine
        return fine

    def encode_symbols(self, symbols: str) -> list[int]:
        n, size, shorter = len(symbols), self.size, self.shorter
        longest = [-1] * n
        for last, token in self.matches.iter(symbols):
            longest[last - size[token] + 1] = token  # later ends are longer
        out: list[int] = []
        dead, at = bytearray(n + 1), 0
        token = longest[0] if n else -1
        while at < n:
            while token >= 0:
                after = at + size[token]
                if not dead[after] and (not out or self.compatible(out[-1], token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                token = longest[at] if at < n else -1
            else:
                if not out:
                    raise ValueError("a symbol isn't in the vocabulary")
                dead[at] = 1
                last = out.pop()
                at -= size[last]
                token = shorter[last]
        return out

    def word(self, raw: bytes) -> list[int]:
        symbols = raw.decode("latin-1")
        if self.end and symbols:
            symbols = symbols[:-1] + chr(256 + raw[-1])
        return [self.ids[t] for t in self.encode_symbols(symbols)]

    def _kept(self, word: str) -> bytes:
        got = self._words.get(word)
        if got is None:
            if len(self._words) >= CACHE:
                self._words.clear()
            got = self._words[word] = np.array(self.word(word.encode()), "<u4").astype("<u2").tobytes()
        return got

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self._kept, _WORDS.findall(text.lower())))

    def _by_library(self, text: str) -> bytes:
        norm = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
        out = []
        for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(norm):
            out.append(np.array(self.word(bytes(map(self._stand_in.__getitem__, piece))), "<u4").astype("<u2").tobytes())
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        parts = self._split_special.split(text) if self._split_special and self._first_special(text) else [text]
        out = []
        for p in parts:
            if p in self.special:
                out.append(np.array([self.special[p]], "<u2").tobytes())
            elif p:
                out.append(self._by_library(p) if _OTHER.search(p) else self._plain(p))
        return np.frombuffer(b"".join(out), "<u2").astype("<u4")


class Decoder:
    """ids to text: all tokens' bytes in one array, a table of offsets, and one gather a text. Tokens are joined by spaces, as the file names no decoder."""

    def __init__(self, path: str):
        with open(path) as f:
            spec = json.load(f)
        if spec.get("decoder"):
            raise ValueError("this table is for files without a decoder")
        names = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        tokens = [(names.get(i, "") + " ").encode() for i in range(max(names) + 1)]
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.offset = np.cumsum(self.size) - self.size

    def decode(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        size = self.size[ids]
        to = np.cumsum(size)
        return self.data[np.repeat(self.offset[ids] - to + size, size) + np.arange(to[-1])].tobytes()[:-1]


_MADE: dict[str, tuple[Encoder, Decoder]] = {}


def codec(path: str) -> tuple[Encoder, Decoder]:
    if path not in _MADE:
        _MADE[path] = Encoder(path), Decoder(path)
    return _MADE[path]


def encode_table(docs: DataFrame, path: str, text: str = "text", keep_columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """ids (array of int) of every text."""

    def row():
        encoder = codec(path)[0]
        return lambda t: (encoder.encode(t or "").tolist(),)

    schema = T.StructType([*(docs.schema[c] for c in keep_columns), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return map_rows(docs.select(*dict.fromkeys([*keep_columns, text])), schema, list(keep_columns), row, [text])


def decode_table(ids: DataFrame, path: str, column: str = "ids", keep_columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """text of every array of ids."""

    def row():
        decoder = codec(path)[1]
        return lambda x: (decoder.decode(np.array(x or [], np.int64)).decode(),)

    schema = T.StructType([*(ids.schema[c] for c in keep_columns), T.StructField("text", T.StringType())])
    return map_rows(ids.select(*dict.fromkeys([*keep_columns, column])), schema, list(keep_columns), row, [column])


def digests(docs: DataFrame, path: str, text: str = "text", keep_columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """n_tokens, and digests of the ids and of the text that they decode to, in one pass."""

    def row():
        encoder, decoder = codec(path)

        def one(t):
            ids = encoder.encode(t or "")
            return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoder.decode(ids)).hexdigest()

        return one

    schema = T.StructType([*(docs.schema[c] for c in keep_columns), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return map_rows(docs.select(*dict.fromkeys([*keep_columns, text])), schema, list(keep_columns), row, [text])

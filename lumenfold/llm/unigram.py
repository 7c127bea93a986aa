"""Operator 5: token counts under a unigram vocabulary, by a count-only Viterbi pass.

Aho-Corasick enumerates the pieces that end at each character; dynamic programming carries, for every
position, only the best score and the piece count of the best segmentation. Rules are those of the tokenizers
library's Unigram model with byte fallback: scores add up in double precision; of equal scores the piece that
starts first (the longest) stays; a character that is no piece itself costs the least score less 10 and counts
as its UTF-8 bytes. A space becomes the mark U+2581, and one stands before the text.

No piece goes over a mark after another character, nor over a line feed, so the stretches between are
independent, and the results of common ones are kept in a cache of bounded size. Null texts count as empty:
no tokens, score 0. Texts are counted whole, one at a time, in time linear in their length (a stretch without a mark
or line feed, however long, is worked on at once). Copies and repeated rows agree. An empty table gives an empty
result. Columns beside the text are dropped or, when `keep_columns` asks for them, passed through.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lumenfold.llm.common import map_rows

MARK = "▁"
#: Stretches whose results are kept, at most, before the cache starts anew.
CACHE = 400_000
UNKNOWN_PENALTY = 10.0


def pieces_of(model_file: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model, by id."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_file)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.matches = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.matches.add_word(piece, (len(piece), float(score)))
        self.matches.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        names = [p for p, _ in pieces]
        apart = f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+" if not any("\n" in p for p in names) else None
        self.stretches = re.compile(apart).findall if apart and not any(re.search(f"[^{MARK}]{MARK}", p) for p in names) else None
        # a stretch is only cut off at a line feed if that is no piece, and then it counts as one byte
        self.kept: dict[str, tuple[float, int]] = {}

    def viterbi(self, s: str) -> tuple[float, int]:
        """Score and count of the best segmentation of s."""
        n = len(s)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, piece in self.matches.iter(s):
            ends[last + 1].append(piece)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            best, pieces, single = None, 0, False
            for size, own in sorted(ends[end], reverse=True):
                single |= size == 1
                made = score[end - size] + own
                if best is None or made > best:
                    best, pieces = made, count[end - size] + 1
            if not single and (best is None or score[end - 1] + self.unknown > best):
                best, pieces = score[end - 1] + self.unknown, count[end - 1] + len(s[end - 1].encode())
            score[end], count[end] = best, pieces
        return score[n], count[n]

    def count(self, text: str) -> tuple[int, float]:
        """Number of tokens and the segmentation's score."""
        if not text:
            return 0, 0.0
        s = MARK + text.replace(" ", MARK)
        if not self.stretches:
            score, n = self.viterbi(s)
            return n, score
        kept, feeds = self.kept, s.count("\n")
        total, tokens = feeds * self.unknown, feeds
        for part in self.stretches(s):
            got = kept.get(part)
            if got is None:
                if len(kept) >= CACHE:
                    kept.clear()
                got = kept[part] = self.viterbi(part)
            total += got[0]
            tokens += got[1]
        return tokens, total


_MADE: dict[str, Counter] = {}


def counter(model_file: str) -> Counter:
    if model_file not in _MADE:
        _MADE[model_file] = Counter(pieces_of(model_file))
    return _MADE[model_file]


def counts(docs: DataFrame, model_file: str, text: str = "text", keep_columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """n_tokens and score of every text."""

    def row():
        c = counter(model_file)
        return lambda t: c.count(t or "")

    schema = T.StructType([*(docs.schema[c] for c in keep_columns), T.StructField("n_tokens", T.LongType()), T.StructField("score", T.DoubleType())])
    return map_rows(docs.select(*dict.fromkeys([*keep_columns, text])), schema, list(keep_columns), row, [text])

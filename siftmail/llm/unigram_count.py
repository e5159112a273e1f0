"""Count-only Viterbi over a unigram vocabulary: how many pieces the best segmentation of a text has.

Aho-Corasick enumerates every vocabulary match; a dynamic program over end positions carries the best score and its
piece count, no back pointers. Tie rule, as in the tokenizers' unigram encoders: a candidate replaces the best path
to its end only if its score is strictly greater, candidates coming by start from left to right, so of equal
scores the longest last piece wins; a character that no single-character piece covers may be unknown at 10 below the
lowest score, tried last. An unknown character counts as its UTF-8 bytes (byte fallback).

Text is prepared as the vocabulary's own normaliser does: U+2581 for each space, one in front. If no piece has U+2581
after another character, no piece crosses from a word into the next space, and the program runs on each
space-delimited unit alone, each distinct unit once (the memory is bounded). Otherwise it runs on the whole text.

Null and empty text: 0 pieces, score 0. Repeated rows are counted each; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SPACE = "▁"


def vocabulary(path: str) -> list[tuple[str, float]]:
    """The pieces of a sentencepiece file that text can match (no control, unknown, unused or byte pieces), with scores."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    n = range(sp.get_piece_size())
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in n if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]


class Counter(dict):
    """unit -> (pieces, score) of its best segmentation."""

    def __init__(self, pieces: list[tuple[str, float]], penalty: float = 10.0):
        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = frozenset(p for p, _ in pieces if len(p) == 1)
        self.unknown = min(s for _, s in pieces) - penalty
        crossing = any(SPACE in p.lstrip(SPACE) for p, _ in pieces)
        self.unit = re.compile("[\\s\\S]+" if crossing else f"{SPACE}+[^{SPACE}]*")

    def __missing__(self, unit: str) -> tuple[int, float]:
        if len(self) > 400_000:
            self.clear()
        found = self.segment(unit)
        if len(unit) < 100:
            self[unit] = found
        return found

    def segment(self, unit: str) -> tuple[int, float]:
        n, single, unknown = len(unit), self.single, self.unknown
        best, count = [float("-inf")] * (n + 1), [0] * (n + 1)
        best[0], done = 0.0, 0  # ends up to ``done`` are final
        for last, (length, score) in self.automaton.iter(unit):
            while done < last:
                c = unit[done]
                done += 1
                if c not in single and best[done - 1] + unknown > best[done]:
                    best[done], count[done] = best[done - 1] + unknown, count[done - 1] + len(c.encode("utf-8", "surrogatepass"))
            end = last + 1
            got = best[end - length] + score
            if got > best[end]:
                best[end], count[end] = got, count[end - length] + 1
        while done < n:
            c = unit[done]
            done += 1
            if c not in single and best[done - 1] + unknown > best[done]:
                best[done], count[done] = best[done - 1] + unknown, count[done - 1] + len(c.encode("utf-8", "surrogatepass"))
        return count[n], best[n]

    def text(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        pieces, total = 0, 0.0
        for unit in self.unit.finditer(SPACE + text.replace(" ", SPACE)):
            n, score = self[unit[0]]
            pieces += n
            total += score
        return pieces, total


def piece_counts(text: Column, pieces: list[tuple[str, float]]) -> Column:
    """(n_tokens long, score double) of a text column. ``pieces`` is a tokenizer's vocabulary, of fixed size."""
    sent = SparkSession.active().sparkContext.broadcast(pieces)

    @F.pandas_udf("n_tokens long, score double")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = Counter(sent.value)
        for s in batches:
            yield pd.DataFrame([counter.text(t) for t in s], columns=["n_tokens", "score"])

    return count(text)

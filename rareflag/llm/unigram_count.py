"""Token counts of a unigram tokenizer, without building the tokens.

An Aho-Corasick automaton over the vocabulary enumerates the pieces that end at each
character; dynamic programming keeps, for each position, the best score and the number
of pieces on the best path, nothing else. Tie rules of the tokenizer: starts are tried
from left to right and only a strictly better score replaces a path, so of equal paths
into a position the one whose last piece is longest stays. A character that no piece of
one character covers costs ``min score - 10`` as an unknown and counts as its UTF-8
bytes (byte fallback).

Two counters, by the vocabulary's scores:

* whole numbers (``Counter``): sums are exact. Where no piece has a space mark after another
  character or a line feed, the text falls apart exactly before each run of marks and around line
  feeds, and equal parts are counted once per cache (parts of over ``LONG`` characters are not kept).
* real log-probabilities (``FloatCounter``): the tokenizer keeps each path's score as a 32-bit float,
  so its ties depend on all that went before. The whole text is one chain with the tokenizer's own
  order of additions and roundings; memory is a few numbers a character.

Without byte pieces in the vocabulary a run of unknown characters is one piece.
User-defined pieces are not told apart from normal ones.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE = 600_000
LONG = 64


def vocabulary(model_file: str) -> dict[str, float]:
    """Normal pieces of a sentencepiece file with their scores."""
    return _pieces(sentencepiece.SentencePieceProcessor(model_file=model_file))


def _pieces(sp: sentencepiece.SentencePieceProcessor) -> dict[str, float]:
    return {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))}


class Counter(dict):
    """part -> pieces - score * 2**SHIFT as one whole number, filled on demand; such numbers add up."""

    SHIFT = 32

    def __init__(self, vocab: dict[str, float], cache: int = CACHE):
        super().__init__()
        if not all(float(s).is_integer() and s <= 0 for s in vocab.values()):
            raise ValueError("piece scores must be whole numbers, none above 0")
        self.auto = ahocorasick.Automaton()
        for piece, score in vocab.items():
            self.auto.add_word(piece, (len(piece), int(score)))
        self.auto.make_automaton()
        self.single = {p for p in vocab if len(p) == 1}
        self.unknown = int(min(vocab.values()) - UNKNOWN_PENALTY)
        self.limit = cache
        crossing = any(MARK in p.lstrip(MARK) or "\n" in p for p in vocab)
        self.parts = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if not crossing else "(?s).+").findall

    def count(self, part: str) -> tuple[int, int]:
        """(best score, pieces) of one part."""
        n = len(part)
        best, pieces = [None] * (n + 1), [0] * (n + 1)
        best[0] = 0
        odd = [] if self.single.issuperset(part) else [i for i, c in enumerate(part, 1) if c not in self.single]
        odd.append(n + 1)
        at = 0

        def unknown(end: int) -> None:
            """An unknown character is the last candidate of its end."""
            score = best[end - 1] + self.unknown
            if best[end] is None or score > best[end]:
                best[end], pieces[end] = score, pieces[end - 1] + len(part[end - 1].encode("utf-8"))

        for last, (size, score) in self.auto.iter(part):  # longest first at each end
            end = last + 1
            while odd[at] < end:
                unknown(odd[at])
                at += 1
            score += best[end - size]
            if best[end] is None or score > best[end]:
                best[end], pieces[end] = score, pieces[end - size] + 1
        while odd[at] <= n:
            unknown(odd[at])
            at += 1
        return best[n], pieces[n]

    def __missing__(self, part: str) -> int:
        score, pieces = self.count(part)
        out = pieces + (-score << self.SHIFT)
        if len(part) <= LONG:
            if len(self) >= self.limit:
                self.clear()
            self[part] = out
        return out

    def text(self, text: str) -> tuple[int, int]:
        """(best score, pieces) of a text with its leading space mark."""
        if not text:
            return 0, 0
        both = sum(map(self.__getitem__, self.parts(MARK + text.replace(" ", MARK))))
        return -(both >> self.SHIFT), both & ((1 << self.SHIFT) - 1)


class FloatCounter:
    """Counts with real piece scores: a candidate's score is rounded to 32 bits before it is compared."""

    def __init__(self, vocab: dict[str, float], byte_fallback: bool = True):
        self.auto = ahocorasick.Automaton()
        for piece, score in vocab.items():  # (already 32-bit numbers)
            self.auto.add_word(piece, (len(piece), score))
        self.auto.make_automaton()
        self.single = {p for p in vocab if len(p) == 1}
        self.unknown = array("f", [min(vocab.values()) - UNKNOWN_PENALTY])[0]
        self.bytes = byte_fallback

    def text(self, text: str) -> tuple[float, int]:
        """(best score, pieces) of a text with its leading space mark."""
        if not text:
            return 0.0, 0
        s = MARK + text.replace(" ", MARK)
        n = len(s)
        best, pieces = array("f", bytes(4 * (n + 1))), array("q", [-1]) * (n + 1)  # pieces -1: not reached
        pieces[0] = 0
        run = bytearray(n + 1)  # 1: the best path ends in an unknown character
        single, one, unk = self.single, array("f", [0.0]), self.unknown
        done = 0  # ends up to here have all their candidates

        def finish(end: int) -> None:
            """The unknown character is the last candidate of its end."""
            for e in range(done + 1, end + 1):
                c = s[e - 1]
                if c in single:
                    continue
                one[0] = best[e - 1] + unk
                if pieces[e] < 0 or one[0] > best[e]:
                    best[e], run[e] = one[0], 1
                    more = len(c.encode("utf-8")) if self.bytes else 1 - run[e - 1]
                    pieces[e] = pieces[e - 1] + more

        for last, (size, score) in self.auto.iter(s):  # longest first at each end
            if last > done:
                finish(last)
                done = last
            end = last + 1
            one[0] = best[end - size] + score
            if pieces[end] < 0 or one[0] > best[end]:
                best[end], pieces[end], run[end] = one[0], pieces[end - size] + 1, 0
        finish(n)
        return best[n], pieces[n]


def counter(model_file: str) -> "Counter | FloatCounter":
    """The counter that a model's scores need."""
    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    vocab = _pieces(sp)
    by_bytes = any(sp.is_byte(i) for i in range(sp.get_piece_size()))
    if by_bytes and all(float(v).is_integer() and v <= 0 for v in vocab.values()):
        return Counter(vocab)
    return FloatCounter(vocab, by_bytes)


def token_counts(docs: DataFrame, model_file: str, text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, score (of the best segmentation).

    A null or empty text has no token and score 0. Repeated rows are counted alike; an empty
    table gives an empty result; other columns are not carried.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_file)
        for b in batches:
            out = [count.text(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([o[1] for o in out], pa.int64()), pa.array([float(o[0]) for o in out], pa.float64())],
                names=["doc_id", "n_tokens", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id bigint, n_tokens bigint, score double")

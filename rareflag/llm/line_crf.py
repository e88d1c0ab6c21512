"""Line labels by a linear-chain conditional random field, and quality rules on them.

Every line with a word is content or boilerplate. A line is described by a few binned
facts (``FACTS``): shares of symbols, capitals, digits and bars, words, repetition
inside the line and of earlier lines, and how it ends. The field has a weight for each
fact's bin and label and one for each pair of neighbouring labels; it is trained by
maximum likelihood on a bounded sample of texts graded good or bad, whose lines take
the text's grade as a weak label. Viterbi decoding marks the lines of every text, and
the share of the words' characters in content lines decides whether it is kept.

All counts and facts come from numpy passes over the bytes of whole texts; the
decoder walks the lines of all texts of a chunk side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rareflag.llm import textbytes as tb

#: bound on the graded texts for training (about as many of either grade), taken by hash of the id
TRAIN_TEXTS = 2000
#: longer texts train as several sequences of at most so many lines
TRAIN_LINES = 100
KEEP_SHARE = 0.5
MIN_WORDS, MAX_REPEAT = 10, 20
REPEAT_WINDOW = 5

BINS = 8
FACTS = ("symbols", "capitals", "digits", "bars", "words", "repeats", "long words", "seen", "ending")
SYMBOLS = b"#*$%&|<>"

_a = np.arange(256)
_SYM = np.isin(_a, list(SYMBOLS))
_UP = (_a >= 0x41) & (_a <= 0x5A)
_DIGIT = (_a >= 0x30) & (_a <= 0x39)
_EDGES = np.array([0.0, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7])


class Lines(NamedTuple):
    counts: dict[str, np.ndarray]  # for each text
    facts: np.ndarray  # (lines, FACTS) bins
    size: np.ndarray  # characters in words of each line
    bounds: np.ndarray  # text i has lines bounds[i]:bounds[i+1]


class Field(NamedTuple):
    emit: np.ndarray  # (FACTS, BINS, 2); label 1 is content
    move: np.ndarray  # (2, 2)


def _per(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    c = np.concatenate(([0], np.cumsum(flags)))
    return c[end] - c[start]


def _in_equal(key: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Whether the key occurs twice or more in its group."""
    both = tb.mix(key + tb.U64(0x9E3779B97F4A7C15) * group.astype(tb.U64))
    order = np.sort(both)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(twice, both), len(twice) - 1)
    return twice[at] == both


def _seen_before(key: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Whether an equal key stands earlier in the same group."""
    out = _in_equal(key, group)
    at = np.flatnonzero(out)
    order = at[np.lexsort((key[at], group[at]))]  # stable: the first of equals comes first
    if len(order):
        k, g = key[order], group[order]
        out[order[0]] = False
        out[order[1:]] = (k[1:] == k[:-1]) & (g[1:] == g[:-1])
    return out


def analyse(t: tb.Texts) -> Lines:
    """Base counts of each text and facts of each line that has a word."""
    n_texts = len(t.offsets) - 1
    start, end, bounds, data, mask = tb.word_spans(t, tb.NOT_SPACE)
    whash = tb.span_hashes(data, start, end, mask)
    letters = mask & ((data & 0xC0) != 0x80)
    chars = _per(letters, start, end)
    text_of = np.repeat(np.arange(n_texts), np.diff(bounds))

    # words in windows found twice or more
    grams = tb.gram_hashes(whash, REPEAT_WINDOW)
    at = np.flatnonzero(tb.per_text(bounds, REPEAT_WINDOW, len(grams)))
    twice = at[_in_equal(grams[at], text_of[at])] if len(at) else at
    edge = np.zeros(len(start) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + REPEAT_WINDOW, -1)
    repeated = np.cumsum(edge[:-1]) > 0

    # lines: cut at line feeds and between texts
    cut = np.flatnonzero(data == 0x0A)
    l_start = np.union1d(t.offsets[:-1], cut + 1)
    l_start = l_start[l_start < len(data)]
    l_end = np.append(l_start[1:], len(data))[:len(l_start)]  # no line in a chunk of empty texts
    l_end = np.where(data[l_end - 1] == 0x0A, l_end - 1, l_end) if len(l_end) else l_end
    w_lo, w_hi = np.searchsorted(start, l_start), np.searchsorted(start, l_end)
    some = w_hi > w_lo
    l_start, l_end, w_lo, w_hi = l_start[some], l_end[some], w_lo[some], w_hi[some]
    owner = np.searchsorted(t.offsets, l_start, "right") - 1
    lhash = tb.span_hashes(data, l_start, l_end)
    seen = _seen_before(lhash, owner)

    words = w_hi - w_lo
    size = _per(chars, w_lo, w_hi) if len(words) else np.zeros(0, np.int64)
    whole = np.maximum(size, 1)

    def share(flags: np.ndarray) -> np.ndarray:
        return np.digitize(_per(flags, l_start, l_end) / whole, _EDGES, right=True)

    line_of = np.repeat(np.arange(len(words)), words)
    first, last = start[w_lo] if len(w_lo) else w_lo, end[w_hi - 1] - 1 if len(w_hi) else w_hi
    back = data[last]
    facts = np.stack([
        share(_SYM[data]), share(_UP[data]), share(_DIGIT[data]), share(data == 0x7C),
        np.minimum(np.log2(words + 1).astype(np.int64), BINS - 1) if len(words) else words,
        np.digitize(_per(_seen_before(whash, line_of), w_lo, w_hi) / np.maximum(words, 1), _EDGES, right=True),
        np.minimum(whole // np.maximum(words, 1) // 3, BINS - 1),
        seen.astype(np.int64),
        np.where(back == 0x2E, 1, 0) + 2 * np.isin(back, list(b"!?")) + 4 * _UP[data[first]],
    ], axis=1) if len(words) else np.zeros((0, len(FACTS)), np.int64)
    counts = {
        "n_words": np.diff(bounds),
        "word_chars": _per(letters, t.offsets[:-1], t.offsets[1:]),
        "n_symbols": _per(_SYM[data], t.offsets[:-1], t.offsets[1:]),
        "n_dup_lines": np.bincount(owner[seen], minlength=n_texts),
        "n_repeat_words": _per(repeated, bounds[:-1], bounds[1:]),
    }
    return Lines(counts, facts, size, np.searchsorted(owner, np.arange(n_texts + 1)))


def emissions(field: Field, facts: np.ndarray) -> np.ndarray:
    out = np.zeros((len(facts), 2))
    for f in range(len(FACTS)):
        out += field.emit[f, facts[:, f]]
    return out


def viterbi(emit: np.ndarray, bounds: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best label of each line, all texts side by side; equal paths prefer boilerplate (label 0)."""
    n = np.diff(bounds)
    order = np.argsort(-n, kind="stable")
    most = int(n.max()) if len(n) else 0
    live = np.searchsorted(-n[order], -np.arange(1, most + 1), "right")  # texts with a line at each step
    score = np.zeros((len(n), 2))
    back = np.zeros((len(emit), 2), np.int8)
    for step in range(most):
        own = order[:live[step]]
        at = bounds[own] + step
        if step:
            ways = score[own][:, :, None] + move[None]
            back[at] = ways.argmax(axis=1)
            score[own] = ways.max(axis=1)
        score[own] += emit[at]
    label = np.zeros(len(emit), np.int8)
    cur = score.argmax(axis=1)
    for step in range(most - 1, -1, -1):
        own = order[:live[step]]
        at = bounds[own] + step
        now = cur[own]
        label[at] = now
        cur[own] = back[at, now]
    return label


def train(seqs: list[tuple[np.ndarray, int]], steps: int = 100, rate: float = 0.3, l2: float = 1e-3) -> Field:
    """Maximum conditional likelihood by forward-backward and Adam over padded sequences.

    seqs: (facts, label) of each text; balanced so that either label counts alike, and each text of a label.
    A text of more than ``TRAIN_LINES`` lines is cut into sequences, which together weigh as one text."""
    seqs = [s for s in seqs if len(s[0])]
    if not seqs or len({y for _, y in seqs}) < 2:
        # nothing to tell apart: all content
        emit = np.zeros((len(FACTS), BINS, 2))
        emit[..., 1] = 1
        return Field(emit, np.zeros((2, 2)))
    texts = np.bincount([y for _, y in seqs], minlength=2)
    weight = np.array([0.5 / texts[y] / len(x) for x, y in seqs for _ in range(0, len(x), TRAIN_LINES)])
    seqs = [(x[i:i + TRAIN_LINES], y) for x, y in seqs for i in range(0, len(x), TRAIN_LINES)]
    long, n = max(len(x) for x, _ in seqs), len(seqs)
    facts = np.zeros((n, long, len(FACTS)), np.int64)
    length = np.array([len(x) for x, _ in seqs])
    gold = np.array([y for _, y in seqs])
    for i, (x, _) in enumerate(seqs):
        facts[i, :len(x)] = x
    used = np.arange(long) < length[:, None]
    emit, move = np.zeros((len(FACTS), BINS, 2)), np.zeros((2, 2))
    flat = facts + np.arange(len(FACTS)) * BINS
    m, v = np.zeros(emit.size + 4), np.zeros(emit.size + 4)
    for it in range(1, steps + 1):
        e = emit.reshape(-1, 2)[flat].sum(axis=2)  # (n, long, 2)
        fwd, bwd = np.zeros_like(e), np.zeros_like(e)
        fwd[:, 0] = e[:, 0]
        for s in range(1, long):
            new = np.logaddexp.reduce(fwd[:, s - 1, :, None] + move, axis=1) + e[:, s]
            fwd[:, s] = np.where(used[:, s, None], new, fwd[:, s - 1])
        logz = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        for s in range(long - 2, -1, -1):
            new = np.logaddexp.reduce(move[None] + (e[:, s + 1] + bwd[:, s + 1])[:, None, :], axis=2)
            bwd[:, s] = np.where(used[:, s + 1, None], new, 0)
        own = np.where(used[..., None], fwd, -np.inf)
        prob = np.exp(own + bwd - logz[:, None, None]) * used[..., None]
        truth = np.stack([gold == 0, gold == 1], axis=1)[:, None, :] * used[..., None]
        diff = (truth - prob) * weight[:, None, None]
        g_emit = np.zeros((len(FACTS) * BINS, 2))
        for y in (0, 1):
            g_emit[:, y] = np.bincount(flat.ravel(), np.repeat(diff[..., y].ravel(), len(FACTS)), len(FACTS) * BINS)
        g_move = np.zeros((2, 2))
        pair_used = used[:, 1:] * weight[:, None]
        for x in (0, 1):
            for y in (0, 1):
                p = np.exp(np.where(used[:, 1:], fwd[:, :-1, x] + move[x, y] + e[:, 1:, y] + bwd[:, 1:, y]
                                    - logz[:, None], -np.inf))
                g_move[x, y] = (((gold == x) & (x == y))[:, None] * pair_used - p * weight[:, None]).sum()
        g = np.concatenate((g_emit.ravel(), g_move.ravel())) - l2 * np.concatenate((emit.ravel(), move.ravel()))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9 ** it)) / (np.sqrt(v / (1 - 0.999 ** it)) + 1e-9)
        emit += step[:-4].reshape(emit.shape)
        move += step[-4:].reshape(2, 2)
    return Field(emit, move)


def fit(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_TEXTS) -> Field:
    """Train on at most about ``limit`` graded texts; the sample is drawn by hash of the id."""
    graded = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).groupBy(
        "doc_id").agg(F.min("quality").alias("quality"))
    sizes = {r["quality"]: r["count"] for r in graded.groupBy("quality").count().collect() if r["quality"] in (0, 1)}
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)
    keep = F.lit(False)
    for q, n in sizes.items():
        keep = keep | ((F.col("quality") == q) & (share < limit / 2 / max(n, 1)))
    pick = graded.where(keep)
    schema = pa.schema([("quality", pa.int32()), ("facts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grade = b.column(0).to_pylist()
            for i, j, t in tb.chunks(tb.texts(b.column(1))):
                x = analyse(t)
                lines = [x.facts[p:q].astype(np.int8).tobytes()
                         for p, q in zip(x.bounds[:-1], x.bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(grade[i:j], pa.int32()), pa.array(lines, pa.binary())],
                                                 schema=schema)

    # the sample's size is bounded by ``limit``, up to the luck of the hash
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(pick), "doc_id")
            .select("quality", "text").mapInArrow(run, "quality int, facts binary").collect())
    rows.sort(key=lambda r: (r["quality"], bytes(r["facts"])))  # the order of arrival must not matter
    return train([(np.frombuffer(bytes(r["facts"]), np.int8).reshape(-1, len(FACTS)).astype(np.int64), r["quality"])
                  for r in rows])


def quality(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """Counts, line labels and verdict of every row.

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines,
    n_content_lines, content_share, kept. A null, empty or wordless text has no words and no
    line, fails the base rules and is not kept. Texts of any length are read whole. Repeated
    rows get equal answers; an empty table an empty result.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, t in tb.chunks(tb.texts(b.column(1))):
                x = analyse(t)
                label = viterbi(emissions(field, x.facts), x.bounds, field.move)
                content = _per(x.size * label, x.bounds[:-1], x.bounds[1:])
                size = _per(x.size, x.bounds[:-1], x.bounds[1:])
                share = content / np.maximum(size, 1)
                c = x.counts
                failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT * c["n_words"])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), *(pa.array(c[k].astype(np.int64)) for k in names),
                     pa.array(failed), pa.array(np.diff(x.bounds).astype(np.int64)),
                     pa.array(_per(label, x.bounds[:-1], x.bounds[1:]).astype(np.int64)), pa.array(share),
                     pa.array(~failed & (share >= KEEP_SHARE))],
                    names=["doc_id", *names, "base_failed", "n_lines", "n_content_lines", "content_share", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id bigint, " + ", ".join(f"{k} bigint" for k in names) +
        ", base_failed boolean, n_lines bigint, n_content_lines bigint, content_share double, kept boolean")

"""Quality grades by ordinal cumulative-link regression on hashed text.

Grades are ordered: 0 bad, 1 good but toxic, 2 good and clean. One weight vector over
hashed features gives a text's position s; ordered thresholds t_1 < t_2 cut the line:
P(grade >= j) = logistic(s - t_j). The expected grade is the sum of these tail
probabilities, and the last one selects.

Features (each present or not, hashed): the words, their first 4 and 6
bytes, and binned shares of symbols, capitals, bars, repeated words and word length.
Words count by presence, so one telling word weighs the same in a long text. The hash
space is wide (``SLOT_BITS``) and the weights sparse: only features whose share differs
between grades beyond chance (``SCREEN`` standard errors) enter the regression, and no
weight is above 0: a feature is evidence against a text or none. So a short or unusual
text without such evidence has the best grade; it need not earn it.

The model is fitted on a bounded sample of rated texts (``TRAIN_TEXTS``, drawn by hash
of the id, each grade with the same bound); scoring reads every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rareflag.llm import textbytes as tb

SLOT_BITS = 26
SCREEN = 6.0
#: bound on rated texts in the fit
TRAIN_TEXTS = 6000
PREFIXES = (4, 6)
#: probability of the best grade from which a text is selected
KEEP = 0.5
#: bytes of text (one text at least) whose features are in memory at a time
CHUNK = 1 << 19

_a = np.arange(256)
_SYM = np.isin(_a, list(b"#*$%&|<>!"))
_UP = (_a >= 0x41) & (_a <= 0x5A)
_BAR = _a == 0x7C
_EDGES = np.array([0.0, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7])
_UP_EDGES = np.array([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7])  # short texts have a capital in every few letters


class Model(NamedTuple):
    slots: np.ndarray  # ascending
    weights: np.ndarray  # of the slots
    cuts: np.ndarray  # ascending, one fewer than grades


def features(t: tb.Texts) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of every feature, repeats included."""
    n = len(t.offsets) - 1
    start, end, bounds, data, mask = tb.word_spans(t, tb.ALNUM, tb.LOWER)
    own = np.repeat(np.arange(n, dtype=np.int64), np.diff(bounds))
    whole = tb.span_hashes(data, start, end, mask)
    prefix = [tb.mix(tb.span_hashes(data, start, np.minimum(end, start + k)) + tb.U64(k)) for k in PREFIXES]

    size = np.maximum(np.diff(t.offsets), 1)
    words = np.maximum(np.diff(bounds), 1)

    def share(flag: np.ndarray, edges: np.ndarray = _EDGES) -> np.ndarray:
        c = np.concatenate(([0], np.cumsum(flag[t.data])))
        return np.digitize((c[t.offsets[1:]] - c[t.offsets[:-1]]) / size, edges, right=True)

    # words equal to another word of the text
    both = tb.mix(whole + own.astype(tb.U64) * tb.U64(0x9E3779B97F4A7C15))
    order = np.sort(both)
    fresh = np.concatenate((order[:1], order[1:][order[1:] != order[:-1]]))
    # one entry a distinct (text, word): its text is that of the first equal word
    first = np.argsort(both, kind="stable")[np.searchsorted(order, fresh)]
    kinds = np.bincount(own[first], minlength=n) / words
    facts = [share(_SYM), share(_UP, _UP_EDGES), share(_BAR), np.where(words > 8, np.minimum(kinds * 20, 20), 20).astype(np.int64),
             np.minimum(np.bincount(own, weights=end - start, minlength=n) / words // 2, 9).astype(np.int64)]
    shape = np.concatenate([tb.mix((np.int64(f + 1) * 64 + v + 7).astype(tb.U64)) for f, v in enumerate(facts)])
    slot = (np.concatenate((whole, *prefix, shape)) >> tb.U64(64 - SLOT_BITS)).astype(np.int64)
    text = np.concatenate((own, *[own] * len(PREFIXES), np.tile(np.arange(n, dtype=np.int64), len(facts))))
    return text, slot


def distinct(text: np.ndarray, slot: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct slots of each of n texts, bounds)."""
    both = np.unique((text << SLOT_BITS) | slot)
    return both & ((1 << SLOT_BITS) - 1), np.searchsorted(both >> SLOT_BITS, np.arange(n + 1))


def positions(index: np.ndarray, bounds: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weights of each text's features: their sum over the root of their number, a dot product with the
    text's unit vector, so that many words of one kind do not carry a text past the next threshold."""
    c = np.concatenate(([0.0], np.cumsum(weights[index], dtype=np.float64)))
    return (c[bounds[1:]] - c[bounds[:-1]]) / np.sqrt(np.maximum(np.diff(bounds), 1))


def known(text: np.ndarray, slot: np.ndarray, n: int, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices into ``slots`` of each text's distinct features that are in it, bounds)."""
    if not len(slots):
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    at = np.minimum(np.searchsorted(slots, slot), len(slots) - 1)
    hit = slots[at] == slot
    return distinct(text[hit], at[hit], n)


def tails(s: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """(texts, cuts): P(grade >= 1), P(grade >= 2), ..."""
    return 1 / (1 + np.exp(-np.clip(s[:, None] - cuts, -30, 30)))


def fit_rows(slot: np.ndarray, bounds: np.ndarray, grade: np.ndarray, grades: int, sizes: np.ndarray, l1: float = 0.01,
             l2: float = 1e-4, steps: int = 250) -> Model:
    """Maximum likelihood of the cumulative logit; grades weigh as the root of ``sizes``, their rows
    among all rated texts: a compromise between equal grades and the rows' own shares.

    First with an L1 penalty, which picks the features; then without it, on the picked ones. Thresholds are a first cut and positive gaps (logarithms are fitted), so they stay
    ordered; they and the weights share the steps. The penalty is ``l1`` over the root of the rarest grade's
    rows (0.02 at most), as chance differences between grades are."""
    n = len(grade)
    have = np.bincount(grade, minlength=grades)
    if n == 0 or np.count_nonzero(have) < 2:
        # nothing to tell apart: every text at the top
        return Model(np.zeros(0, np.int64), np.zeros(0), -np.arange(30, 30 - grades + 1, -1, dtype=float))
    lens = np.diff(bounds)
    slots, index = np.unique(slot, return_inverse=True)
    of = np.repeat(grade, lens)
    share = np.stack([np.bincount(index[of == g], minlength=len(slots)) for g in range(grades)])
    total = share.sum(axis=0)
    telling = np.zeros(len(slots), bool)
    for g in np.flatnonzero((have > 0) & (have < n)):
        p, rest, mean = share[g] / have[g], (total - share[g]) / (n - have[g]), total / n
        error = np.sqrt(np.maximum(mean * (1 - mean), 1 / n) * (1 / have[g] + 1 / (n - have[g])))
        telling |= np.abs(p - rest) > SCREEN * error
    slots, keep = slots[telling], telling[index]
    index = np.cumsum(telling)[index[keep]] - 1
    bounds = np.concatenate(([0], np.cumsum(keep)))[bounds]
    size = len(slots)
    mass = np.sqrt(sizes) * (have > 0)
    each = (mass / mass.sum() / np.maximum(have, 1))[grade]
    lens = np.diff(bounds)
    rows = np.arange(n)

    def slopes(w: np.ndarray, free: np.ndarray, index: np.ndarray, bounds: np.ndarray) -> tuple:
        """Gradient of the weighted log likelihood by weights and by free thresholds."""
        cuts = np.cumsum(np.concatenate((free[:1], np.exp(free[1:]))))
        p = np.concatenate((np.ones((n, 1)), tails(positions(index, bounds, w), cuts), np.zeros((n, 1))), axis=1)
        slope = p * (1 - p)
        mass = np.maximum(p[rows, grade] - p[rows, grade + 1], 1e-12)
        ds = (slope[rows, grade] - slope[rows, grade + 1]) / mass * each
        dc = np.zeros(grades + 1)
        np.add.at(dc, grade, -slope[rows, grade] / mass * each)
        np.add.at(dc, grade + 1, slope[rows, grade + 1] / mass * each)
        dc = dc[1:-1]
        dfree = np.concatenate(([dc.sum()], [dc[k:].sum() * np.exp(free[k]) for k in range(1, grades - 1)]))
        size = np.diff(bounds)
        return np.bincount(index, np.repeat(ds / np.sqrt(np.maximum(size, 1)), size), len(w)), dfree

    def climb(index: np.ndarray, bounds: np.ndarray, w: np.ndarray, free: np.ndarray, l1: float) -> tuple:
        """Projected Adam with a falling rate. As no weight is above 0, the L1 penalty is linear."""
        size = len(w)
        m, v = np.zeros(size + grades - 1), np.zeros(size + grades - 1)
        for it in range(1, steps + 1):
            gw, gfree = slopes(w, free, index, bounds)
            g = np.concatenate((gw + l1 - l2 * w, gfree))
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = 0.2 * (1 - it / (steps + 1)) * (m / (1 - 0.9 ** it)) / (np.sqrt(v / (1 - 0.999 ** it)) + 1e-8)
            w = np.minimum(w + step[:size], 0)
            free = free + step[size:]
        return w, free

    l1 = min(0.02, l1 / np.sqrt(have[have > 0].min()))
    w, free = climb(index, bounds, np.zeros(size), np.concatenate(([-2.0 * grades], np.ones(grades - 2))), l1)
    for left in (l1, 0.0):  # without the features that were not picked, unit vectors are others
        picked = w < -1e-3
        keep = picked[index]
        index, bounds = (np.cumsum(picked) - 1)[index[keep]], np.concatenate(([0], np.cumsum(keep)))[bounds]
        slots = slots[picked]
        w, free = climb(index, bounds, w[picked], free, left)
    return Model(slots, w, np.cumsum(np.concatenate((free[:1], np.exp(free[1:])))))


def grades_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 for quality 0, 1 for quality 1 and toxic, 2 for quality 1 and not toxic.

    Rows with a null in any of them are left out; of several for one id the lowest grade counts."""
    q, x = F.col("quality").cast("int"), F.col("toxic").cast("int")
    return (labels.select(F.col("doc_id").cast("long").alias("doc_id"),
                          F.when(q == 0, 0).when((q == 1) & x.isin(0, 1), 2 - x).alias("grade"))
            .where(F.col("doc_id").isNotNull() & F.col("grade").isNotNull()).groupBy("doc_id")
            .agg(F.min("grade").alias("grade")))


def sample(graded: DataFrame, limit: int = TRAIN_TEXTS, grades: int = 3) -> tuple[DataFrame, np.ndarray]:
    """About limit / grades rows of each grade, those of the lowest hashes of the id; all rows of each grade."""
    sizes = {r["grade"]: r["count"] for r in graded.groupBy("grade").count().collect()}  # one row a grade
    share = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) / (1 << 20)
    keep = F.lit(False)
    for g, n in sizes.items():
        keep = keep | ((F.col("grade") == g) & (share < limit / grades / max(n, 1)))
    return graded.where(keep), np.array([sizes.get(g, 0) for g in range(grades)], float)


def fit(docs: DataFrame, labels: DataFrame, grades: int = 3) -> Model:
    """Fit on the documents of a bounded sample of the rated ids."""
    picked, sizes = sample(grades_of(labels), grades=grades)
    schema = pa.schema([("grade", pa.int32()), ("slots", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grade = b.column(0).to_pylist()
            for i, j, t in tb.chunks(tb.texts(b.column(1))):
                slot, bounds = distinct(*features(t), j - i)
                rows = [slot[p:q].astype("<i4").tobytes() for p, q in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(grade[i:j], pa.int32()), pa.array(rows, pa.binary())],
                                                 schema=schema)

    # the sample's size is bounded by TRAIN_TEXTS, up to the luck of the hash: the documents need no shuffle
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
            .select("grade", "text").mapInArrow(run, "grade int, slots binary").collect())
    rows.sort(key=lambda r: (r["grade"], bytes(r["slots"])))  # the order of arrival must not matter
    each = [np.frombuffer(bytes(r["slots"]), "<i4").astype(np.int64) for r in rows]
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int64)
    slot = np.concatenate(each) if each else np.zeros(0, np.int64)
    return fit_rows(slot, bounds, np.array([r["grade"] for r in rows], np.int64), grades, sizes)


def grade(docs: DataFrame, model: Model, carry: list[str], text: str = "text") -> DataFrame:
    """The columns ``carry`` and position, expected_grade, tail_prob (of the best grade), kept of every row.

    A null, empty or wordless text has no words: grade 0, tail probability 0, not kept. Repeated rows get
    equal answers; an empty table an empty result; a model of fewer than two grades keeps every text with words.
    A carried column with the name of a result is an error.
    """
    tb.no_clash(carry, ("position", "expected_grade", "tail_prob", "kept"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # only the weights that pass the screen
    src = docs.select(*carry) if text in carry else docs.select(*carry, F.col(text).alias("_text"))
    at = carry.index(text) if text in carry else len(carry)
    out = docs.select(*carry).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for i, j, t in tb.chunks(tb.texts(b.column(at)), CHUNK):
                s = positions(*known(*features(t), j - i, model.slots), model.weights)
                p = tails(s, model.cuts)
                none = np.diff(tb.word_spans(t, tb.NOT_SPACE)[2]) == 0
                p[none], s[none] = 0, 0
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(i, j - i) for c in b.columns[:len(carry)]), pa.array(s), pa.array(p.sum(axis=1)),
                     pa.array(p[:, -1]), pa.array(p[:, -1] >= KEEP)],
                    names=[*carry, "position", "expected_grade", "tail_prob", "kept"])

    return src.mapInArrow(run, ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in out] +
        ["position double, expected_grade double, tail_prob double, kept boolean"]))


def quality_grade(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, position, expected_grade, tail_prob, kept of every row of ``docs``."""
    model = fit(docs, labels)
    return grade(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, ["doc_id"])

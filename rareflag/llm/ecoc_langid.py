"""Language identification by error-correcting output codes.

Each language gets a codeword of +1 / -1 bits. For each bit a binary n-gram
classifier separates the languages with +1 from those with -1: its weights are the
log ratios of the two sides' smoothed n-gram frequencies, its margin the weights'
mean over a text, scaled by the square root of the number of n-grams. Decoding
takes the codeword of least loss, each bit's logistic loss weighted by how reliable
the bit was on training texts; a small lead over the second best flags ambiguity.

N-grams are 2 to 4 bytes of the letters of a text (lower case, all else a space),
hashed into ``SLOTS`` counters. Learning counts n-grams of all training texts on the
executors; what reaches the driver is languages x SLOTS counts and, for the bits'
reliability, margins of at most ``CALIBRATION`` texts a language. Both depend on the
number of languages, not on the data.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rareflag.llm import textbytes as tb

SLOTS = 1 << 15
BLOCK = 1 << 12
#: bytes whose n-grams are in memory at a time
SLICE = 1 << 18
ORDERS = (2, 3, 4)
#: bound on the texts a language from which the bits' reliability is measured
CALIBRATION = 500
#: languages beyond this number raise; the model has languages x SLOTS counts
MAX_LANGUAGES = 1000
#: a lead in weighted loss below this share of the weights is ambiguous
AMBIGUOUS = 0.25
SMOOTH = 0.5
UNDETERMINED = "und"

_has_letter = regex.compile(r"\p{L}").search
_a = np.arange(256)
_LETTER = np.where((_a >= 0x41) & (_a <= 0x5A), _a + 32, np.where((_a >= 0x61) & (_a <= 0x7A) | (_a >= 0x80), _a, 0x20)
                   ).astype(np.uint8)
_MULT = {2: np.uint32(0x9E3779B1), 3: np.uint32(0x85EBCA77), 4: np.uint32(0xC2B2AE3D)}


class Model(NamedTuple):
    langs: list[str]
    code: np.ndarray  # languages x bits, +1 / -1
    weights: np.ndarray  # SLOTS x bits, float32
    trust: np.ndarray  # of each bit


def codewords(n: int) -> np.ndarray:
    """n codewords: all distinct splits for up to 7 languages, else random splits with the best least distance."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 7:
        cols = [(1, *x) for x in itertools.product((1, -1), repeat=n - 1) if -1 in x]
        return np.array(cols, np.int8).T
    rng = np.random.default_rng(n)
    bits = 10 * int(np.ceil(np.log2(n)))
    best, lead = None, -1
    for _ in range(50):
        code = rng.choice(np.array([1, -1], np.int8), (n, bits))
        split = np.abs(code.sum(axis=0)) < n
        near = min((np.count_nonzero(code[i] != code[i + 1:], axis=1).min() for i in range(n - 1)), default=0)
        if split.all() and near > lead:
            best, lead = code, near
    return best


def slots(t: tb.Texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(slot of each n-gram, its text), for the n-grams that start in each ``SLICE`` bytes in a row: the arrays
    for one slice are bounded, however long a text is."""
    n = len(t.data)
    for first in range(0, n, SLICE):
        lo, hi = max(first - 1, 0), min(first + SLICE + max(ORDERS) - 1, n)  # a byte before tells Latin-1 capitals
        raw = t.data[lo:hi]
        b = _LETTER[raw]
        lead = raw == 0xC3  # Latin-1 capitals: C3 80..9E but 97 are 20 below their small letters
        if lead.any():
            nxt = np.flatnonzero(lead[:-1]) + 1
            up = (raw[nxt] >= 0x80) & (raw[nxt] <= 0x9E) & (raw[nxt] != 0x97)
            b[nxt[up]] += 0x20
        b = b[first - lo:]
        owner = np.repeat(np.arange(len(t.offsets) - 1, dtype=np.int32), np.diff(np.clip(t.offsets, first, hi)))
        space = b == 0x20
        code = wide = b.astype(np.uint32)
        found, own = [], []
        for k in range(2, max(ORDERS) + 1):
            if len(b) < k:
                break
            code = (code[:len(b) - k + 1] << np.uint32(8)) | wide[k - 1:]
            if k in ORDERS:
                m = min(len(code), SLICE)
                # a gram starts with a letter or with the space before one
                ok = (owner[:m] == owner[k - 1:k - 1 + m]) & ~(space[:m] & space[1:m + 1])
                found.append((code[:m][ok] * _MULT[k]) >> np.uint32(32 - 15))
                own.append(owner[:m][ok])
        if found:
            yield np.concatenate(found), np.concatenate(own)


def is_letterless(text: str | None) -> bool:
    return text is None or _has_letter(text) is None


def margins(t: tb.Texts, weights: np.ndarray) -> np.ndarray:
    """(texts, bits): mean weight of the n-grams times the square root of their number."""
    n = len(t.offsets) - 1
    count, total = np.zeros(n), np.zeros((n, weights.shape[1]))
    for slot, own in slots(t):
        count += np.bincount(own, minlength=n)
        for k in range(weights.shape[1]):
            total[:, k] += np.bincount(own, weights=weights[slot, k], minlength=n)
    return total / np.sqrt(np.maximum(count, 1))[:, None]


def decode(m: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language index, score, ambiguous) of margins, by weighted logistic loss; ties take the first language."""
    loss = np.stack([(np.logaddexp(0, -m * c) * model.trust).sum(axis=1) for c in model.code], axis=1)
    part = np.exp(-(loss - loss.min(axis=1, keepdims=True)) / model.trust.mean())
    score = part.max(axis=1) / part.sum(axis=1)
    near = np.sort(loss, axis=1)
    lead = near[:, 1] - near[:, 0] if loss.shape[1] > 1 else np.full(len(m), np.inf)
    return loss.argmin(axis=1), score, lead < AMBIGUOUS * model.trust.sum()


def _counts(train: DataFrame) -> DataFrame:
    """(lang, block, counts): n-gram counts in blocks of BLOCK slots, two levels of sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            for i, j, t in tb.chunks(tb.texts(b.column(1))):
                for lang in set(langs[i:j]):
                    sums.setdefault(lang, np.zeros(SLOTS, np.int64))
                for slot, own in slots(t):
                    for lang in set(langs[i:j]):
                        sums[lang] += np.bincount(slot[(langs[i:j] == lang)[own]], minlength=SLOTS)
        part = TaskContext.get().partitionId() % 64  # spreads the first level of sums
        rows = [{"lang": k, "block": i // BLOCK, "part": int(part), "counts": v[i:i + BLOCK].tolist()}
                for k, v in sums.items() for i in range(0, SLOTS, BLOCK)]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(
            [("lang", pa.string()), ("block", pa.int32()), ("part", pa.int32()), ("counts", pa.list_(pa.int64()))]))

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf.iloc[:1].copy()
        out["counts"] = [np.sum(np.stack(pdf["counts"].to_list()), axis=0)]
        return out

    schema = "lang string, block int, part int, counts array<bigint>"
    part = train.mapInArrow(run, schema)
    return part.groupBy("lang", "block", "part").applyInPandas(add, schema).groupBy("lang", "block").applyInPandas(
        add, schema)


def fit(train: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learn from all rows with a text and a language; no row at all gives a model without languages."""
    rows = train.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"))
    sizes = rows.groupBy("lang").agg(F.count_if(F.length("text") > 0).alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:  # before any language's counts are gathered
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    blocks = _counts(rows).collect()  # languages x SLOTS numbers
    langs = sorted({r["lang"] for r in blocks})
    counts = np.zeros((len(langs), SLOTS))
    for r in blocks:
        counts[langs.index(r["lang"]), r["block"] * BLOCK:(r["block"] + 1) * BLOCK] = r["counts"]
    freq = (counts + SMOOTH) / (counts + SMOOTH).sum(axis=1, keepdims=True) if len(langs) else counts
    code = codewords(len(langs))
    cols = []
    for bit in code.T if len(langs) > 1 else []:
        cols.append(np.log(freq[bit > 0].mean(axis=0)) - np.log(freq[bit < 0].mean(axis=0)))
    weights = np.stack(cols, axis=1).astype(np.float32) if cols else np.zeros((SLOTS, 1), np.float32)
    trust = np.ones(weights.shape[1])
    if len(langs) > 1:
        # a bounded sample: the texts of the smallest hashes of each language
        pick = rows.select("lang", "text", F.xxhash64("text").alias("h")).where(F.length("text") > 0)
        edge = {r["lang"]: min(1.0, CALIBRATION * 0.5 / r["n"]) for r in sizes if r["n"]}
        share = F.pmod("h", F.lit(1 << 20)) / (1 << 20)
        keep = F.lit(False)
        for k, q in edge.items():
            keep = keep | ((F.col("lang") == k) & (share < q))
        model = Model(langs, code, weights, trust)

        def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = [langs.index(x) for x in b.column(0).to_pylist()]
                right = np.concatenate([margins(t, model.weights) for _, _, t in tb.chunks(tb.texts(b.column(1)))]) * \
                    model.code[own] > 0 if b.num_rows else np.zeros((0, code.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array([right.sum(axis=0).tolist()], pa.list_(pa.int64())),
                                                  pa.array([len(right)], pa.int64())], names=["ok", "n"])

        found = (pick.where(keep).select("lang", "text").mapInArrow(bits, "ok array<bigint>, n bigint")
                 .select("n", F.posexplode("ok").alias("bit", "ok")).groupBy("bit")
                 .agg(F.sum("ok").alias("ok"), F.sum("n").alias("n")).collect())
        for r in found:
            wrong = (r["n"] - r["ok"] + 1) / (r["n"] + 2)
            trust[r["bit"]] = max(0.0, np.log((1 - wrong) / wrong))
        if not trust.any():
            trust[:] = 1
    return Model(langs, code, weights, trust)


def identify(docs: DataFrame, model: Model, carry: list[str], text: str = "text") -> DataFrame:
    """The columns ``carry`` and lang_pred, score (0 to 1), ambiguous of every row.

    A null text, one without a letter, and any text under a model without languages is
    ``und`` with score 0, not ambiguous. Long texts are read whole. Ties take the language
    first in the alphabet. Repeated rows get equal answers; an empty table an empty result. A carried
    column with the name of an output is an error.
    """
    tb.no_clash(carry, ("lang_pred", "score", "ambiguous"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x SLOTS numbers at most
    src = docs.select(*carry) if text in carry else docs.select(*carry, F.col(text).alias("_text"))
    at = carry.index(text) if text in carry else len(carry)
    out = docs.select(*carry).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            col = b.column(at)
            for i, j, t in tb.chunks(tb.texts(col)):
                some = np.diff(t.offsets) > 0
                plain = np.zeros(j - i, bool)  # has an ASCII letter
                if some.any():
                    plain[some] = np.logical_or.reduceat((t.data | 0x20) - 0x61 < 26, t.offsets[:-1][some])
                if not model.langs:
                    k, s, v = np.zeros(j - i, int), np.zeros(j - i), np.zeros(j - i, bool)
                else:
                    k, s, v = decode(margins(t, model.weights), model)
                pred, score, vague = [], [], []
                for q in range(j - i):
                    none = not model.langs or (not plain[q] and is_letterless(col[i + q].as_py()))
                    pred.append(UNDETERMINED if none else model.langs[k[q]])
                    score.append(0.0 if none else float(s[q]))
                    vague.append(bool(v[q]) and not none)
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(i, j - i) for c in b.columns[:len(carry)]), pa.array(pred, pa.string()),
                     pa.array(score, pa.float64()), pa.array(vague, pa.bool_())],
                    names=[*carry, "lang_pred", "score", "ambiguous"])

    return src.mapInArrow(run, ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in out] + ["lang_pred string, score double, ambiguous boolean"]))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous; learned from the rows that aren't held out."""
    train = docs if train is None else train
    model = fit(train.where(~held_out()))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return identify(rows, model, ["doc_id", "held_out"])

"""Benchmark decontamination by winnowing.

Every text (train and test) is reduced to fingerprints: the minimum k-gram hash
of each window of ``w`` consecutive k-grams, the rightmost one on ties. With
``k + w - 1 = span`` any shared run of ``span`` words holds a fingerprint that
both sides keep, so joining fingerprints finds every such run. A hit is extended
to both sides over the words themselves (not their hashes) and counts if the
equal run reaches ``span`` words.

An item shorter than ``span`` words is one window as a whole; no winnowing can
guarantee it, so all grams of that length of a text are candidates.

Scale: the documents are read once. A bitmap of the test fingerprints, of
fixed size (``FILTER_BITS``, 8 MB) whatever the benchmark's size, goes to the
tasks; only grams that pass it leave the scan, with the words around them. The
join by hash is an ordinary shuffle join, exact for any benchmark size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rareflag.llm import textbytes as tb
from rareflag.llm.scratch import written

SPAN = 10
GRAM = 5
FILTER_BITS = 26
#: a hash is dealt over this many shuffle keys, so a passage in very many documents is no hot key
SALTS = 16

_CAND = "array<struct<kind:int,pos:int,h:bigint,left:int,ctx:string>>"


def fingerprints(w: tb.Words, span: int, gram: int) -> np.ndarray:
    """Positions of the winnowed grams of each text of at least ``span`` words."""
    win = span - gram + 1
    h = tb.gram_hashes(w.hash, gram)
    n = len(h) - win + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = h[:n].copy(), np.arange(n)
    for j in range(1, win):
        take = h[j:n + j] <= best
        best = np.where(take, h[j:n + j], best)
        at = np.where(take, np.arange(j, n + j), at)
    return np.unique(at[tb.per_text(w.bounds, span, n)])


def _bit(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> tb.U64(64 - bits)).astype(np.int64)


def _items(item: pa.Array, text: pa.Array, span: int, gram: int) -> list[dict]:
    rows = []
    w = tb.words(tb.texts(text), tb.ALNUM, tb.LOWER)
    for i, name in enumerate(item.to_pylist()):
        a, b = int(w.bounds[i]), int(w.bounds[i + 1])
        if a == b:
            continue
        own = tb.Words(w.start[a:b], w.end[a:b], w.hash[a:b], np.array([0, b - a]), w.data)
        n = b - a
        if n < span:
            at, kind, size = [0], n, n
        else:
            at, kind, size = fingerprints(own, span, gram).tolist(), 0, gram
        h = tb.gram_hashes(own.hash, size)
        for p in at:
            lo, hi = (0, n) if kind else (max(0, p - span + gram), min(n, p + span))
            rows.append({"item_id": name, "kind": kind, "h": int(h[p].astype(np.int64)), "left": p - lo,
                         "ctx": own.text(lo, hi)})
    return rows


def item_prints(items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(item_id, kind, h, left, ctx) of the benchmark's texts; kind 0 or the item's length."""
    schema = pa.schema([("item_id", pa.string()), ("kind", pa.int32()), ("h", pa.int64()), ("left", pa.int32()),
                        ("ctx", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = _items(b.column(0), b.column(1), span, gram)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return items.select(F.col("item_id").cast("string"), "text").mapInArrow(
        run, "item_id string, kind int, h bigint, left int, ctx string")


def _bitmap(prints: DataFrame, bits: int) -> bytes:
    """Bitmap of the hashes, gathered as at most 2**bits / 64 longs (8 MB at 26 bits)."""
    rows = (prints.select(F.shiftrightunsigned("h", 64 - bits).alias("slot"))
            .select(F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, cast(slot % 64 as int))").alias("bit"))
            .groupBy("word").agg(F.bit_or("bit").alias("bit")))
    table = rows.toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[table.column(0).to_numpy()] = table.column(1).to_numpy()
    return out.tobytes()


def scan(docs: DataFrame, text: str, bitmap: bytes, kinds: list[int], span: int = SPAN, gram: int = GRAM,
         bits: int = FILTER_BITS) -> DataFrame:
    """One row per document: rid, doc_id, hash of the text, n_words, candidates with their context."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(bitmap)
    kinds = sorted(kinds)
    item = pa.struct([("kind", pa.int32()), ("pos", pa.int32()), ("h", pa.int64()), ("left", pa.int32()),
                      ("ctx", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filt = np.frombuffer(shared.value, np.int64)

        def passes(h: np.ndarray) -> np.ndarray:
            slot = _bit(h, bits)
            return (filt[slot >> 6] >> (slot & 63)) & 1 == 1

        for b in batches:
            for i, j, t in tb.chunks(tb.texts(b.column(3))):
                w = tb.words(t, tb.ALNUM, tb.LOWER)
                found = [[] for _ in range(j - i)]
                for kind in kinds:
                    if kind:
                        h = tb.gram_hashes(w.hash, kind)
                        at = np.flatnonzero(tb.per_text(w.bounds, kind, len(h)) & passes(h)) if len(h) else []
                        size = kind
                    else:
                        at, h, size = fingerprints(w, span, gram), tb.gram_hashes(w.hash, gram), gram
                        at = at[passes(h[at])] if len(at) else at
                    of = np.searchsorted(w.bounds, at, "right") - 1
                    for p, d in zip(np.asarray(at).tolist(), of.tolist(), strict=True):
                        lo, hi = int(w.bounds[d]), int(w.bounds[d + 1])
                        a, z = (p, p + size) if kind else (max(lo, p - span + gram), min(hi, p + span))
                        found[d].append({"kind": kind, "pos": p - lo, "h": int(h[p].astype(np.int64)),
                                         "left": p - a, "ctx": w.text(a, z)})
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(i, j - i) for c in b.columns[:3]), pa.array(np.diff(w.bounds), pa.int64()),
                     pa.array(found, pa.list_(item))], names=["rid", "doc_id", "th", "n_words", "cand"])

    src = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"),
                      F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    return src.mapInArrow(run, f"rid bigint, doc_id bigint, th bigint, n_words bigint, cand {_CAND}")


def _extend(kind: int, gram: int, span: int, a: str, left: int, b: str, bleft: int) -> tuple[int, int] | None:
    """Words to the left and right of the gram's start that are equal, if the run counts."""
    x, y = a.split(" "), b.split(" ")
    if kind:
        return (0, kind) if x == y else None
    i = 0
    while i < min(left, bleft) and x[left - 1 - i] == y[bleft - 1 - i]:
        i += 1
    j, most = 0, min(len(x) - left, len(y) - bleft)
    while j < most and x[left + j] == y[bleft + j]:
        j += 1
    return (i, j) if j >= gram and i + j >= span else None


def hits(cand: DataFrame, prints: DataFrame, span: int = SPAN, gram: int = GRAM, salts: int = SALTS) -> DataFrame:
    """(rid, start, end, item_id): equal runs of at least ``span`` words, or whole short items."""
    left = cand.select("rid", F.explode("cand").alias("c")).select(
        "rid", "c.*", F.pmod(F.xxhash64("rid", "c.pos"), F.lit(salts)).alias("salt"))
    right = prints.select("item_id", "kind", "h", F.col("left").alias("ileft"), F.col("ctx").alias("ictx"),
                          F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    pairs = left.join(right, ["kind", "h", "salt"]).select("rid", "kind", "pos", "left", "ctx", "item_id", "ileft",
                                                           "ictx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid, kind, pos, lft, ctx, item, il, ic = (c.to_pylist() for c in b.columns)
            out = ([], [], [], [])
            for q in range(len(rid)):
                m = _extend(kind[q], gram, span, ctx[q], lft[q], ic[q], il[q])
                if m:
                    for o, v in zip(out, (rid[q], pos[q] - m[0], pos[q] + m[1], item[q]), strict=True):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()),
                                              pa.array(out[2], pa.int32()), pa.array(out[3], pa.string())],
                                             names=["rid", "start", "end", "item_id"])

    return pairs.mapInArrow(run, "rid bigint, start int, end int, item_id string")


def covered(ranges: Column) -> Column:
    """Number of positions in the union of an array of (start, end)."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    return F.aggregate(F.array_sort(ranges), zero, lambda s, r: F.struct(
        (s["n"] + F.greatest(F.lit(0), r["end"] - F.greatest(r["start"], s["upto"]))).alias("n"),
        F.greatest(s["upto"], r["end"]).alias("upto")))["n"]


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", span: int = SPAN,
                  gram: int = GRAM) -> DataFrame:
    """Overlap of every document row with the benchmark.

    Returns one row per input row: rid (a row number of this run), doc_id, th
    (xxhash64 of the text), n_words, n_hit (words inside any occurrence of a window), items (sorted ids), contaminated.
    A null or wordless text has zero words and no hit; a null doc_id is kept; rows
    that repeat a doc_id are judged one by one; an empty table gives an empty result.
    Items without words never occur; items that share an id count once.
    """
    prints = written(item_prints(items, span, gram), "item-prints")
    kinds = [r[0] for r in prints.select("kind").distinct().collect()]  # at most span values
    base = written(scan(docs, text, _bitmap(prints, FILTER_BITS), kinds, span, gram), "doc-grams")
    found = hits(base.select("rid", "cand").where(F.size("cand") > 0), prints, span, gram)
    # first per range and per item, then per row: copies of a range are combined before the last shuffle
    per = found.groupBy("rid").agg(F.collect_set(F.struct("start", "end")).alias("ranges"),
                                   F.array_sort(F.collect_set("item_id")).alias("items"))
    per = per.select("rid", covered(F.col("ranges")).alias("n_hit"), "items")
    empty = F.array().cast("array<string>")
    return (base.select("rid", "doc_id", "th", "n_words").join(per, "rid", "left")
            .select("rid", "doc_id", "th", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                    F.coalesce("items", empty).alias("items"))
            .withColumn("contaminated", F.col("n_hit") > 0))

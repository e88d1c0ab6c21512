"""Near-duplicate classes by MinHash bands verified with odd sketches.

A document is the set of its distinct word shingles. MinHash samples of the set
are cut into bands; two documents that agree in one band are candidates. The
samples are also folded into an odd sketch: a parity bitmap in which sample i
with value v toggles bit hash(i, v). The XOR of two sketches is the sketch of
the differing samples, so its population count estimates the similarity,
precisely where it is high. Candidates whose estimate lies below
``jaccard - MARGIN`` (more than five standard errors) are left out; the others
are confirmed on the full sets.

Large groups of copies are never expanded into all their pairs:

1. equal sets become one class, before any band is made;
2. in each class's buckets the class that shares most with its neighbours is the
   hub; every class is confirmed against its best hub only (one link each), and
   the linked classes form trees;
3. in each bucket, the classes outside its largest tree are held against that whole tree,
   block by block: one link joins them; this is done again with the trees so joined;
4. the classes of a bucket that are still outside its largest tree are held against each
   other, block by block too: only links leave a block, never candidate pairs.

So no candidate link between different components is lost. At jaccard 0.8 a pair
is missed by all bands with probability (1 - 0.8**6)**42 = 2.9e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rareflag.llm import textbytes as tb
from rareflag.llm.scratch import written

BANDS, ROWS = 42, 6
SKETCH_LONGS = 16
MARGIN = 0.2
#: members of a tree, and askers, in one group of ``ask``
BLOCK = 512

_rng = np.random.default_rng(20240611)
_A = (_rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)


def shingle_sets(t: tb.Texts, size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; a text of fewer words is one shingle."""
    w = tb.words(t, tb.NOT_SPACE, tb.LOWER)
    grams = tb.gram_hashes(w.hash, size)
    out = []
    for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a:b - size + 1]))
        elif b > a:
            out.append(tb.gram_hashes(w.hash[a:b], b - a))
        else:
            out.append(np.zeros(0, tb.U64))
    return out


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """(samples, sets) matrix of 32-bit MinHash values of non-empty sets."""
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1])).astype(np.int64)
    x = (tb.mix(np.concatenate(sets)) >> tb.U64(32)).astype(np.uint32)
    out = np.empty((len(_A), len(sets)), np.uint32)
    buf = np.empty_like(x)
    for i in range(len(_A)):
        np.multiply(x, _A[i], out=buf)
        buf += _B[i]
        buf ^= buf >> np.uint32(15)
        out[i] = np.minimum.reduceat(buf, at)
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """(sets, bands) bucket ids; the band's number is part of the id."""
    cols = []
    for b in range(BANDS):
        rows = sig[b * ROWS:(b + 1) * ROWS].astype(tb.U64)
        h = np.full(sig.shape[1], b + 1, tb.U64)
        for r in rows:
            h = tb.mix(h * tb.U64(0x9E3779B97F4A7C15) + r)
        cols.append(h.view(np.int64))
    return np.stack(cols, axis=1)


def sketches(sig: np.ndarray) -> np.ndarray:
    """(sets, SKETCH_LONGS) parity bitmaps of the samples."""
    bits = SKETCH_LONGS * 64
    k, n = sig.shape
    key = tb.mix((np.arange(1, k + 1, dtype=tb.U64) << tb.U64(32))[:, None] + sig.astype(tb.U64))
    slot = (key % tb.U64(bits)).astype(np.int64) + np.arange(n) * bits
    odd = (np.bincount(slot.ravel(), minlength=n * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, bits), axis=1, bitorder="little").view(np.int64)


def max_flips(jaccard: float, margin: float = MARGIN) -> int:
    """Largest XOR population count that still counts as a candidate."""
    s, k = SKETCH_LONGS * 64, BANDS * ROWS
    differing = 2 * k * (1 - max(0.0, jaccard - margin))
    return int(s * (1 - (1 - 2 / s) ** differing) / 2) + 1


def _sketch_table(docs: DataFrame, text: str, size: int) -> DataFrame:
    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("n_shingles", pa.int64()),
                        ("d1", pa.int64()), ("d2", pa.int64()), ("bands", pa.list_(pa.int64())),
                        ("sketch", pa.list_(pa.int64()))])

    def lists(m: np.ndarray, full: np.ndarray) -> pa.Array:
        off = np.concatenate(([0], np.cumsum(full * m.shape[1]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(off), pa.array(m.ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, t in tb.chunks(tb.texts(b.column(3))):
                sets = shingle_sets(t, size)
                n = np.array([len(s) for s in sets], np.int64)
                full = (n > 0).astype(np.int64)
                some = [s for s in sets if len(s)]
                sig = minhashes(some) if some else np.zeros((len(_A), 0), np.uint32)
                d1 = np.array([int(tb.mix(s).sum(dtype=tb.U64).astype(np.int64)) for s in sets], np.int64)
                d2 = np.array([int(tb.mix(s ^ tb.U64(0x5851F42D4C957F2D)).sum(dtype=tb.U64).astype(np.int64))
                               for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), b.column(2).slice(i, j - i),
                     pa.array(n), pa.array(d1), pa.array(d2), lists(bands(sig), full), lists(sketches(sig), full)],
                    schema=schema)

    src = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"),
                      F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    return src.mapInArrow(run, "rid bigint, doc_id bigint, th bigint, n_shingles bigint, d1 bigint, d2 bigint, "
                               "bands array<bigint>, sketch array<bigint>")


def _similar(x: np.ndarray, y: np.ndarray, jaccard: float) -> bool:
    """Whether two full sets reach ``jaccard``."""
    num = round(jaccard * 100)
    if 100 * min(len(x), len(y)) < num * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= num * (len(x) + len(y) - both)


def confirm(pairs: DataFrame, full: DataFrame, size: int, jaccard: float) -> DataFrame:
    """(a, b) of the pairs whose sketches agree and whose full shingle sets reach ``jaccard``."""
    most = max_flips(jaccard)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            left, right = tb.texts(batch.column(2)), tb.texts(batch.column(3))
            flips = np.bitwise_count(_matrix(batch.column(4)) ^ _matrix(batch.column(5))).sum(axis=1)
            for i in np.flatnonzero(flips <= most).tolist():
                x, y = (shingle_sets(tb.Texts(t.data[t.offsets[i]:t.offsets[i + 1]],
                                              t.offsets[i:i + 2] - t.offsets[i]), size)[0] for t in (left, right))
                if _similar(x, y, jaccard):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    both = (pairs.join(full.select(F.col("cid").alias("a"), F.col("text").alias("ta"), F.col("sketch").alias("sa")), "a")
            .join(full.select(F.col("cid").alias("b"), F.col("text").alias("tb"), F.col("sketch").alias("sb")), "b"))
    return both.select("a", "b", "ta", "tb", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def _matrix(column: pa.Array) -> np.ndarray:
    """(rows, SKETCH_LONGS) of a column of sketches."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    # unsigned: numpy counts the bits of the absolute value otherwise
    return column.flatten().to_numpy(zero_copy_only=False).view(tb.U64).reshape(-1, SKETCH_LONGS)


def ask(asks: DataFrame, members: DataFrame, full: DataFrame, size: int, jaccard: float,
        among: bool = False) -> DataFrame:
    """(a, b) links of the asks (a, own, top) into the members (top, cid, root): in each block of the members of
    ``top``, one link, if any, from a into each tree ``root`` other than its own. With ``among`` askers and
    members are the same, and of a pair the larger id asks.

    The members of a ``top`` and its askers are dealt into blocks of about BLOCK; each pair of blocks is one group,
    in which the sketches choose and order what is compared on the full sets. So an asker is held against a whole
    tree or bucket without a row for each pair, and a large one is spread over many groups."""
    most = max_flips(jaccard)
    asked = asks.groupBy("top").agg(F.count("*").alias("na"))
    held = members.groupBy("top").agg(F.count("*").alias("nm")).join(asked, "top")
    held = written(held.select("top", F.ceil(F.col("na") / BLOCK).cast("int").alias("na"),
                               F.ceil(F.col("nm") / BLOCK).cast("int").alias("nm")), "blocks")

    def block(col: str, n: str) -> Column:
        return F.pmod(F.xxhash64(col), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = asks.join(held, "top").select("top", "own", F.col("a").alias("cid"), block("a", "na").alias("i"), "nm").join(
        full, "cid").withColumn("j", every("nm")).select(
        "top", "i", "j", F.col("cid").alias("aid"), "own", F.col("text").alias("atext"),
        F.col("sketch").alias("asketch"))
    right = members.join(held, "top").select(
        "top", "cid", "root", block("cid", "nm").alias("j"), "na").join(full, "cid").withColumn("i", every("na")).select(
        "top", "i", "j", "cid", "root", "text", "sketch")

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        a, b = [], []
        if x.num_rows and y.num_rows:
            ids, others = x.column("aid").to_numpy(), y.column("cid").to_numpy()
            own, trees = x.column("own").to_numpy(), y.column("root").to_numpy()
            sx, sy = _matrix(x.column("asketch")), _matrix(y.column("sketch"))
            tx, ty = tb.texts(x.column("atext")), tb.texts(y.column("text"))
            sets: dict[int, np.ndarray] = {}

            def one(t: tb.Texts, i: int) -> np.ndarray:
                return shingle_sets(tb.Texts(t.data[t.offsets[i]:t.offsets[i + 1]],
                                             t.offsets[i:i + 2] - t.offsets[i]), size)[0]

            for i in range(len(ids)):
                flips = np.bitwise_count(sx[i] ^ sy).sum(axis=1)
                near = np.flatnonzero((flips <= most) & (trees != own[i]) & ((others < ids[i]) | (not among)))
                mine = one(tx, i) if len(near) else None
                linked: set[int] = set()
                for j in near[np.argsort(flips[near], kind="stable")].tolist():
                    if trees[j] in linked:
                        continue
                    if j not in sets:
                        sets[j] = one(ty, j)
                    if _similar(mine, sets[j], jaccard):
                        a.append(int(ids[i]))
                        b.append(int(others[j]))
                        linked.add(trees[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    keys = ["top", "i", "j"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "a bigint, b bigint")


def roots(parents: DataFrame) -> DataFrame:
    """(node, root) of a forest given as (node, parent), by pointer jumping."""
    cur = written(parents.select("node", F.col("parent").alias("root")), "roots")
    while True:
        up = cur.select(F.col("node").alias("root"), F.col("root").alias("above"))
        nxt = written(cur.join(up, "root", "left").select(
            "node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
        cur = nxt.select("node", "root")
        if nxt.where("moved").isEmpty():
            return cur


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): smallest node of each connected component, by alternating large-star and
    small-star rounds (a number of rounds logarithmic in the size of a component); a node with
    very many edges is first reduced by partial aggregation to its minimum."""
    cur = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                  .where("u <> v").distinct(), "edges")
    while True:
        both = cur.union(cur.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (both.join(low, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct())
        large = written(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).distinct())
        small = written(small, "edges")
        # done when every node has one edge and no node is both a child and a root
        stable = small.join(small.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty() and (
            small.groupBy("u").count().where("count > 1").isEmpty())
        cur = small
        if stable:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("comp"))


def _mixed(slots: DataFrame, root: str) -> DataFrame:
    """(bucket, top): buckets of several trees, and the tree with the most members there."""
    sizes = slots.groupBy("bucket", root).agg(F.count("*").alias("m"))
    return sizes.groupBy("bucket").agg(F.max(F.struct("m", root)).alias("t"), F.count("*").alias("k")).where(
        "k > 1").select("bucket", F.col(f"t.{root}").alias("top"))


def near_duplicates(docs: DataFrame, text: str = "text", size: int = 5, jaccard: float = 0.8) -> DataFrame:
    """Class of every document row.

    Returns one row per input row: rid (a row number of this run), doc_id, th (xxhash64 of
    the text), n_shingles, class_id (a number of the linked group), component_id (smallest doc_id linked with it over any number of
    links, itself included), kept (doc_id = component_id). A null, empty or wordless text has
    no shingle, is linked with nothing and kept. Repeated rows are equal sets and so one class;
    rows that share a doc_id share whatever links each of them has. A null doc_id never
    becomes a component_id unless its whole component has none; it is then kept.
    An empty table gives an empty result.
    """
    base = written(_sketch_table(docs, text, size), "sketches")
    key = ["n_shingles", "d1", "d2"]
    # equal sets: one class, represented by its first row
    cls = written(base.where("n_shingles > 0").groupBy(*key).agg(
        F.min("rid").alias("cid"), F.min("doc_id").alias("low"),
        F.min_by(F.struct("doc_id", "th"), "rid").alias("at")), "classes")
    heads = base.join(cls.select(F.col("cid").alias("rid")), "rid", "left_semi").select(
        F.col("rid").alias("cid"), "bands", "sketch")
    slots = heads.select("cid", F.explode("bands").alias("bucket"))
    shared = slots.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    slots = written(slots.join(shared, "bucket"), "slots")

    # one hub per class: the class that shares most, among those it shares a bucket with
    score = slots.groupBy("cid").agg(F.sum("n").alias("score"))
    ranked = slots.join(score, "cid").select("bucket", "cid", F.struct("score", "cid").alias("rank"))
    hub = ranked.groupBy("bucket").agg(F.max("rank").alias("hub"))
    best = (ranked.join(hub, "bucket").where("hub > rank").groupBy("cid").agg(F.max("hub").alias("hub"))
            .select(F.col("cid").alias("a"), F.col("hub.cid").alias("b")))
    best = written(best, "hub-links")

    need = cls.join(slots.select("cid").distinct(), "cid", "left_semi").select("cid", "at.doc_id", "at.th")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"),
                      F.col(text).alias("text"))
    same = need["doc_id"].eqNullSafe(src["doc_id"]) & (need["th"] == src["th"])
    full = src.join(need, same).select("cid", "text").dropDuplicates(["cid"])
    full = written(full.join(heads.select("cid", "sketch"), "cid"), "texts")

    # 1. each class and its hub
    links = written(confirm(best, full, size, jaccard), "links")
    tree = roots(links.select(F.col("a").alias("node"), F.col("b").alias("parent")))
    slots = written(slots.join(tree.withColumnRenamed("node", "cid"), "cid", "left").select(
        "bucket", "cid", F.coalesce("root", "cid").alias("root")), "slots")

    # 2. each class and the largest other tree of each of its buckets
    left = slots.join(_mixed(slots, "root"), "bucket")
    asks = left.where("root <> top").select(F.col("cid").alias("a"), F.col("root").alias("own"), "top").distinct()
    asks = written(asks, "asks")
    label = slots.select("cid", "root").distinct()
    found = written(ask(asks, label.withColumn("top", F.col("root")), full, size, jaccard), "asked-links")
    joined = found.join(label.toDF("a", "ra"), "a").join(label.toDF("b", "rb"), "b").select(
        F.col("ra").alias("a"), F.col("rb").alias("b"))
    second = components(joined).toDF("root", "root2")

    # 3. the trees are joined now: each class and the largest other one of each of its buckets, if not yet asked
    final = written(label.join(second, "root", "left").select("cid", F.coalesce("root2", "root").alias("root")), "trees")
    left = slots.select("bucket", "cid").join(final, "cid")
    left = written(left.join(_mixed(left, "root"), "bucket").where("root <> top"), "outside")
    grown = second.select(F.col("root2").alias("top")).distinct()
    held = asks.select("a", "top").join(grown, "top", "left_anti")
    again = left.select(F.col("cid").alias("a"), F.col("root").alias("own"), "top").distinct().join(
        held, ["a", "top"], "left_anti")
    more = ask(written(again, "asks"), final.withColumn("top", F.col("root")), full, size, jaccard)

    # 4. the classes outside the largest tree of a bucket, among themselves
    among = left.select(F.col("bucket").alias("top"), "cid", "root")
    several = among.groupBy("top").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r < s").select("top")
    among = written(among.join(several, "top"), "among")
    # an alias of its own for the top: both sides come from the same table
    askers = among.select(F.col("top").alias("top"), F.col("cid").alias("a"), F.col("root").alias("own"))
    rest = ask(askers, among, full, size, jaccard, among=True)
    more = written(more.union(rest), "rest-links")

    joined = more.join(final.toDF("a", "ra"), "a").join(final.toDF("b", "rb"), "b").select(
        F.col("ra").alias("a"), F.col("rb").alias("b"))
    comp = components(joined).toDF("root", "comp")
    named = (cls.select(*key, "cid", "low").join(final, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
             .join(comp, "root", "left").select(*key, "low", F.coalesce("comp", "root").alias("comp")))
    lowest = named.groupBy("comp").agg(F.min("low").alias("component_id"))
    named = named.join(lowest, "comp").select(*key, "component_id", "comp")
    out = base.select("rid", "doc_id", "th", *key).join(named, key, "left")
    return out.select("rid", "doc_id", "th", "n_shingles", F.coalesce("comp", -1 - F.col("rid")).alias("class_id"),
                      F.coalesce("component_id", "doc_id").alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

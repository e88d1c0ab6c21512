"""Centroid clusters, repeated spans and the Merkle manifest against brute force, on odd rows and empty tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rareflag.llm import merkle, pivot_means, suffix_dedup, suffixes
from tests.conftest import SF0001


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# ---- suffix arrays


def test_suffix_array_equals_sorting_with_either_induction(monkeypatch):
    rng = np.random.default_rng(3)
    for small in (512, 0):
        monkeypatch.setattr(suffixes, "SMALL_ALPHABET", small)
        for _ in range(150):
            sigma = int(rng.integers(2, 6))
            s = np.append(rng.integers(1, sigma, rng.integers(0, 50)), 0).astype(np.int32)
            want = sorted(range(len(s)), key=lambda i: s[i:].tolist())
            assert suffixes.suffix_array(s, sigma).tolist() == want


def test_common_prefixes_are_counted_up_to_the_bound():
    rng = np.random.default_rng(4)
    data = rng.integers(0, 2, 200).astype(np.uint8)
    data[100:160] = data[20:80]
    sa = np.array(sorted(range(len(data)), key=lambda i: data[i:].tolist()))
    got = suffixes.common_prefixes(data, sa, 50)
    raw = data.tobytes()
    for r in range(1, len(sa)):
        a, b = raw[sa[r - 1]:], raw[sa[r]:]
        same = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert got[sa[r]] == min(same, 50)


# ---- repeated spans


def brute_spans(rows, span=50):
    first = {}
    for d, t in rows:
        for i in range(len(t) - span + 1) if d is not None else ():
            first[t[i:i + span]] = min(d, first.get(t[i:i + span], d))
    out = {}
    for d, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - span + 1) if d is not None else ():
            if first[t[i:i + span]] < d:
                gone[i:i + span] = b"\1" * span
        kept = bytes(b for b, x in zip(t, gone, strict=True) if not x)
        spans = [i for i in range(len(t)) if gone[i] and not (i and gone[i - 1])]
        out.setdefault(d, []).append((len(t), sum(gone), len(spans), kept))
    return {d: sorted(v) for d, v in out.items()}


def spark_spans(df, **kw):
    out = {}
    for r in suffix_dedup.remove_repeats(df, **kw).collect():
        assert r.n_removed == sum(s.end - s.start for s in r.spans)
        out.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)))
    return {d: sorted(v) for d, v in out.items()}


def as_bytes(df):
    return [(r.doc_id, (r.text or "").encode()) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("kw", [{}, {"pack": 20_000, "shard": 3000, "hot": 3, "array": 3000}])
def test_spans_equal_brute_force(spark, kw):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    docs = docs.union(docs.where("doc_id % 31 = 0").withColumn("doc_id", F.col("doc_id") * 3 + 1)).union(
        docs.where("doc_id % 41 = 0"))
    assert spark_spans(docs, **kw) == brute_spans(as_bytes(docs))


def test_spans_of_odd_rows(spark):
    rng = random.Random(6)
    base = "".join(rng.choice("abcd efgh") for _ in range(400))
    texts = [(5, base), (3, base[:49]), (2, base[100:150]), (9, base), (9, base), (9, "x" + base), (7, None), (6, ""),
             (None, base), (8, "a" * 5000), (4, "a" * 300), (10, "é" * 40 + base), (11, "é" * 40), (12, base[:70] + "日本" * 30),
             (13, "日本" * 30 + base[50:]), (14, "\x00" * 60), (15, "\x00" * 55 + base[3:60])]
    rows = [(d, t, "x", "y", 1) for d, t in texts]
    df = spark.createDataFrame(rows, "doc_id long, text string, pack string, shard string, data int")
    assert spark_spans(df) == brute_spans(as_bytes(df))
    assert spark_spans(df, hot=1, pack=500) == brute_spans(as_bytes(df))
    assert suffix_dedup.remove_repeats(df.limit(0)).collect() == []


def test_spans_of_periodic_texts(spark):
    rng = random.Random(8)
    other = ["".join(rng.choice("abcdefgh") for _ in range(60)) for _ in range(30)]
    texts = [other[i] + rng.choice(["-", "ab", "=~*"]) * rng.randrange(40, 250) + (other[i - 1][:9] if i % 3 else "")
             for i in range(30)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for kw in ({}, {"hot": 3}, {"pack": 2000, "shard": 300}):
        assert spark_spans(df, **kw) == brute_spans(as_bytes(df))


# ---- Merkle manifest


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text) -> sorted output tuples."""
    def h(parts):
        return sha("".join(parts))

    def leaf(r):
        return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r)

    def build(hashes):
        levels = [hashes]
        while len(levels[-1]) > 1:
            levels.append([h(levels[-1][i:i + 3]) for i in range(0, len(levels[-1]), 3)])
        return levels

    def path(levels, i):
        out = []
        for lev in levels[:-1]:
            a = i // 3 * 3
            out.append((lev[a:i], lev[i + 1:a + 3]))
            i //= 3
        return out

    groups = {}
    for r in rows:
        groups.setdefault((r[1] is not None, (r[1] or "").encode()), []).append(r)
    trees = {}
    for k, g in groups.items():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[k] = build([leaf(r) for r in g])
    names = sorted(trees)
    top = build([trees[k][-1][0] for k in names])
    out = []
    for n, k in enumerate(names):
        for i, r in enumerate(groups[k]):
            p = path(trees[k], i) + path(top, n)
            seen = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                seen = leaf((*r[:4], None if r[4] is None else r[4].replace("\n", "")))
            for before, after in p:
                seen = h([*before, seen, *after])
            out.append((r[0], leaf(r), trees[k][-1][0], top[-1][0], h(x for b, a in p for x in (*b, *a)), seen,
                        seen == top[-1][0]))
    return sorted(out, key=str)


def spark_manifest(spark, rows, extra=""):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    df = spark.createDataFrame(rows, schema).withColumns({c: F.lit(1) for c in ("grp", "id", "leaf", "pos", "total", "c0")})
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    cut = F.replace("text", F.lit("\n"), F.lit(""))
    df = df.withColumn("tampered", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, merkle.digest(
        *(merkle.field(cut if c == "text" else F.col(c)) for c in fields))))
    out = merkle.manifest(df, fields, "source", "doc_id", carry=("tampered",)).withColumn(
        "folded", merkle.fold(F.coalesce("tampered", "leaf")))
    got = out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(), "folded", F.col("folded") == F.col("root"))
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_manifest_equals_brute_force(spark):
    rng = random.Random(2)
    for n in (1, 2, 3, 10, 300):
        rows = [(rng.choice([i, i << 40, -i]), rng.choice(["a", "b", None, "é"]) if n > 3 else "a", None, i, f"t\n{i}")
                for i in range(n)]
        assert spark_manifest(spark, rows) == brute_manifest(rows), n


def test_manifest_of_odd_rows(spark):
    rows = [(1, "s", "en", 3, "abc"), (1, "s", "en", 3, "abc"), (1, "s", "en", 4, "abcd"), (None, "s", None, None, None),
            (None, "s", "de", 1, "\n"), (None, None, None, None, None), (-(1 << 63), "s", None, 0, ""),
            ((1 << 63) - 1, "s", None, 0, "x" * 300_000), (65535, "s", None, None, "日本\n語"), (65536, "", "", 0, "\n\n")]
    assert spark_manifest(spark, rows) == brute_manifest(rows)
    assert spark_manifest(spark, []) == []


def test_ranks_of_sparse_and_repeated_ids(spark):
    rng = random.Random(8)
    ids = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(200)] + list(range(500)) + [7] * 30
    leaves = spark.createDataFrame([("g", i, sha(f"{i}{n}")) for n, i in enumerate(ids)], "grp string, id long, leaf string")
    got = merkle.coordinates(leaves).collect()
    want = sorted((i, sha(f"{i}{n}")) for n, i in enumerate(ids))
    assert sorted((r.pos, r.id, r.leaf) for r in got) == [(n, *w) for n, w in enumerate(want)]
    assert {r.total for r in got} == {len(ids)}


# ---- centroid clusters


def brute_clusters(rows, k, rounds, dims, scale):
    kept = [(i, [int(np.floor(float(x) * scale)) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, sha(f"1:{r[0]}") if r[0] is not None else "", r[1]))
    cents = [list(v) for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cents))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for n in range(len(cents)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == n]
            if mine:
                cents[n] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    got = [(i, *near(v)) for i, v in kept]
    total = {n: sum(d for _, d, m in got if m == n) for n in range(len(cents))}
    return sorted(((i, n, d, total[n], sum(total.values()), sha(",".join(map(str, cents[n])))) for i, d, n in got), key=str)


def spark_clusters(df, **kw):
    out = pivot_means.cluster(df, **kw).drop("exact_checks")
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=4) + 3 * (i % 3)]) for i in range(300)]
    nan, inf = float("nan"), float("inf")
    rows += [(None, [0.5] * 4), (None, [0.25] * 4), (1, rows[1][1]), (2, [9.0] * 4), (900, None), (901, []), (902, [1.0] * 3),
             (903, [1.0, None, 1.0, 1.0]), (904, [1.0, nan, 1.0, 1.0]), (905, [1.0, inf, 1.0, -inf]), (906, [1.0] * 5),
             (907, [-0.0] * 4), (908, [1e5, -1e5, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 0, 0, 0) for r in rows],
                               "vec_id long, embedding array<double>, cluster int, v int, id int")
    for k in (1, 5, 16):
        kw = {"k": k, "rounds": 3, "dims": 4, "scale": 64}
        assert spark_clusters(df, **kw) == brute_clusters(rows, **kw), k
    few = [(1, [1.0, 2.0, 3.0, 4.0]), (2, [1.0, 2.0, 3.0, 4.0])]
    kw = {"k": 16, "rounds": 3, "dims": 4, "scale": 64}
    some = spark.createDataFrame(few, "vec_id long, embedding array<float>")
    assert spark_clusters(some, **kw) == brute_clusters(few, **kw)
    assert spark_clusters(some.limit(0), **kw) == []


def test_too_large_components_are_refused(spark):
    df = spark.createDataFrame([(1, [1e9] * 4)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="component beyond"):
        pivot_means.cluster(df, k=2, rounds=1, dims=4, scale=64)


def test_ptolemaic_bounds_are_below_the_distances_and_prune():
    rng = np.random.default_rng(7)
    x = np.floor(rng.normal(size=(2000, 8)) * 64 + 300 * rng.integers(0, 6, (2000, 1))).astype(np.int64)
    pivots = pivot_means.choose_pivots(x[:128])
    cents = x[rng.choice(len(x), 16, replace=False)]
    bound = pivot_means.lower_bounds(pivot_means.pivot_distances(x, pivots), pivot_means.pivot_distances(cents, pivots), pivots)
    exact = ((x[:, None] - cents[None]) ** 2).sum(axis=2)
    assert (bound ** 2 <= exact).all()
    best, dist, checks = pivot_means.nearest(x, pivot_means.pivot_distances(x, pivots), cents, pivots)
    assert (best == exact.argmin(axis=1)).all() and (dist == exact.min(axis=1)).all()
    assert checks < 0.6 * exact.size

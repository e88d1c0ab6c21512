"""Exact medians that scale.

Spark's built-in ``median`` keeps a map of distinct values per group in one
aggregation buffer, which does not fit for a continuous column over billions
of rows. ``select_medians`` finds the exact order statistics with a few
distributed histogram passes instead: each pass is one aggregation of all
columns at once (unpivoted to ``(col, value)``, partially aggregated before
the shuffle) into at most ``bins`` buckets per column; only the bucket holding
the wanted rank is refined. A bucket whose values are all equal (a hot value
holding a third of the rows) ends the search at once. The last step collects
at most ``collect_limit`` values per column.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def builtin_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    if not cols:
        return {}
    row = df.agg(*[F.median(c).alias(c) for c in cols]).first()
    return {c: (None if row[c] is None else float(row[c])) for c in cols}


def approx_medians(df: DataFrame, cols: Sequence[str], accuracy: int = 100000) -> dict[str, float | None]:
    if not cols:
        return {}
    row = df.agg(*[F.percentile_approx(c, 0.5, accuracy).alias(c) for c in cols]).first()
    return {c: (None if row[c] is None else float(row[c])) for c in cols}


def _long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(k, v) rows of all non-null values; k is the column ordinal."""
    arr = F.array(*[F.struct(F.lit(i).alias("k"), F.col(c).cast("double").alias("v"))
                    for i, c in enumerate(cols)])
    return df.select(F.inline(arr)).where(F.col("v").isNotNull())


def select_medians(df: DataFrame, cols: Sequence[str], bins: int = 4096,
                   collect_limit: int = 20000, max_passes: int = 64) -> dict[str, float | None]:
    """Exact midpoint medians (pandas / DuckDB semantics) by histogram refinement.

    For a column with ``n`` values the lower middle rank ``t = (n-1)//2`` is
    searched; for even ``n`` the next rank is either inside the final window
    or the smallest value above it (one more aggregation for all columns).
    """
    if not cols:
        return {}
    long = _long(df, cols)
    # pass 1: counts, range and a narrow approximate window around the middle
    # (GK sketch: rank error <= n / accuracy, memory O(accuracy) per column)
    eps = WINDOW_RANKS / APPROX_ACCURACY
    stats = long.groupBy("k").agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"),
        F.percentile_approx("v", F.array(F.lit(max(0.0, 0.5 - eps)), F.lit(min(1.0, 0.5 + eps))),
                            APPROX_ACCURACY).alias("w")).collect()
    fast = _window_medians(long, stats, cols, collect_limit)
    if fast is not None:
        return fast
    st = {}
    for r in stats:
        n = int(r["n"])
        st[int(r["k"])] = {"n": n, "t": (n - 1) // 2, "lo": float(r["lo"]), "hi": float(r["hi"]),
                           "below": 0, "count": n, "vals": None}
    for _ in range(max_passes):
        active = {k: s for k, s in st.items() if s["lo"] < s["hi"] and s["vals"] is None
                  and s["count"] > collect_limit}
        if not active:
            break
        cond, bucket = None, None
        for k, s in active.items():
            in_k = F.col("k") == k
            c = in_k & (F.col("v") >= s["lo"]) & (F.col("v") <= s["hi"])
            cond = c if cond is None else (cond | c)
            b = F.least(F.floor((F.col("v") - F.lit(s["lo"])) / F.lit(s["hi"] - s["lo"]) * bins),
                        F.lit(bins - 1))
            bucket = F.when(in_k, b) if bucket is None else bucket.when(in_k, b)
        hist = (long.where(cond).withColumn("b", bucket.cast("int"))
                .groupBy("k", "b").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"),
                                       F.max("v").alias("hi")).collect())
        per_k: dict[int, list] = {}
        for r in hist:
            per_k.setdefault(int(r["k"]), []).append((int(r["b"]), int(r["n"]), float(r["lo"]), float(r["hi"])))
        for k, s in active.items():
            cum = s["below"]
            for b, n, lo, hi in sorted(per_k.get(k, [])):
                if cum <= s["t"] < cum + n:
                    s.update(lo=lo, hi=hi, below=cum, count=n)
                    break
                cum += n
    else:
        raise RuntimeError("median selection did not converge")
    # collect the small windows (at most collect_limit values per column)
    small = [k for k, s in st.items() if s["lo"] < s["hi"]]
    if small:
        cond = None
        for k in small:
            s = st[k]
            c = (F.col("k") == k) & (F.col("v") >= s["lo"]) & (F.col("v") <= s["hi"])
            cond = c if cond is None else (cond | c)
        got: dict[int, list] = {}
        for r in long.where(cond).select("k", "v").collect():
            got.setdefault(int(r["k"]), []).append(float(r["v"]))
        for k in small:
            st[k]["vals"] = sorted(got[k])
    # the upper middle rank for even counts
    need_next = {}
    lower = {}
    for k, s in st.items():
        i = s["t"] - s["below"]
        lower[k] = s["lo"] if s["vals"] is None else s["vals"][i]
        if s["n"] % 2 == 0:
            if s["t"] + 1 < s["below"] + s["count"]:
                need_next[k] = s["lo"] if s["vals"] is None else s["vals"][i + 1]
            else:
                need_next[k] = None
    missing = [k for k, v in need_next.items() if v is None]
    if missing:
        cond = None
        for k in missing:
            c = (F.col("k") == k) & (F.col("v") > st[k]["hi"])
            cond = c if cond is None else (cond | c)
        for r in long.where(cond).groupBy("k").agg(F.min("v").alias("m")).collect():
            need_next[int(r["k"])] = float(r["m"])
    out: dict[str, float | None] = {c: None for c in cols}
    for k in st:
        out[cols[k]] = (lower[k] + need_next[k]) / 2.0 if k in need_next else lower[k]
    return out


APPROX_ACCURACY = 10000
WINDOW_RANKS = 4     # window half-width in units of the sketch's rank error


def _window_medians(long: DataFrame, stats, cols, collect_limit: int):
    """Pass 2 of the fast path: values inside each column's window (with
    multiplicity) and the count below it, in one job. Returns None when a
    window is too large to collect or does not hold the middle ranks."""
    win = {}
    for r in stats:
        n = int(r["n"])
        if n * 2 * WINDOW_RANKS / APPROX_ACCURACY + 2 * WINDOW_RANKS > collect_limit:
            return None
        w = r["w"]
        win[int(r["k"])] = (n, float(w[0]), float(w[1]))
    if not win:
        return {c: None for c in cols}
    cond, key = None, None
    for k, (n, lo, hi) in win.items():
        in_k = F.col("k") == k
        c = in_k & (F.col("v") <= F.lit(hi))
        cond = c if cond is None else (cond | c)
        kv = F.when(F.col("v") >= F.lit(lo), F.col("v"))
        key = F.when(in_k, kv) if key is None else key.when(in_k, kv)
    rows = (long.where(cond).groupBy("k", key.alias("x")).agg(F.count(F.lit(1)).alias("m")).collect())
    below = {k: 0 for k in win}
    vals: dict[int, list] = {k: [] for k in win}
    for r in rows:
        k = int(r["k"])
        if r["x"] is None:
            below[k] += int(r["m"])
        else:
            vals[k].append((float(r["x"]), int(r["m"])))
    out = {c: None for c in cols}
    for k, (n, lo, hi) in win.items():
        ranks = sorted({(n - 1) // 2, n // 2})
        seq = sorted(vals[k])
        total = sum(m for _, m in seq)
        if not (below[k] <= ranks[0] and ranks[-1] < below[k] + total):
            return None
        picked = []
        for t in ranks:
            pos = t - below[k]
            for x, m in seq:
                if pos < m:
                    picked.append(x)
                    break
                pos -= m
        out[cols[k]] = (picked[0] + picked[-1]) / 2.0
    return out


def medians(df: DataFrame, cols: Sequence[str], method: str = "select") -> dict[str, float | None]:
    if method == "exact":
        return builtin_medians(df, cols)
    if method == "approx":
        return approx_medians(df, cols)
    if method == "select":
        return select_medians(df, cols)
    raise ValueError(f"unknown median method {method!r}")


def means(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    if not cols:
        return {}
    row = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    return {c: (None if row[c] is None or (isinstance(row[c], float) and math.isnan(row[c]))
                else float(row[c])) for c in cols}

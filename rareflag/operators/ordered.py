"""Global ranks and running sums without a single-partition window.

``row_number() over (order by k)`` and ``sum(x) over (order by k)`` without a
partition clause move every row into one task. Here each row gets a bucket
that is a pure function of its ordering value, which may have any type with
an order (strings too): the distinct values whose hash falls into one of M
residues are a uniform sample of them, about ``SAMPLE`` a bucket reach the
driver, and evenly spaced ones of them are the bucket bounds. Equal-width
bins would put nearly all rows into one bucket where one value lies far off.
Ranks / running sums are computed per bucket in
parallel, a tiny table (one row per group and bucket) carries the totals,
and its running offsets are joined back (no broadcast hint; AQE broadcasts
from measured size).

Because the bucket depends only on the row, the plan is consistent between
its branches and under task retries — no dependence on sampled range bounds
or shuffle order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "_rf_b"


def _target_buckets(df: DataFrame, buckets: int | None) -> int:
    if buckets:
        return int(buckets)
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8")))


#: sampled distinct values for each bucket; a bucket's share then strays by about 1 / sqrt(SAMPLE)
SAMPLE = 64


def _search(v: Column, cuts: list[Column], first: int) -> Column:
    """Number of ``cuts`` (ascending) below ``v``, plus ``first``: a search tree, so log2 comparisons a row."""
    if not cuts:
        return F.lit(first)
    mid = len(cuts) // 2
    return F.when(v <= cuts[mid], _search(v, cuts[:mid], first)).otherwise(
        _search(v, cuts[mid + 1:], first + mid + 1))


def _bounds(df: DataFrame, value: Column, n_b: int, sample: int) -> list:
    """At most ``n_b`` - 1 values, ascending, that cut the values into parts of about as many distinct ones.

    Two small jobs: the approximate number of distinct values, then a sample of about ``sample`` a part. Where every
    distinct value is in the sample their row counts are balanced, else their number."""
    vals = df.select(value.alias("v")).where("v is not null")
    every = max(1, vals.agg(F.approx_count_distinct("v")).first()[0] // (sample * n_b))
    rows = vals.where(F.pmod(F.xxhash64("v"), F.lit(every)) == 0).groupBy("v").agg(
        F.count(F.lit(1)).alias("n")).orderBy("v").collect()
    weights = [r["n"] if every == 1 else 1 for r in rows]
    per = sum(weights) / n_b
    cuts, run, share = [], 0, per
    for r, w in zip(rows[:-1], weights):  # nothing lies above the last value's bucket
        run += w
        if run >= share:
            cuts.append(r["v"])
            share = per * (run // per + 1)
    return cuts


def _bucket(df: DataFrame, value: Column, cuts: list) -> Column:
    """Number of ``cuts`` below ``value``; 0 for a null."""
    kind = df.select(value.alias("v")).schema["v"].dataType
    return F.when(value.isNull(), 0).otherwise(_search(value, [F.lit(c).cast(kind) for c in cuts], 0))


def bucket_column(df: DataFrame, value: Column, buckets: int | None = None) -> Column:
    """Monotone bucket id of ``value`` (non-decreasing in value), balanced (``_bounds``).

    Rows of one value always share a bucket. A null is in the first bucket, a NaN in the last.
    """
    n_b = _target_buckets(df, buckets)
    if n_b == 1:
        return F.lit(0)
    return _bucket(df, value, _bounds(df, value, n_b, SAMPLE))


def rank_within(df: DataFrame, order: Sequence[Column], value: Column, keys: Sequence[str] = (),
                out: str = "rank", buckets: int | None = None) -> DataFrame:
    """0-based rank of each row within its ``keys`` group by ``order``.

    ``value`` is a column of any ordered type, non-decreasing along ``order`` (it
    picks the bucket); ``order`` must make rows unique (end it with the id).
    """
    keys = list(keys)
    d = df.withColumn(BUCKET, bucket_column(df, value, buckets))
    w = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    local = d.withColumn("_rf_local", F.row_number().over(w) - 1)
    counts = d.groupBy(*keys, BUCKET).agg(F.count(F.lit(1)).alias("_rf_n"))
    wo = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, BUCKET, F.coalesce(F.sum("_rf_n").over(wo), F.lit(0)).alias("_rf_off"))
    return (local.join(offsets, [*keys, BUCKET], "inner")
            .withColumn(out, (F.col("_rf_local") + F.col("_rf_off")).cast("bigint"))
            .drop(BUCKET, "_rf_local", "_rf_off"))


#: rows of the last parts that ``cut_values`` groups by value, and least and most buckets of a pass
PART, FEWEST, MOST = 50_000, 128, 512
#: sampled distinct values for each of its buckets
COARSE = 16


def _within(v: Column, parts: list, kind) -> Column:
    """Whether ``v`` lies in one of ``parts``: (above, up to), where no first bound lets nulls in and no last one all above."""
    out = F.lit(False)
    for above, upto in parts:
        low = F.lit(True) if above is None else v > F.lit(above).cast(kind)
        high = F.lit(True) if upto is None else v <= F.lit(upto).cast(kind)
        out = out | ((low & high) | v.isNull() if above is None else low & high)
    return out


def cut_values(df: DataFrame, value: Column, ranks: dict, key: Column | None = None, limit: int = PART) -> dict:
    """For each group of ``key`` in ``ranks`` and each of its 0-based ranks: (value, rows below it, rows of it)
    in ascending order, nulls first.

    No row is moved: each pass counts rows by bucket and keeps the buckets that hold a wanted rank, until
    ``limit`` rows are left (or rows of one value); their values and counts reach the driver. A pass knows the buckets of
    the one before by their two values, so its query does not grow with the passes.
    """
    n_b = min(MOST, max(FEWEST, _target_buckets(df, None)))
    rows = df.select((F.lit(0) if key is None else key).alias("g"), value.alias("v")).where(F.col("g").isin(list(ranks)))
    kind, v = rows.schema["v"].dataType, F.col("v")
    at = {(g, r): ((None, None), 0) for g, rs in ranks.items() for r in rs}  # part and rows below it
    cur, left = rows, None
    while at:
        parts = list(dict.fromkeys(part for part, _ in at.values()))
        # a bucket lies within one part, or outside them all
        cuts = sorted({*_bounds(cur, v, n_b, COARSE), *(x for part in parts for x in part if x is not None)})
        counts: dict = {}
        total: dict = {}
        for r in cur.groupBy("g", _bucket(cur, v, cuts).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect():
            part = (cuts[r["b"] - 1] if r["b"] else None, cuts[r["b"]] if r["b"] < len(cuts) else None)
            counts.setdefault(r["g"], []).append((r["b"], part, r["n"]))
            total[part] = total.get(part, 0) + r["n"]
        for (g, rank), ((above, _), below) in at.items():
            first = 0 if above is None else cuts.index(above) + 1
            for b, part, n in sorted(counts[g], key=lambda c: c[0]):
                if b < first:
                    continue
                if rank < below + n:
                    break
                below += n
            at[g, rank] = (part, below)
        parts = list(dict.fromkeys(part for part, _ in at.values()))
        cur = rows.where(_within(v, parts, kind))
        before, left = left, sum(total[part] for part in parts)
        if left <= limit or left == before:
            break
    found: dict = {}
    for r in cur.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n")).orderBy("v").collect() if at else ():
        found.setdefault(r["g"], []).append((r["v"], r["n"]))
    out: dict = {g: {} for g in ranks}
    for (g, rank), ((above, _), below) in at.items():
        for x, n in found[g]:
            if above is not None and (x is None or x <= above):
                continue
            if rank < below + n:
                break
            below += n
        out[g][rank] = (x, below, n)
    return out


def running_sums(df: DataFrame, order: Sequence[Column], value: Column, sums: Sequence[str],
                 buckets: int | None = None, prefix: str = "cum_") -> DataFrame:
    """Inclusive running sums of ``sums`` along a global ``order``; ``value``
    as in :func:`rank_within`. ``order`` must make rows unique."""
    d = df.withColumn(BUCKET, bucket_column(df, value, buckets))
    w = Window.partitionBy(BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = d.select("*", *[F.sum(c).over(w).alias(f"_rf_l_{c}") for c in sums])
    totals = d.groupBy(BUCKET).agg(*[F.sum(c).alias(f"_rf_t_{c}") for c in sums])
    wo = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    # one row per bucket: this window is over a table of at most `buckets` rows
    offsets = totals.select(BUCKET, *[F.coalesce(F.sum(f"_rf_t_{c}").over(wo), F.lit(0)).alias(f"_rf_o_{c}")
                                      for c in sums])
    j = local.join(offsets, BUCKET, "inner")
    for c in sums:
        j = j.withColumn(f"{prefix}{c}", F.col(f"_rf_l_{c}") + F.col(f"_rf_o_{c}"))
    return j.drop(BUCKET, *[f"_rf_l_{c}" for c in sums], *[f"_rf_o_{c}" for c in sums])

"""Class balancing: balanced weights (A9, see ``explore.class_weights``) and
SMOTE oversampling (M12, J4, U1).

SMOTE fills the smallest class (strategy ``minority``) or every class below the
largest (``not majority``) up to the largest: ``n_max - n_c`` synthetic rows. A class
to fill needs more than ``k`` rows, as each row needs k neighbours. Synthetic row i of class c takes the base
row of rank ``h('b',c,i) mod n_c`` (id order within the class), its
neighbour of rank ``h('n',c,i) mod k + 1`` among the other rows of the class
(exact kNN join, grouped by class), and ``u = h('u',c,i) / 2^32``; the row is
``x + u (nn - x)`` (``zip_with``, JVM-side). ``h`` is md5 of ``seed:...``.

The synthetic index rows come from ``spark.range`` (distributed, never one
row exploded in one task) and are mapped to (class, i) with the class
offsets; base rows and neighbours arrive by equi-joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rareflag.functions.randomness import TWO32, hash_u32
from rareflag.operators.neighbors import as_double_array, knn_join
from rareflag.operators.ordered import rank_within


def smote(df: DataFrame, label: str, vec: str, id_col: str = "id", k: int = 5, seed: int = 42,
          p: float = 2.0, strategy: str = "minority") -> DataFrame:
    """Synthetic rows ``(label, synth_i, base_id, neighbor_id, u, vec)``.

    Of several smallest classes the first by label is filled. Raises ValueError when a class to
    fill has ``k`` rows or fewer."""
    if strategy not in ("minority", "not majority"):
        raise ValueError(f"unknown strategy {strategy!r}")
    spark = df.sparkSession
    for f in df.schema.fields:
        if f.name == vec and "array" not in f.dataType.simpleString():
            raise TypeError("SMOTE needs a numeric array column without nulls")
    counts = sorted((r[0], int(r[1])) for r in df.groupBy(label).count().collect())
    if not counts:
        return spark.createDataFrame([], f"{label} int, synth_i bigint, base_id bigint, neighbor_id bigint, "
                                          f"u double, {vec} array<double>")
    n_max = max(n for _, n in counts)
    majority = next(c for c, n in counts if n == n_max)
    plan = [(c, n, n_max - n) for c, n in counts if c != majority and n_max - n > 0]
    if strategy == "minority" and plan:
        plan = [min(plan, key=lambda r: r[1])]
    few = [(c, n) for c, n, _ in plan if n <= k]
    if few:
        raise ValueError(f"SMOTE with k={k} needs more than {k} rows in a class; has (class, rows) {few}")
    base = df.select(F.col(id_col).alias("base_id"), F.col(label), as_double_array(vec).alias("x"))
    ranked = rank_within(base, [F.col("base_id").asc()], F.col("base_id"), keys=[label], out="base_rank")
    # neighbours of every row of the resampled classes, within its class
    minority = df.where(F.col(label).isin([c for c, _, _ in plan]))
    nn = knn_join(minority, minority, k, p, q_id=id_col, t_id=id_col, q_vec=vec, t_vec=vec,
                  exclude_self=True, group=label)
    total = sum(m for _, _, m in plan)
    idx = spark.range(total).withColumnRenamed("id", "g")
    # global index -> (class, i) with the class offsets (one branch per class)
    cls, off = None, 0
    off_expr = None
    n_expr = None
    for c, n, m in plan:
        cond = F.col("g") < off + m
        cls = F.when(cond, F.lit(c)) if cls is None else cls.when(cond, F.lit(c))
        off_expr = F.when(cond, F.lit(off)) if off_expr is None else off_expr.when(cond, F.lit(off))
        n_expr = F.when(cond, F.lit(n)) if n_expr is None else n_expr.when(cond, F.lit(n))
        off += m
    syn = idx.select(cls.alias(label), (F.col("g") - off_expr).alias("synth_i"), n_expr.alias("n_c"))
    syn = syn.select(label, "synth_i",
                     (hash_u32(seed, "b", F.col(label), F.col("synth_i")) % F.col("n_c")).alias("base_rank"),
                     (hash_u32(seed, "n", F.col(label), F.col("synth_i")) % k + 1).cast("int").alias("nn_rank"),
                     (hash_u32(seed, "u", F.col(label), F.col("synth_i")) / F.lit(TWO32)).alias("u"))
    j = syn.join(ranked, [label, "base_rank"])
    j = j.join(nn.select(F.col("qid").alias("base_id"), F.col("rank").alias("nn_rank"),
                         F.col("tid").alias("neighbor_id")), ["base_id", "nn_rank"])
    j = j.join(base.select(F.col("base_id").alias("neighbor_id"), F.col("x").alias("xn")), "neighbor_id")
    v = F.zip_with("x", "xn", lambda a, b: a + F.col("u") * (b - a))
    return j.select(label, "synth_i", "base_id", "neighbor_id", "u", v.alias(vec))


def smote_union(df: DataFrame, label: str, vec: str, id_col: str = "id", k: int = 5, seed: int = 42,
                strategy: str = "minority") -> DataFrame:
    """Original rows plus synthetic rows (U1), with a ``synthetic`` flag."""
    syn = smote(df, label, vec, id_col, k, seed, strategy=strategy)
    orig = df.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(label), as_double_array(vec).alias(vec),
                     F.lit(False).alias("synthetic"))
    s = syn.select(F.lit(None).cast("bigint").alias("row_id"), F.col(label), F.col(vec),
                   F.lit(True).alias("synthetic"))
    return orig.unionByName(s)

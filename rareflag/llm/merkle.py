"""Merkle manifest of a dataset by bitmap ranks, in DataFrame functions only.

Coordinates. The ids of each group are kept as compressed bitmaps: a container covers 2^16 ids and
holds its non-empty 64-bit words with the words' places, a popcount directory (ids before each word)
and, for ids that occur more than once, their extra rows. Containers are summed up a tree of
2^16-fold ids, so each knows the rows of its group before it. A row's place among its group's leaves
is then a rank query against its container; leaves are never sorted.

Reduction. Leaves go to slots of keyed arrays, ``FAN`` ** ``DEPTH`` of them a key, and each array is
reduced ``DEPTH`` levels by itself; what remains goes on in the same way. On the way back every array
adds the siblings of its levels to the path of each of its slots. The groups' roots are reduced alike.

A tree node is the digest of its children's digests as hex text; a leaf that of its row's fields.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rareflag.llm.scratch import written

FAN = 3
#: levels that one keyed array is reduced by
DEPTH = 5
WIDTH = FAN ** DEPTH
#: hex digits of the leaf's digest that split the rows of one id
PREFIX = 3
_PATH = "array<struct<before:string,after:string>>"


def field(c: Column) -> Column:
    """``-`` for a null, else byte count, ``:`` and value."""
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def containers(ids: DataFrame) -> DataFrame:
    """(grp, high, base, total, words, places, ranks, extra) of (grp, id): one row for 2^16 ids.

    base: rows of the group in containers before; total: rows of the group; words: non-empty words;
    places: their numbers; ranks: different ids before each word; extra: (place of an id, rows beyond
    its first). A null id is not in any container."""
    counted = ids.where(F.col("id").isNotNull()).groupBy("grp", "id").agg(F.count("*").alias("n"))
    low = F.col("id").bitwiseAND(F.lit(0xFFFF)).cast("int")
    one = counted.select("grp", F.shiftright("id", 16).alias("high"), F.shiftright(low, 6).alias("place"),
                         F.expr("shiftleft(1L, cast(id & 63 as int))").alias("bit"), low.alias("low"), "n")
    word = one.groupBy("grp", "high", "place").agg(
        F.bit_or("bit").alias("word"), F.sum("n").alias("n"),
        F.collect_list(F.when(F.col("n") > 1, F.struct("low", (F.col("n") - 1).alias("rows")))).alias("extra"))
    box = word.groupBy("grp", "high").agg(
        F.sort_array(F.collect_list(F.struct("place", "word"))).alias("w"), F.sum("n").alias("n"),
        F.sort_array(F.flatten(F.collect_list("extra"))).alias("extra"))
    # the popcount directory, at most 1,024 words
    ranks = F.aggregate("w", F.array(F.lit(0)),
                        lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.bit_count(x["word"]))))
    box = written(box.select("grp", "high", "n", F.col("w.word").alias("words"), F.col("w.place").alias("places"),
                             ranks.alias("ranks"), "extra"), "containers")
    # rows before a container: sums over its siblings, at most 2^16 of them, at each level up
    levels = [box.select("grp", F.col("high").alias("key"), "n")]
    for _ in range(3):
        up = levels[-1].groupBy("grp", F.shiftright("key", 16).alias("key")).agg(F.sum("n").alias("n"))
        levels.append(up)
    before = levels[-1].select("grp", F.col("key").alias("up"), (F.sum("n").over(
        Window.partitionBy("grp").orderBy("key").rowsBetween(Window.unboundedPreceding, -1))).alias("base"),
        F.sum("n").over(Window.partitionBy("grp")).alias("total"))
    for level in reversed(levels[:-1]):
        up = F.shiftright("key", 16)
        own = F.sum("n").over(Window.partitionBy("grp", up).orderBy("key").rowsBetween(Window.unboundedPreceding, -1))
        before = (level.select("grp", "key", up.alias("up"), F.coalesce(own, F.lit(0)).alias("own"))
                  .join(before, ["grp", "up"])
                  .select("grp", F.col("key").alias("up"), (F.coalesce("base", F.lit(0)) + F.col("own")).alias("base"),
                          "total"))
    return box.join(before.withColumnRenamed("up", "high"), ["grp", "high"])


def rank(low: Column) -> Column:
    """Rows of the group before those of the id whose lower 16 bits are ``low``, from its container."""
    at = F.array_position("places", F.shiftright(low, 6)).cast("int")
    inside = F.bit_count(F.element_at("words", at).bitwiseAND(F.expr("~shiftleft(-1L, low & 63)")))
    extra = F.aggregate(F.filter("extra", lambda x: x["low"] < low), F.lit(0).cast("long"), lambda a, x: a + x["rows"])
    return F.col("base") + F.element_at("ranks", at) + inside + extra


def _tie_places(rows: DataFrame) -> DataFrame:
    """``rows`` with ``tie``: the place of each among the rows of one (grp, id), by leaf.

    Rows of one id are first counted by the leaf's leading digits, so that a hot id is many keys."""
    part = F.substring("leaf", 1, PREFIX)
    keys = ["grp", "id", "part"]
    rows = rows.withColumn("part", part)
    count = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("grp", "id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    count = count.select(F.col("grp").alias("_g"), F.col("id").alias("_i"), F.col("part").alias("_p"),
                         F.coalesce(before, F.lit(0)).alias("_before"))
    same = (F.col("grp") == F.col("_g")) & F.col("id").eqNullSafe(F.col("_i")) & (F.col("part") == F.col("_p"))
    own = F.row_number().over(Window.partitionBy(*keys).orderBy("leaf")) - 1
    return rows.withColumn("own", own).join(count, same).withColumn("tie", F.col("own") + F.col("_before")).drop(
        "own", "part", "_g", "_i", "_p", "_before")


def coordinates(leaves: DataFrame) -> DataFrame:
    """``leaves`` (grp, id, leaf, ...) with ``pos``, the place in its group by id, and ``total``, the
    group's leaves. Null ids come first; rows of one id are ordered by leaf."""
    boxes = containers(leaves.select("grp", "id"))
    boxes = boxes.withColumnsRenamed({"grp": "_grp", "high": "_high"})
    nulls = leaves.where(F.col("id").isNull()).groupBy("grp").agg(F.count("*").alias("n_null"))
    nulls = written(nulls, "null-ids")
    rows = leaves.where(F.col("id").isNotNull()).withColumns({
        "_high2": F.shiftright("id", 16), "low": F.col("id").bitwiseAND(F.lit(0xFFFF)).cast("int")})
    rows = rows.join(boxes, (F.col("grp") == F.col("_grp")) & (F.col("_high2") == F.col("_high")))
    several = F.exists("extra", lambda x: x["low"] == F.col("low"))
    placed = rows.select(*leaves.columns, rank(F.col("low")).alias("pos"), "total", several.alias("several"))
    if not nulls.isEmpty() or not boxes.where(F.size("extra") > 0).isEmpty():
        placed = written(placed, "placed")
        tied = _tie_places(placed.where("several")).withColumn("pos", F.col("pos") + F.col("tie")).drop("tie")
        placed = placed.where("not several").unionByName(tied).drop("several")
        none = _tie_places(leaves.where(F.col("id").isNull())).withColumnRenamed("tie", "pos")
        sizes = boxes.select(F.col("_grp").alias("grp"), "total").distinct()
        none = none.join(sizes, "grp", "left").withColumn("total", F.coalesce("total", F.lit(0)))
        both = placed.withColumn("shift", F.lit(True)).unionByName(none.withColumn("shift", F.lit(False)))
        both = both.join(nulls, "grp", "left").withColumn("n_null", F.coalesce("n_null", F.lit(0)))
        return both.select(*leaves.columns, (F.col("pos") + F.when(F.col("shift"), F.col("n_null")).otherwise(0)).alias(
            "pos"), (F.col("total") + F.col("n_null")).alias("total"))
    return placed.drop("several")


def levels_of(total: Column) -> Column:
    """Levels above ``total`` leaves: until one node remains."""
    out = F.lit(0)
    for k in range(40):  # 3 ** 39 is the last power below 2 ** 63
        if FAN ** k < 1 << 62:
            out = out + F.when(total > FAN ** k, 1).otherwise(0)
    return out


class Tree(NamedTuple):
    roots: DataFrame  # grp, root
    rounds: list[DataFrame]  # of arrays: grp, key, slots (struct of hash and what is carried), left, tops


def _parents(level: Column) -> Column:
    """The digests of every ``FAN`` nodes in a row; the last run may be shorter."""
    runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(level, i * FAN + 1, F.lit(FAN)), ""), 256))


def _reduced(nodes: DataFrame, carry: Sequence[str]) -> DataFrame:
    """Keyed slot arrays: (grp, key, left, slots, lev0 .. levDEPTH): lev0 the slots' hashes, then node by node up
    as far as ``left`` levels allow."""
    key = F.floor(F.col("pos") / WIDTH).cast("long")
    out = nodes.groupBy("grp", key.alias("key"), "left").agg(
        F.sort_array(F.collect_list(F.struct("pos", "hash", *carry))).alias("slots"))
    out = out.withColumn("lev0", F.col("slots.hash"))
    for k in range(1, DEPTH + 1):
        out = out.withColumn(f"lev{k}", F.when(F.col("left") >= k, _parents(F.col(f"lev{k - 1}"))))
    return out


def reduce_tree(leaves: DataFrame, carry: Sequence[str] = ()) -> Tree:
    """Trees of (grp, pos, total, hash, *carry) over each grp."""
    nodes = leaves.select("grp", "pos", "hash", levels_of(F.col("total")).alias("left"), *carry)
    rounds, roots = [], None
    while True:
        arrays = written(_reduced(nodes, carry if not rounds else ()), f"slots-{len(rounds)}")
        rounds.append(arrays)
        top = F.element_at(F.coalesce(*(F.col(f"lev{k}") for k in range(DEPTH, -1, -1))), 1)
        done = arrays.where(F.col("left") <= DEPTH).select("grp", top.alias("root"))
        roots = done if roots is None else roots.unionByName(done)
        nodes = arrays.where(F.col("left") > DEPTH).select(
            "grp", F.col("key").alias("pos"), top.alias("hash"), (F.col("left") - DEPTH).alias("left"))
        if nodes.isEmpty():
            return Tree(roots, rounds)


def paths(tree: Tree, above: DataFrame, carry: Sequence[str]) -> DataFrame:
    """(grp, pos, hash, *carry, path, *rest of ``above``) of every leaf; ``above`` holds grp and ``path``
    of each root to the root of roots. A path holds, level by level, the siblings before and after."""
    rest = [c for c in above.columns if c not in ("grp", "path")]
    upper = None
    for n, arrays in reversed(list(enumerate(tree.rounds))):
        ends = arrays.where(F.col("left") <= DEPTH).join(above, "grp")
        if upper is None:
            joined = ends
        else:
            go_on = arrays.where(F.col("left") > DEPTH).join(upper, ["grp", "key"])
            joined = ends.unionByName(go_on)
        levels = F.least(F.col("left"), F.lit(DEPTH))

        def siblings(i: Column) -> Column:
            steps = []
            for k in range(DEPTH):
                own = F.floor(i / FAN ** k).cast("int")
                first = F.floor(i / FAN ** (k + 1)).cast("int") * FAN
                lev = F.col(f"lev{k}")
                steps.append(F.struct(
                    F.array_join(F.slice(lev, first + 1, own - first), "").alias("before"),
                    F.array_join(F.slice(lev, own + 2, first + FAN - 1 - own), "").alias("after")))
            return F.slice(F.array(*steps), F.lit(1), levels)

        each = F.transform("slots", lambda x, i: F.struct(x.alias("slot"), siblings(i).alias("own")))
        out = joined.select("grp", F.explode(each).alias("e"), "path", *rest)
        kept = ["hash", *carry] if n == 0 else []
        out = out.select("grp", "e.slot.pos", *(f"e.slot.{c}" for c in kept), F.concat("e.own", "path").alias("path"),
                         *rest)
        upper = out.withColumnRenamed("pos", "key")
    return out


def ranked_groups(groups: DataFrame) -> DataFrame:
    """(grp, root) with pos in bytewise order of grp and total: sorted in ranges, each counted by itself."""
    rows = written(groups.repartitionByRange("grp").sortWithinPartitions("grp").select(
        "grp", "root", F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("own")), "groups")
    sizes = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one a partition
    first, sum_ = [], 0
    for p in sorted(sizes):
        first += [F.lit(p), F.lit(sum_)]
        sum_ += sizes[p]
    if not first:
        return rows.select(F.lit("").alias("all"), "grp", "root", F.lit(0).cast("long").alias("pos"),
                           F.lit(0).cast("long").alias("total"))
    base = F.element_at(F.create_map(*first), F.col("part")).cast("long")
    return rows.select(F.lit("").alias("all"), "grp", "root", (F.col("own") + base).alias("pos"),
                       F.lit(sum_).cast("long").alias("total"))


def fold(leaf: Column, path: str = "path") -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, x: F.sha2(F.concat(x["before"], h, x["after"]), 256))


def proof_digest(path: str = "path") -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), ""), 256)


def manifest(rows: DataFrame, fields: Sequence[str], group: str, key: str, carry: Sequence[str] = ()) -> DataFrame:
    """key, leaf, path, subroot, root, *carry of every row.

    ``fields`` make the leaf, ``group`` the subtree, ``key`` (long) the order in it. A null group is a
    group of its own, before all others; a null key comes before all others in its group; rows of one
    key are ordered by leaf, equal rows get neighbouring places. Texts may have any length; an empty
    table gives an empty result."""
    grp = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), F.col(group).cast("string")))
    # names of the caller's columns never meet the names used here
    carried = [F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]
    inner = [f"c{i}" for i in range(len(carry))]
    leaves = written(rows.select(grp.alias("grp"), F.col(key).cast("long").alias("id"),
                                 digest(*(field(F.col(c)) for c in fields)).alias("leaf"), *carried), "leaves")
    placed = coordinates(leaves).withColumn("hash", F.col("leaf")).select(
        "grp", "pos", "total", "hash", "id", *inner)
    tree = reduce_tree(placed, ["id", *inner])
    groups = ranked_groups(tree.roots)
    top = reduce_tree(groups.select(F.col("all").alias("grp"), "pos", "total", F.col("root").alias("hash"),
                                    F.col("grp").alias("id")), ["id"])
    start = top.roots.select("grp", F.col("root").alias("all_root"), F.array().cast(_PATH).alias("path"))
    above = paths(top, start, ["id"]).select(F.col("id").alias("grp"), "path", F.col("hash").alias("subroot"),
                                             F.col("all_root").alias("root"))
    out = paths(tree, written(above, "group-paths"), ["id", *inner])
    return out.select(F.col("id").alias(key), F.col("hash").alias("leaf"), "path", "subroot", "root",
                      *(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)))

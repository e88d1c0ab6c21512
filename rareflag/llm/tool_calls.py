"""Tool calls and results of conversations: link, order, validate, serialise.

All steps are DataFrame operations.

* Calls and results meet in a shuffled hash join by identifier; results are first
  reduced to one row an identifier, which is the build side.
* A call names the calls it depends on. Where every dependency of a conversation
  stands earlier in it, positions are a topological order already. Other
  conversations are ordered in rounds: those calls get level r whose open
  dependencies all got a lower one; what is left after the last round is a cycle.
* Arguments are validated against schema rows (tool, param, type, required,
  minimum, maximum) with higher-order functions; the schemas join by tool name and a
  salt, so a tool with most of the calls is no hot key.
* Each call becomes canonical JSON: keys sorted at every level, no white space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rareflag.llm.scratch import written

SALTS = 32


def _salted(n: int = SALTS) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def _errors() -> Column:
    """Sorted errors of the columns args (map<string,variant>), schema (array of parameters), known (of the tool)."""
    def kind(p: Column) -> Column:
        return F.schema_of_variant(F.col("args")[p["param"]])

    def number(p: Column) -> Column:
        return F.try_variant_get(F.col("args")[p["param"]], "$", "double")

    def fits(p: Column) -> Column:
        k = kind(p)
        whole = k == "BIGINT"
        return (F.when(p["type"] == "integer", whole).when(p["type"] == "number", whole | k.rlike("^(DECIMAL|DOUBLE)"))
                .when(p["type"] == "string", k == "STRING").when(p["type"] == "boolean", k == "BOOLEAN")
                .when(p["type"] == "array", k.startswith("ARRAY")).when(p["type"] == "object", k.startswith("OBJECT"))
                .otherwise(F.lit(True)))

    has = lambda p: F.map_contains_key("args", p["param"])
    given = F.filter("schema", has)
    wrong = F.filter(given, lambda p: ~fits(p))
    off = F.filter(given, lambda p: fits(p) & p["type"].isin("integer", "number") &
                   ((number(p) < p["minimum"]) | (number(p) > p["maximum"])))
    missing = F.filter("schema", lambda p: p["required"] & ~has(p))
    unknown = F.filter(F.map_keys("args"), lambda k: ~F.exists("schema", lambda p: p["param"] == k))
    say = lambda word, of: F.transform(of, lambda p: F.concat(F.lit(f"{word}:"), p["param"]))
    return F.when(~F.col("known"), F.array(F.lit("unknown tool"))).when(
        F.col("args").isNull() | F.col("canonical").isNull(), F.array(F.lit("invalid arguments"))).otherwise(
        F.array_sort(F.concat(say("missing", missing), F.transform(unknown, lambda k: F.concat(F.lit("unknown:"), k)),
                              say("type", wrong), say("range", off))))


def validated(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """``calls`` (uid, name, arguments) with canonical arguments (variant) and errors."""
    per = schemas.groupBy("tool").agg(F.array_sort(F.collect_list(F.struct(
        "param", "type", "required", "minimum", "maximum"))).alias("schema")).withColumn("salt", _salted())
    left = calls.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(SALTS))).withColumn(
        "tool", F.coalesce("name", F.lit("")))
    out = left.join(per, ["tool", "salt"], "left").withColumn("known", F.col("schema").isNotNull()).withColumn(
        "args", F.from_json("arguments", "map<string,variant>")).withColumn(
        "canonical", F.try_parse_json("arguments"))
    return out.withColumn("errors", _errors()).drop("salt", "tool", "known", "schema", "args")


def ordered(calls: DataFrame) -> DataFrame:
    """(uid, level, order_errors) of calls (uid, conv_id, call_id, pos, after).

    Levels rise along every dependency within a conversation. A dependency on no call of the
    conversation is reported and not counted; a call in or behind a cycle has a null level."""
    head = calls.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.max("pos").alias("ppos"))
    edges = calls.select("uid", "conv_id", "call_id", "pos", F.explode(F.array_distinct("after")).alias("parent"))
    edges = written(edges.join(head.withColumnRenamed("call_id", "parent"), ["conv_id", "parent"], "left"), "edges")
    lost = edges.where("ppos is null").groupBy("uid").agg(F.array_sort(F.collect_list(
        F.concat(F.lit("unknown dependency:"), F.col("parent")))).alias("order_errors"))
    back = edges.where("ppos >= pos").select("conv_id").distinct()
    none = F.array().cast("array<string>")
    base = calls.select("uid", "conv_id", "pos").join(lost, "uid", "left").withColumn(
        "order_errors", F.coalesce("order_errors", none))
    plain = base.select("uid", F.col("pos").cast("long").alias("level"), "order_errors")
    back = written(back, "unordered")
    if back.isEmpty():
        return plain
    todo = written(base.join(back, "conv_id", "left_semi").join(
        edges.where("ppos is not null").groupBy("uid").agg(F.collect_set("parent").alias("parents")), "uid", "left")
        .join(calls.select("uid", "call_id"), "uid")
        .select("uid", "conv_id", "call_id", F.coalesce("parents", none).alias("parents")), "todo")
    done, level = None, 0
    while True:
        open_ = todo.select("conv_id", F.col("call_id").alias("parent")).distinct()
        stuck = todo.select("uid", "conv_id", F.explode("parents").alias("parent")).join(
            open_, ["conv_id", "parent"], "left_semi").select("uid").distinct()
        ready = written(todo.join(stuck, "uid", "left_anti").select("uid", F.lit(level).cast("long").alias("level")),
                        "ready")
        if ready.isEmpty():
            break
        done = ready if done is None else done.union(ready)
        todo = written(todo.join(ready, "uid", "left_anti"), "todo")
        level += 1
    levels = todo.select("uid", F.lit(None).cast("long").alias("level"))
    levels = levels if done is None else levels.union(done)
    rounds = base.join(back, "conv_id", "left_semi").join(levels, "uid").select("uid", "level", F.when(
        F.col("level").isNull(), F.concat("order_errors", F.array(F.lit("cycle")))).otherwise(F.col("order_errors"))
        .alias("order_errors"))
    same = base["conv_id"].eqNullSafe(back["conv_id"])
    return base.join(back, same, "left_anti").select("uid", F.col("pos").cast("long").alias("level"),
                                                     "order_errors").union(rounds)


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call, and one per identifier that only results have.

    calls: conv_id, call_id, pos, name, arguments (JSON text), after (array of call ids);
    results: call_id, content. Returns conv_id, call_id, pos, name, level, n_results, status
    (ok, invalid, no result, orphan result), errors, json (canonical).

    A null call_id matches nothing; of several results the smallest content counts, n_results
    tells how many; a null content is an empty one. Calls that repeat an identifier each get the
    result. Null or malformed arguments are ``invalid arguments``, a null name is an unknown tool,
    a null position the first. Empty tables give empty results.
    """
    calls = written(calls.select(
        F.monotonically_increasing_id().alias("uid"), "conv_id", "call_id",
        F.coalesce(F.col("pos").cast("long"), F.lit(-1)).alias("pos"), "name", "arguments",
        F.coalesce("after", F.array().cast("array<string>")).alias("after")), "calls")
    one = results.where("call_id is not null").groupBy("call_id").agg(
        F.min(F.coalesce("content", F.lit(""))).alias("content"), F.count("*").alias("n_results"))
    key = F.coalesce("call_id", F.concat(F.lit("\x00"), F.col("uid").cast("string")))  # null keys stay apart
    linked = calls.withColumn("key", key).join(one.withColumnRenamed("call_id", "key").hint("shuffle_hash"), "key",
                                               "left").drop("key")
    rows = validated(linked, schemas).join(ordered(calls), "uid").withColumn(
        "errors", F.concat("errors", "order_errors"))
    status = F.when(F.size("errors") > 0, "invalid").when(F.col("n_results").isNull(), "no result").otherwise("ok")
    body = F.to_json(F.struct(
        F.col("canonical").alias("arguments"), F.array_sort("after").alias("depends_on"), F.col("call_id").alias("id"),
        F.col("name"), F.col("content").alias("result")))
    rows = rows.select("conv_id", "call_id", "pos", "name", "level", F.coalesce("n_results", F.lit(0)).alias(
        "n_results"), status.alias("status"), "errors", body.alias("json"))
    lone = one.join(calls.select("call_id").distinct(), "call_id", "left_anti").select(
        F.lit(None).cast(rows.schema["conv_id"].dataType).alias("conv_id"), "call_id",
        F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("long").alias("level"), "n_results", F.lit("orphan result").alias("status"),
        F.array().cast("array<string>").alias("errors"),
        F.to_json(F.struct(F.col("call_id").alias("id"), F.col("content").alias("result"))).alias("json"))
    return rows.union(lone)


#: tools of the registered query; fixed values, repeated in its SQL
SCHEMAS = [
    ("search", "query", "string", True, None, None),
    ("search", "limit", "integer", False, 1.0, 40.0),
    ("lookup", "key", "string", True, None, None),
    ("lookup", "strict", "boolean", False, None, None),
    ("translate", "text", "string", True, None, None),
    ("translate", "target", "string", True, None, None),
]


def schema_table(spark) -> DataFrame:
    return spark.createDataFrame(SCHEMAS, "tool string, param string, type string, required boolean, minimum double, "
                                          "maximum double")


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read from conversation turns.

    A user turn is a call, named by its length; the assistant turn after it is its result; a call
    depends on the user turn two places before. The arguments are JSON with a limit, a flag, a
    target or none of them, and at times a parameter that the tool does not have."""
    n = F.coalesce(F.length("text"), F.lit(0))
    own = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    before = lambda k: F.concat_ws(":", F.col("conv_id").cast("string"),
                                   (F.col("turn") - k).cast("string"))
    text = F.coalesce("text", F.lit(""))
    # null fields are left out of the JSON
    arguments = (F.when(n % 3 == 0, F.to_json(F.struct(text.alias("query"), (n % 50).alias("limit"))))
                 .when(n % 3 == 1, F.to_json(F.struct((n % 2 == 0).alias("strict"), F.when(n % 5 > 0, text).alias("key"),
                                                      F.when(n % 7 == 0, F.lit(1)).alias("verbose"))))
                 .otherwise(F.to_json(F.struct(F.when(n % 4 > 0, F.lit("en")).alias("target"), text.alias("text")))))
    name = F.when(n % 3 == 0, "search").when(n % 3 == 1, "lookup").otherwise("translate")
    calls = turns.where("role = 'user'").select(
        F.col("conv_id").cast("long").alias("conv_id"), own.alias("call_id"), F.col("turn").cast("long").alias("pos"),
        name.alias("name"), arguments.alias("arguments"),
        F.when(F.col("turn") >= 2, F.array(before(2))).otherwise(F.array().cast("array<string>")).alias("after"))
    results = turns.where("role = 'assistant'").select(before(1).alias("call_id"), F.col("text").alias("content"))
    return calls, results

"""Licence scans: sparse TF-IDF cosine to templates, then inheritance along directories.

All steps are DataFrame operations.

* Every line of every file is a unit, so is every block (a run of two or more non-blank
  lines, which is how headers are wrapped) and the whole text of a licence file (by its name).
* A unit is a sparse vector over its words: count times ln(1 + N / df), with N and df over all
  units; words of no template weigh as much as the rarest. Document frequencies come from one
  pass that counts only words of templates, before the shuffle.
* Units meet templates by an equi-join on the words and the products are summed by (unit,
  template). Which units can reach ``least`` is decided by a prefix filter: by Cauchy-Schwarz a
  unit with none of a template's heaviest words, the others of which have a norm below ``least``
  times the template's, stays below ``least``. The filter loses nothing; only units that pass it
  have their words shuffled.
* The templates are an argument of the driver; more than ``MAX_WORDS`` distinct words in them
  are an error, so that their tables may be broadcast.
* A file's licence is the best template with a cosine of ``MIN_COSINE`` or more. Files
  without one inherit from the nearest ancestor directory with a licence file: the
  distinct directories are exploded into their ancestors and joined by path with the
  licensed directories, and files join their own directory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rareflag.llm.scratch import written

MIN_COSINE = 0.5
SALTS = 16
#: distinct words of all templates together
MAX_WORDS = 50_000
#: cosines are rounded to six places; the prefix filter allows for that
ROUNDING = 1e-5
#: what lies between two blocks
BLANK = r"\n(?:[ \t\r]*\n)+"
NO_WORD = "[^a-z0-9]+"
LICENCE_FILE = r"^(license|licence|copying|unlicense|notice)(\.[a-z]+)?$"

#: fixed values: short notices of common licences
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
                   "compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted; "
                     "BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("ISC", "Released under the ISC License."),
    ("Proprietary", "All rights reserved."),
]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), NO_WORD), "")


def units(files: DataFrame) -> DataFrame:
    """(rid, unit, words) of the units with a word: lines from 1, blocks from -1 down, whole licence files 0."""
    def unit(at: Column, body: Column) -> Column:
        return F.struct(at.cast("int").alias("unit"), _words(body).alias("words"))

    lines = F.transform(F.split("text", "\n"), lambda body, i: unit(i + 1, body))
    blocks = F.transform(F.split("text", BLANK), lambda body, i: F.struct((-1 - i).alias("at"), F.trim(
        body, F.lit("\n")).alias("body")))
    blocks = F.transform(F.filter(blocks, lambda u: F.contains(u["body"], F.lit("\n"))), lambda u: unit(
        u["at"], u["body"]))
    none = F.array().cast("array<struct<unit:int,words:array<string>>>")
    whole = F.when(F.col("is_licence"), F.array(unit(F.lit(0), F.col("text")))).otherwise(none)
    # words are made inside the exploded value, once a pass, whatever filters follow
    out = files.select("rid", F.explode(F.concat(lines, blocks, whole)).alias("u"))
    return out.select("rid", "u.unit", "u.words").where(F.size("words") > 0)


def template_weights(body: DataFrame, templates: list[tuple[str, str]]) -> tuple[DataFrame, int]:
    """((template, word, tw, idf, tnorm), number of units) with document frequencies over the units ``body``."""
    spark = body.sparkSession
    given = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(templates)], "template int, body string")
    vocab = given.select("template", F.explode(_words(F.col("body"))).alias("word")).groupBy("template", "word").agg(
        F.count("*").alias("tf"))
    vocab = written(vocab, "template-words")
    known = vocab.select("word").distinct()
    if known.count() > MAX_WORDS:
        raise ValueError(f"the templates have more than {MAX_WORDS} distinct words")
    # the empty word stands once in each unit: its frequency is the number of units
    every = known.union(spark.createDataFrame([("",)], "word string"))
    seen = body.select(F.explode(F.concat(F.array(F.lit("")), F.array_distinct("words"))).alias("word"))
    df = written(seen.join(F.broadcast(every), "word").groupBy("word").agg(F.count("*").alias("df")), "frequencies")
    total = next((r.df for r in df.where("word = ''").collect()), 0)
    weights = vocab.join(df, "word", "left").withColumn("idf", F.log(1 + F.lit(total) / F.coalesce("df", F.lit(1))))
    weights = weights.select("template", "word", (F.col("tf") * F.col("idf")).alias("tw"), "idf")
    norms = weights.groupBy("template").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tnorm"))
    return written(weights.join(norms, "template"), "template-weights"), total


def prefix_words(weights: DataFrame, least: float) -> list[str]:
    """The words one of which a unit must hold to reach ``least`` with some template."""
    lighter = Window.partitionBy("template").orderBy(F.col("tw"), F.col("word"))
    rest = F.sqrt(F.sum(F.col("tw") * F.col("tw")).over(lighter))
    heavy = weights.withColumn("rest", rest).where(F.col("rest") >= (least - ROUNDING) * F.col("tnorm"))
    return sorted(r.word for r in heavy.select("word").distinct().collect())


def cosines(body: DataFrame, templates: list[tuple[str, str]], least: float) -> DataFrame:
    """(rid, unit, template, cosine), all pairs of ``least`` or more among them."""
    weights, total = template_weights(body, templates)
    heavy = prefix_words(weights, least)
    # one literal, whatever the number of words; words hold no space
    some = F.arrays_overlap("words", F.split(F.lit(" ".join(heavy)), " "))
    tf = body.where(some).select("rid", "unit", F.explode("words").alias("word")).groupBy("rid", "unit", "word").agg(
        F.count("*").alias("tf"))
    tf = written(tf, "unit-words")
    own = tf.join(F.broadcast(weights.select("word", "idf").distinct()), "word", "left")
    w = F.col("tf") * F.coalesce(F.col("idf"), F.log(F.lit(1.0 + total)))
    norm = own.groupBy("rid", "unit").agg(F.sqrt(F.sum(w * w)).alias("norm"))
    dot = tf.join(F.broadcast(weights), "word").groupBy("rid", "unit", "template").agg(
        F.sum(F.col("tf") * F.col("idf") * F.col("tw")).alias("dot"), F.first("tnorm").alias("tnorm"))
    return dot.join(norm, ["rid", "unit"]).select("rid", "unit", "template", F.round(
        F.col("dot") / (F.col("norm") * F.col("tnorm")), 6).alias("cosine"))


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ancestors(folder: Column) -> Column:
    """The folder itself, then each folder above it, at last the root ''."""
    parts = F.split(folder, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(
        parts, F.lit(1), F.size(parts) - i), "/"))


def scan(files: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = MIN_COSINE,
         carry: tuple[str, ...] = ()) -> DataFrame:
    """Licence of every file row (columns path, text).

    Returns the columns ``carry``, path, license, cosine, how (own, inherited, none), from_dir
    (of an inherited licence). Of equal cosines the template first in the list counts, of
    several licence files in a folder the best one, then the first by path. A null text has no
    licence of its own, a null path is a file in the root; repeated rows get equal answers; an
    empty table gives an empty result; columns not in ``carry`` are left out.
    """
    templates = TEMPLATES if templates is None else templates
    path = F.coalesce("path", F.lit(""))
    folder = _parent(path)
    name = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    kept = F.struct(F.lit(0).alias("_"), *[F.col(c) for c in carry]).alias("kept")
    # a row's key is its content, so every pass may read the table anew; repeated rows share one
    # answer, as a multiple of a vector has the same cosines
    rid = F.md5(F.concat_ws("\x00", path, "text")).alias("rid")
    marks = files.select(rid, kept, F.col("path"), folder.alias("dir"), name.rlike(LICENCE_FILE).alias("is_licence"),
                         F.col("text"))
    found = cosines(units(marks.where("text is not null")), templates, least).where(F.col("cosine") >= least)
    best = found.groupBy("rid").agg(F.max(F.struct("cosine", (-F.col("template")).alias("rank"))).alias("b"))
    ids = F.element_at(F.array(*[F.lit(t) for t, _ in templates]), (1 - F.col("b.rank")).cast("int"))
    best = written(best.select("rid", F.col("b.cosine").alias("cosine"), ids.alias("own")), "own-licences")

    there = marks.where("is_licence").select("rid", "path", "dir").join(best, "rid").groupBy("dir").agg(
        F.min_by("own", F.struct(-F.col("cosine"), "path", "rid")).alias("licence")).withColumnRenamed("dir", "above")
    dirs = marks.select("dir").distinct()
    near = dirs.select("dir", F.explode(ancestors(F.col("dir"))).alias("above")).join(there, "above").groupBy(
        "dir").agg(F.max_by(F.struct("licence", "above"), F.length("above")).alias("near"))
    salt = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    near = near.select("dir", "near.*", salt.alias("salt"))
    rows = marks.select("rid", "kept", "path", "dir").join(best, "rid", "left").withColumn(
        "salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)))
    out = rows.join(near, ["dir", "salt"], "left")
    return out.select(
        *[F.col(f"kept.{c}") for c in carry], "path", F.coalesce("own", "licence").alias("license"), "cosine",
        F.when(F.col("own").isNotNull(), "own").when(F.col("licence").isNotNull(), "inherited").otherwise("none").alias(
            "how"), F.when(F.col("own").isNull(), F.col("above")).alias("from_dir"))


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as files: a folder for each source, in it one for 1,000 ids, in it one for 50 ids.

    The first file of each folder is its licence file."""
    d = F.col("doc_id").cast("long")
    num = lambda x: F.floor(x).cast("long").cast("string")
    src = F.coalesce("source", F.lit("none"))
    path = F.when(d % 1000 == 0, F.concat_ws("/", src, F.lit("LICENSE"))).when(
        d % 50 == 0, F.concat_ws("/", src, num(d / 1000), F.lit("LICENSE"))).otherwise(
        F.concat_ws("/", src, num(d / 1000), num(d / 50), F.concat(F.lit("f"), d.cast("string"), F.lit(".txt"))))
    return docs.select(d.alias("doc_id"), path.alias("path"), "text")

"""Corpus pipeline: documents -> language ID -> quality -> near-dedup -> decontamination -> tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but
the last return the columns of documents. The runner writes each stage's result as Parquet and
hands the reread table to the next.

* language_id: documents without a language (null text or no letter) go.
* quality: documents whose probability of the best grade is below one half go (junk, toxic).
* near_dedup: one document of each class of near copies stays, the one of the smallest id.
* decontaminate: documents that share a window with a benchmark item go.
* tokenize: ids and decoded text of what is left, with their digests.

A null in any other column is carried as it is; extra columns are not part of documents and are
dropped at the first stage; an empty table runs through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rareflag.llm import bpe_tree, ecoc_langid, oddsketch, ordinal, winnow
from rareflag.llm.scratch import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: five-word shingles, similarity 0.8
SHINGLE, JACCARD = 5, 0.8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a language: ``und`` goes. An ambiguous codeword is no rejection: short clean texts may have one."""
    model = ecoc_langid.fit(docs.where(~ecoc_langid.held_out()))
    out = ecoc_langid.identify(docs.select(*COLUMNS), model, COLUMNS)
    return out.where(F.col("lang_pred") != ecoc_langid.UNDETERMINED).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose best grade is likelier than not."""
    model = ordinal.fit(docs, table(spark, sf_dir, "labels"))
    return ordinal.grade(docs.select(*COLUMNS), model, COLUMNS).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies; of repeated rows one."""
    rows = docs.select(*COLUMNS).withColumn("_th", F.xxhash64("text"))
    out = oddsketch.near_duplicates(rows, size=SHINGLE, jaccard=JACCARD)
    one = out.groupBy("class_id").agg(F.min(F.struct("doc_id", "th")).alias("k")).select("class_id", "k.*")
    # the kept (doc_id, text); several rows may equal it
    one = one.select(F.col("class_id").alias("_class"), F.col("doc_id").alias("_id"), F.col("th").alias("_kth"))
    same = (F.col("class_id") == F.col("_class")) & (F.col("th") == F.col("_kth")) & F.col("doc_id").eqNullSafe(
        F.col("_id"))
    keep = out.join(one, same).groupBy("_id", "_kth").agg(F.count("*").alias("_rows"))
    kept = rows.join(keep, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_kth")))
    kept = written(kept.select(*COLUMNS, "_rows"), "kept")
    return kept.where("_rows = 1").select(*COLUMNS).union(
        kept.where("_rows > 1").select(*COLUMNS).dropDuplicates(["doc_id", "text"]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a shared benchmark window."""
    found = winnow.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    hit = found.where("contaminated").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_th"))
    return docs.select(*COLUMNS).join(hit, same, "left_anti")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    return bpe_tree.digests(bpe_tree.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("language_id", language_id), ("quality", quality), ("near_dedup", near_dedup),
          ("decontaminate", decontaminate), ("tokenize", tokenize)]

#: learned stages have no SQL; tests hold the pipeline against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

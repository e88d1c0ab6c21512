"""The registered queries ``opN_<name>``: each applies its operator, with production
parameters, to the whole given table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rareflag.llm import (
    bpe_tree,
    ecoc_langid,
    licenses,
    line_crf,
    merkle,
    oddsketch,
    ordinal,
    pivot_means,
    site_style,
    suffix_dedup,
    tool_calls,
    unigram_count,
    winnow,
)
from rareflag.llm.scratch import table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = oddsketch.near_duplicates(table(spark, sf_dir, "documents"), size=2, jaccard=0.8)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(licenses.as_files(table(spark, sf_dir, "documents")), carry=("doc_id",))


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_crf.quality(docs, line_crf.fit(docs, table(spark, sf_dir, "labels")))


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.from_turns(table(spark, sf_dir, "conversations"))
    out = tool_calls.link(calls, results, tool_calls.schema_table(spark))
    return out.withColumn("errors", F.array_join("errors", ","))


def op5_site_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = site_style.main_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_tree.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return bpe_tree.digests(out)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = winnow.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ecoc_langid.language_id(table(spark, sf_dir, "documents"))


def op10_quality_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal.quality_grade(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pivot_means.cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64)
    return out.drop("exact_checks")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), span=50)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    cut = docs.withColumn("tampered", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, merkle.digest(
        *(merkle.field(F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c)) for c in fields))))
    out = merkle.manifest(cut, fields, "source", "doc_id", carry=("tampered",))
    out = out.withColumn("folded_root", merkle.fold(F.coalesce("tampered", "leaf")))
    return out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest().alias("proof_sha256"), "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2:3].isdigit()}

"""Written intermediate tables: a lineage cut that survives lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rareflag.session import scratch_path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the folder of ``spark.checkpoint.dir`` and reread it.

    The file schema is given, so rereading starts no job."""
    spark: SparkSession = df.sparkSession
    path = scratch_path(spark, f"llm/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

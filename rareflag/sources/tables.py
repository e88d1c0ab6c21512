"""Table scans.

Every scan goes through ``spark.read`` so Catalyst prunes columns and pushes
filters into the parquet reader; callers name the columns they need.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


#: comparison of a column and a value
Comparison = tuple[str, str, object]


def _compared(where: Sequence[Comparison]) -> Column:
    out = F.lit(True)
    for name, op, value in where:
        if op not in ("<", "<=", "=", ">=", ">") or value is None:
            raise ValueError(f"not a comparison with a value: {name} {op} {value!r}")
        c, v = F.col(f"`{name}`"), F.lit(value)
        out = out & {"<": c < v, "<=": c <= v, "=": c == v, ">=": c >= v, ">": c > v}[op]
    return out


def scanned(df: DataFrame, where: Sequence[Comparison] = ()) -> DataFrame:
    """NaN made NULL, after and before the comparisons ``where``: they reach the parquet reader.

    A filter on the result cannot pass the NaN rule of a float column. A comparison drops NULL, so
    applying it to the raw column first drops no row that it would keep afterwards; NaN, which is
    above every number in the raw column, goes at the second one."""
    if not where:
        return nan_to_null(df)
    return nan_to_null(df.where(_compared(where))).where(_compared(where))


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None,
               where: Sequence[Comparison] = ()) -> DataFrame:
    """Scan one driver table, NaN made NULL; ``columns`` prunes the parquet read, ``where`` its row groups."""
    df = scanned(spark.read.parquet(table_path(sf_dir, name)), where)
    return df.select(*columns) if columns else df


def nan_to_null(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """NaN → NULL once, at the source (pandas ``isna`` treats both alike).

    An infinite value raises an error when its column is read.
    """
    cols = set(columns) if columns is not None else None
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and (cols is None or f.name in cols):
            c = F.col(f"`{f.name}`")
            error = F.raise_error(F.lit(f"infinite value in column {f.name}")).cast(f.dataType)
            out.append(F.when(F.isnan(c), F.lit(None)).when(F.abs(c) == float("inf"), error).otherwise(c).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def read_parquet(spark: SparkSession, *paths: str, schema: T.StructType | None = None,
                 with_source: bool = False, where: Sequence[Comparison] = ()) -> DataFrame:
    """Parquet scan of one or several files (S1, S3), NaN made NULL; ``where`` reaches the reader.

    ``with_source`` adds the file each row came from, for stacked inputs.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(*paths)
    if with_source:
        df = df.withColumn("source_file", F.input_file_name())
    return scanned(df, where)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV scan with a header (S4). Pass ``schema`` in production; inference
    costs an extra pass over the file."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def head(df: DataFrame, n: int, order_by: str | Column = "id") -> DataFrame:
    """First ``n`` rows in id order (S2, T2, P15). ``.loc[:n]`` is end-inclusive,
    so callers mirroring it pass ``n + 1``."""
    return df.orderBy(order_by).limit(n)


def stack_tables(frames: dict[str, DataFrame], source_col: str = "source") -> DataFrame:
    """Stack several inputs (faint + bright sets) with a source column."""
    out = None
    for name, df in frames.items():
        df = df.withColumn(source_col, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out

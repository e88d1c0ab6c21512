"""Portable randomness.

Every "random" choice (split, folds, SMOTE base rows, neighbour ranks,
interpolation weights, landmark draws) is a hash of ``seed:parts``; the first
8 hex digits of the md5 as an unsigned 32-bit integer. The same value is
produced by the DuckDB oracle, does not depend on partitioning, and survives
task retries (recomputation gives the same value).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296.0


def _key(seed, parts) -> Column:
    items = [F.lit(str(seed))]
    for p in parts:
        items.append(F.lit(":"))
        items.append(p.cast("string") if isinstance(p, Column) else F.lit(str(p)))
    return F.concat(*items)


def hash_u32(seed, *parts) -> Column:
    """Unsigned 32-bit integer from md5(seed:part:part...)."""
    return F.conv(F.substring(F.md5(_key(seed, parts)), 1, 8), 16, 10).cast("bigint")


def hash_unit(seed, *parts) -> Column:
    """Uniform in [0, 1) from the same hash."""
    return hash_u32(seed, *parts) / F.lit(TWO32)


def _sql_key(seed, parts: tuple[str, ...]) -> str:
    inner = f"'{seed}'"
    for p in parts:
        inner += f", ':', cast({p} as varchar)"
    return f"concat({inner})"


def hash_u32_sql(seed, *parts: str) -> str:
    """DuckDB form of :func:`hash_u32`; ``parts`` are SQL expressions."""
    return f"cast(('0x' || substr(md5({_sql_key(seed, parts)}), 1, 8)) as bigint)"


def hash_unit_sql(seed, *parts: str) -> str:
    return f"({hash_u32_sql(seed, *parts)} / {TWO32})"

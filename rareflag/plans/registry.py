"""Query registry used by ``__spark_entry__``: name → (spark, sf_dir) -> DataFrame,
and name → DuckDB oracle SQL (absent for learned / iterative operators)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rareflag.plans import queries as Q


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {}
    for mod in _modules():
        for name in dir(mod):
            if name.startswith("q_"):
                out[name[2:]] = getattr(mod, name)
    return out


def _modules():
    mods = [Q]
    from rareflag.plans import model_queries, stream_queries
    mods += [model_queries, stream_queries]
    return mods


def oracle_sql() -> dict[str, str]:
    from rareflag.plans.oracles import ORACLES
    q = queries()
    return {k: v for k, v in ORACLES.items() if k in q}

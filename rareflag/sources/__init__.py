"""Scans, sources and sinks (parquet, CSV, FITS ingest, model store)."""

from rareflag.sources.tables import read_table, read_parquet, read_csv, nan_to_null  # noqa: F401
from rareflag.sources.obs import observations  # noqa: F401

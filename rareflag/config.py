"""Configuration: feature sets, families and parameter grids.

The telescope names below are the reference's configured columns (fixed
values); ``OBS_FEATURE_SETS`` are the analogues on the derived ``obs`` table
used by the queries and the bench.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Bands and sequence numbers of the telescope table.
BANDS = ["R", "B"]
WHOLE_SOURCE = ["NEW_SRC", "DMAG_CAT"]  # not by sequence; last in every set


def feature_set(n_sequences: int) -> list[str]:
    """Cumulative feature set for sequences 0..n-1 (P3): calibrated
    magnitude, its error, variation (no sequence 0) and extraction flag per
    band, then the source's own columns, in configured order: 8, 16, 24, 32 names."""
    seqs = range(n_sequences)
    cols = [f"MAGCAL_{b}{s}" for s in seqs for b in BANDS]
    cols += [f"MAGERR_{b}{s}" for s in seqs for b in BANDS]
    cols += [f"MAGVAR_{b}{s}" for s in seqs if s > 0 for b in BANDS]
    cols += [f"EFLAG_{b}{s}" for s in seqs for b in BANDS]
    return cols + WHOLE_SOURCE


OBS_FEATURE_SETS = {
    "set_1": ["total_price", "qty_sum", "eflag", "new_src", "dmag_cat"],
    "set_2": ["total_price", "qty_sum", "qty_std", "disc_avg", "eflag", "new_src", "dmag_cat"],
    "set_3": ["total_price", "qty_sum", "qty_std", "disc_avg", "tax_avg", "price_max", "eflag",
              "new_src", "dmag_cat"],
}

# Parameter grids as shipped by the reference (the default config holds one
# forest candidate; the test config uses cv=2).
DEFAULT_GRID = {"rfc": {"n_estimators": [100], "max_depth": [8], "min_samples_leaf": [2], "bootstrap": [False]}}
TEST_GRID = {"rfc": {"n_estimators": [10], "max_depth": [4], "min_samples_split": [2], "min_samples_leaf": [1],
                     "bootstrap": [True]}}


@dataclass
class RunConfig:
    variables: list[str]
    label: str = "is_pos"
    families: dict = field(default_factory=lambda: dict(DEFAULT_GRID))
    cv: int = 5
    scoring: str = "f1"
    test_size: float = 0.2
    seed: int = 123
    mode: str = "batch"
    id_col: str = "id"
    flag_cols: list[str] = field(default_factory=list)
    binary_cols: list[str] = field(default_factory=list)
    resample: bool = False

"""Column functions: built-in Spark expressions only (JVM-side, codegen'd)."""

from rareflag.functions.columns import (  # noqa: F401
    null_indicator, byte_flag, colour_index, label_equals, threshold_label,
    class1_probability, r6,
)
from rareflag.functions.randomness import hash_u32, hash_unit, hash_u32_sql, hash_unit_sql  # noqa: F401

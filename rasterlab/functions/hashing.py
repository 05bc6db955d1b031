"""Repeatable randomness: one md5-based hash, the same in any SQL engine."""

from pyspark.sql import Column, functions as F

SPAN = 2 ** 32


def hash32(*parts) -> Column:
    """Uniform integer in [0, 2^32) from the colon-joined text of ``parts``."""
    key = F.concat_ws(":", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    """Uniform double in [0, 1)."""
    return hash32(*parts) / F.lit(float(SPAN))

"""Rounding that makes results comparable between engines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double column rounded; negative zero becomes zero."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))

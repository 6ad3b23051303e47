"""Helpers for single-row frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def beside(rows: DataFrame, single: DataFrame) -> DataFrame:
    """Attach the columns of a single-row frame, as a scalar subquery rather than a join."""
    names = single.columns
    packed = single.select(F.struct(*names).alias("s")).scalar()
    return rows.withColumn("_single", packed).select(
        *rows.columns, *[F.col(f"_single.{c}").alias(c) for c in names]
    )

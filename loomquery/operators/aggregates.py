"""Grouped and global aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FUNCTIONS = {"SUM": F.sum, "COUNT": F.count, "MIN": F.min, "MAX": F.max}


def aggregate(df: DataFrame, keys: Sequence[str], measures: dict[str, tuple[str, str]]) -> DataFrame:
    """``measures``: output name to (function, column).  Without keys, an empty input gives no row."""
    columns = [FUNCTIONS[f.upper()](c).alias(name) for name, (f, c) in measures.items()]
    if keys:
        return df.groupBy(*keys).agg(*columns)
    return df.agg(*columns, F.count(F.lit(1)).alias("__rows")).filter("__rows > 0").drop("__rows")


def average_or_zero(df: DataFrame, value: Column, condition: Column, digits: int = 6) -> DataFrame:
    """Average over the rows that meet a condition, 0 if none does."""
    return df.filter(condition).agg(F.round(F.coalesce(F.avg(value), F.lit(0.0)), digits).alias("average"), F.count(F.lit(1)).alias("n_rows"))

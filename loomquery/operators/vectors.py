"""Nearest neighbours and windows over vectors and points, exactly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def squared_distance(vector: Column, query: Sequence[float]) -> Column:
    target = F.array(*(F.lit(float(x)) for x in query))
    return F.aggregate(F.zip_with(vector, target, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, d: s + d)


def nearest(df: DataFrame, id_col: str, vector_col: str, query: Sequence[float], k: int) -> DataFrame:
    """The k nearest rows by Euclidean distance, ties to the smaller id: a top-k per partition, then of those."""
    return df.select(id_col, F.sqrt(squared_distance(F.col(vector_col), query)).alias("distance")).orderBy("distance", id_col).limit(k)


def in_rectangle(df: DataFrame, x: Column, y: Column, low: tuple[float, float], high: tuple[float, float]) -> DataFrame:
    """Points within a rectangle, borders included."""
    return df.filter(x.between(low[0], high[0]) & y.between(low[1], high[1]))


def in_box(df: DataFrame, vector_col: str, low: Sequence[float], high: Sequence[float]) -> DataFrame:
    """Vectors whose leading components lie within bounds, borders included."""
    bounds = [F.col(vector_col)[i].cast("double").between(float(a), float(b)) for i, (a, b) in enumerate(zip(low, high, strict=True))]
    out = df
    for b in bounds:
        out = out.filter(b)
    return out


def prefix(df: DataFrame, column: str, start: str) -> DataFrame:
    """Rows whose key begins with a prefix; a scan can skip files by it."""
    return df.filter(F.col(column).startswith(start))


def exact_key(df: DataFrame, column: str, key) -> DataFrame:
    """Rows with a key; raises if there is none."""
    found = df.filter(F.col(column) == F.lit(key))
    if found.isEmpty():
        raise KeyError(key)
    return found

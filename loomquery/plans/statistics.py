"""Table statistics: row counts, distinct counts, extremes, common values, histograms.

Everything is aggregated by Spark; only the few numbers that an estimate needs
are collected.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import ordered_positions


@dataclass
class ColumnStatistics:
    distinct: int
    low: object = None
    high: object = None
    common: list[tuple[object, int]] = field(default_factory=list)


@dataclass
class TableStatistics:
    rows: int
    columns: dict[str, ColumnStatistics]


def extremes(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: n_rows and, for each column, its distinct count, smallest and largest value."""
    parts = [F.count(F.lit(1)).alias("n_rows")]
    for c in columns:
        parts += [F.countDistinct(c).alias(f"{c}_ndv"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return df.agg(*parts)


def common_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent values: value, n, rank.  Ties go to the smaller value."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.desc("n"), "value")
    top = counts.orderBy(F.desc("n"), "value").limit(k)  # a bounded top-k first, so that the ranking window holds k rows
    return top.withColumn("rank", F.row_number().over(order))


def analyze(df: DataFrame, columns: list[str] | None = None, common: int = 10) -> TableStatistics:
    columns = df.columns if columns is None else columns
    row = extremes(df, columns).first()
    found = {}
    for c in columns:
        top = [(r["value"], r["n"]) for r in common_values(df, c, common).orderBy("rank").collect()] if common else []
        found[c] = ColumnStatistics(row[f"{c}_ndv"], row[f"{c}_min"], row[f"{c}_max"], top)
    return TableStatistics(row["n_rows"], found)


def equi_width_histogram(df: DataFrame, column: str, buckets: int = 10) -> DataFrame:
    """Buckets of one width (whole numbers): bucket, low, high, n; empty buckets count 0, the last ends at the largest value."""
    values = df.select(F.col(column).cast("long").alias("v")).filter("v is not null")
    bounds = values.agg(F.min("v").alias("low"), F.max("v").alias("high")).filter("low is not null")
    shape = bounds.select("low", "high", F.greatest(F.ceil((F.col("high") - F.col("low") + 1) / buckets), F.lit(1)).cast("long").alias("width"))
    row = shape.first()  # three numbers
    if row is None:
        return values.sparkSession.createDataFrame([], "bucket long, low long, high long, n long")
    low, high, width = row["low"], row["high"], row["width"]
    counts = values.groupBy(F.floor((F.col("v") - low) / width).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    frame = values.sparkSession.range(buckets).select(
        F.col("id").alias("bucket"), (F.lit(low) + F.col("id") * width).alias("low"), F.least(F.lit(low) + (F.col("id") + 1) * width - 1, F.lit(high)).alias("high")
    ).filter(F.col("low") <= high)
    return frame.join(counts, "bucket", "left").select("bucket", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def equi_depth_histogram(df: DataFrame, column: str, buckets: int = 10) -> DataFrame:
    """Buckets of nearly one count over the sorted values: bucket i ends before row (i + 1) n / buckets.

    Ranks come from the counts of distinct values, part by part, so no task sorts all rows or all values.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranked = ordered_positions(counts, "v", "n").withColumn("upto", F.col("position") + F.col("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    edges = df.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(F.broadcast(total))
    edges = edges.select("bucket", F.floor(F.col("bucket") * F.col("total") / buckets).alias("first"), (F.floor((F.col("bucket") + 1) * F.col("total") / buckets) - 1).alias("last"))
    edges = edges.filter(F.col("last") >= F.col("first"))
    inside = (F.col("first") < F.col("upto")) & (F.col("last") >= F.col("upto") - F.col("n"))
    held = ranked.join(F.broadcast(edges), inside)  # buckets rows, a parameter
    return held.groupBy("bucket", "first", "last").agg(F.min("v").alias("low"), F.max("v").alias("high")).select("bucket", "low", "high", (F.col("last") - F.col("first") + 1).alias("n"))

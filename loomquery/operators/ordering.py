"""Positions in a sorted order without a task that sorts everything."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_ROWS = 20_000  #: distinct values that the split points are chosen from, by hash


def ordered_positions(values: DataFrame, column: str, weight: str | None = None, parts: int = 128) -> DataFrame:
    """``values`` (distinct and not null in ``column``) with ``position``: how many rows, or how much ``weight``, come before.

    Split points cut the order into parts; a part's positions are counted within it,
    from where the parts before it end.  The part of a row is a function of its value,
    so that nothing depends on how Spark deals the rows.  One sum a part reaches the driver.
    """
    sample = sorted(r[0] for r in values.select(column).orderBy(F.xxhash64(column)).limit(SAMPLE_ROWS).collect())
    points = sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []

    def part(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col(column) < F.lit(points[middle]), part(low, middle)).otherwise(part(middle + 1, high))

    dealt = values.withColumn("__part", part(0, len(points)))
    size = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    sums = dict(dealt.groupBy("__part").agg(F.sum(size).alias("n")).collect())
    ends = list(accumulate(sums.get(i, 0) for i in range(len(points) + 1)))
    starts = F.array(*(F.lit(e).cast("long") for e in [0, *ends[:-1]]))
    earlier = Window.partitionBy("__part").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum(size).over(earlier), F.lit(0))
    return dealt.withColumn("position", F.get(starts, F.col("__part")) + within).drop("__part")

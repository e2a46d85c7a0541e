"""Column encodings: dictionary, Huffman, delta, frame of reference; and piecewise linear key models."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import ordered_positions

#: Distinct values of a dictionary or Huffman table that are brought to the driver.
TABLE_ENTRIES = 100_000


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """(value, code): codes from 0 in order of values."""
    values = df.filter(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    return ordered_positions(values, "value").withColumnRenamed("position", "code")


def dictionary_encode(df: DataFrame, column: str, code: str = "code") -> DataFrame:
    table = dictionary(df, column).select(F.col("value").alias(column), F.col("code").alias(code))
    return df.join(table, column, "left")


def dictionary_decode(df: DataFrame, table: DataFrame, code: str, column: str) -> DataFrame:
    return df.join(table.select(F.col("code").alias(code), F.col("value").alias(column)), code, "left").drop(code)


def huffman_codes(df: DataFrame, column: str) -> dict[object, str]:
    """A prefix code by frequency.  Raises if there are more than TABLE_ENTRIES distinct values."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).count().limit(TABLE_ENTRIES + 1).collect()
    if len(counts) > TABLE_ENTRIES:
        raise ValueError(f"{column} has too many values for a code table")
    heap = [(r["count"], i, r[column]) for i, r in enumerate(sorted(counts, key=lambda r: (r["count"], str(r[column]))))]
    if len(heap) == 1:
        return {heap[0][2]: "0"}
    trees: dict[int, tuple] = {}
    heapq.heapify(heap)
    following = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        trees[following] = (a, b)
        heapq.heappush(heap, (a[0] + b[0], following, None))
        following += 1
    codes: dict[object, str] = {}
    stack = [(heap[0], "")] if heap else []
    while stack:
        (_, number, value), code = stack.pop()
        if number in trees:
            left, right = trees[number]
            stack += [(left, code + "0"), (right, code + "1")]
        else:
            codes[value] = code
    return codes


def huffman_cost(df: DataFrame, column: str) -> tuple[int, int, int]:
    """Values, rows and bits of ``column`` in its Huffman code.  All optimal prefix codes need the same number of bits."""
    codes = huffman_codes(df, column)
    words = sorted(codes.values())
    if any(b.startswith(a) for a, b in zip(words, words[1:])):
        raise AssertionError("not a prefix code")
    known = df.filter(F.col(column).isNotNull())
    counts = known.groupBy(column).agg(F.count(F.lit(1)).alias("n")).collect()  # as many rows as the code has words
    return len(codes), sum(r["n"] for r in counts), sum(r["n"] * len(codes[r[column]]) for r in counts)


def delta_encode(df: DataFrame, column: str, order: str, within: list[str]) -> DataFrame:
    """``delta``: the first value of each run as it is, then differences.  Runs (``within``) are independent blocks."""
    run = Window.partitionBy(*within).orderBy(order)
    return df.withColumn("delta", F.col(column) - F.coalesce(F.lag(column).over(run), F.lit(0)))


def delta_decode(df: DataFrame, order: str, within: list[str], column: str) -> DataFrame:
    run = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.sum("delta").over(run))


def frame_of_reference(df: DataFrame, column: str, within: list[str]) -> DataFrame:
    """``base`` of each block and ``offset`` from it, with the bits an offset of the block needs at most."""
    low = df.groupBy(*within).agg(F.min(column).alias("base"), F.max(column).alias("__high"))
    bits = F.greatest(F.lit(1), F.length(F.bin((F.col("__high") - F.col("base")).cast("long")))).cast("int")
    return df.join(low, within).withColumns({"offset": F.col(column) - F.col("base"), "bits": bits}).drop("__high")


def linear_segments(df: DataFrame, key: str, segments: int) -> DataFrame:
    """A model of key order: the sorted distinct keys in equal segments, each with the line that best predicts positions.

    Ranks are counted part by part, see ``ordered_positions``.
    """
    keys = df.filter(F.col(key).isNotNull()).select(F.col(key).cast("double").alias("k")).distinct()
    ranked = ordered_positions(keys, "k")
    total = keys.agg(F.count(F.lit(1)).alias("total"))
    cut = ranked.join(F.broadcast(total)).withColumn("segment", F.floor(F.col("position") * segments / F.col("total")))
    return cut.groupBy("segment").agg(
        F.count(F.lit(1)).alias("n"), F.min("k").alias("low"), F.max("k").alias("high"), F.regr_slope("position", "k").alias("slope"), F.regr_intercept("position", "k").alias("intercept")
    )

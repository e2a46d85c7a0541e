"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A row's shard is a function of its key and the number of shards alone; there is
no ring table.  Appending a shard moves only the fraction 1/(n+1) of the keys,
all of them into the new shard.

Numbering the rows of a shard does not sort or gather a shard: each input
partition numbers its own rows per shard as it streams them, and a prefix sum
over the small (partition, shard) count table turns local numbers into gapless
ones.

Defined results: a null text counts as no bytes; a null key hashes like any
other value, so all null keys share a shard; repeated rows get slots of their
own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, read_table

SHARDS = 24
_MULTIPLIER = np.uint64(2862933555777941757)  # fixed value of the published algorithm


def jump_hash(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Vectorised jump consistent hash of unsigned 64-bit keys into ``0..buckets-1``."""
    if buckets < 1:
        raise ValueError("buckets must be positive")
    state = keys.astype(np.uint64, copy=True)
    last = np.zeros(len(state), dtype=np.int64)
    active = np.arange(len(state))
    jump = np.zeros(len(state), dtype=np.int64)
    while len(active):
        last[active] = jump[active]
        with np.errstate(over="ignore"):
            state[active] = state[active] * _MULTIPLIER + np.uint64(1)
        draw = (state[active] >> np.uint64(33)).astype(np.float64) + 1.0
        jump[active] = ((last[active] + 1) * (2147483648.0 / draw)).astype(np.int64)
        active = active[jump[active] < buckets]
    return last


def assign_shards(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", payload: list[str] | None = None) -> DataFrame:
    """Shard and gapless slot of every row: ``payload`` columns plus ``shard``, ``slot``, ``grown_shard``.

    ``grown_shard`` is the shard with one shard more.  Columns of ``docs`` that
    are not in ``payload`` are not read.
    """
    payload = [key] if payload is None else payload
    taken = {"shard", "slot", "grown_shard"} & {c.lower() for c in payload}
    if taken:
        raise ValueError(f"payload columns clash with the result's: {sorted(taken)}")
    keyed = docs.select(F.xxhash64(F.col(key)).alias("__key"), *payload)
    extra = "shard int, grown_shard int, __part int, __local long"
    fields = keyed.select(*payload).schema
    schema = fields.simpleString()[len("struct<"):-1]
    out_schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [extra]) if schema else extra

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(shards, dtype=np.int64)
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            shard = jump_hash(keys, shards)
            order = np.argsort(shard, kind="stable")
            counts = np.bincount(shard, minlength=shards)
            starts = np.cumsum(counts) - counts
            local = np.empty(len(shard), dtype=np.int64)
            local[order] = np.arange(len(shard)) - starts[shard[order]] + seen[shard[order]]
            seen += counts
            columns = list(batch.columns[1:]) + [
                pa.array(shard.astype(np.int32)),
                pa.array(jump_hash(keys, shards + 1).astype(np.int32)),
                pa.array(np.full(len(shard), part, dtype=np.int32)),
                pa.array(local),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*payload, "shard", "grown_shard", "__part", "__local"])

    numbered = materialise(keyed.mapInArrow(number, out_schema), "shards")
    counts = numbered.groupBy("__part", "shard").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    return numbered.join(bases, ["__part", "shard"]).select(
        *payload, "shard", (F.col("__base") + F.col("__local")).alias("slot"), "grown_shard"
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, key: str = "doc_id") -> None:
    """Write every column of ``docs`` under ``path/shard=N``, many files a shard so that no task holds a whole one."""
    assigned = assign_shards(docs, shards, key, payload=docs.columns)
    assigned.drop("grown_shard").write.partitionBy("shard").parquet(path)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    body = F.col("text").cast("binary")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(body), F.lit(0)).cast("long").alias("text_crc32"),
    )
    placed = assign_shards(rows, SHARDS, payload=["doc_id", "size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")

"""Inner equi-joins with a chosen physical strategy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strategy names and the hint that asks Spark for each.  "auto" leaves the choice to Catalyst and AQE.
STRATEGIES = {"auto": None, "hash": "shuffle_hash", "merge": "merge", "nested_loop": "shuffle_replicate_nl", "broadcast": "broadcast"}

#: A side estimated to be larger is not broadcast, even if that was asked for; the join is then a shuffled hash join.
BROADCAST_BYTES = 64 << 20


def estimated_bytes(df: DataFrame) -> int:
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def equi_join(left: DataFrame, right: DataFrame, on: Column | Sequence[str], strategy: str = "auto") -> DataFrame:
    """Inner join; the strategy never changes the rows."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown join strategy: {strategy}")
    hint = STRATEGIES[strategy]
    if strategy == "broadcast" and estimated_bytes(right) > BROADCAST_BYTES:
        hint = STRATEGIES["hash"]
    return left.join(right.hint(hint) if hint else right, on, "inner")


def filtered_by(df: DataFrame, key: str, small: DataFrame, small_key: str) -> DataFrame:
    """Pre-filter for a later join with ``small``: rows whose key occurs there.  Leaves that join's result as it is."""
    return df.join(small.select(F.col(small_key).alias(key)).distinct(), key, "left_semi")

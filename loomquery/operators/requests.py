"""Client requests against a key-value state: at most once, in order, and checks of histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def at_most_once(requests: DataFrame, client: str, request: str, order: str) -> DataFrame:
    """The first of each client's copies of a request; the others are answered from the cache."""
    whole = F.struct(*(F.col(c) for c in requests.columns))
    return requests.groupBy(F.col(client).alias("__client"), F.col(request).alias("__request")).agg(F.min_by(whole, F.col(order)).alias("__first")).select("__first.*")


def uncompacted(requests: DataFrame, acknowledged: DataFrame, client: str, request: str) -> DataFrame:
    """Cached answers still needed: requests above the client's acknowledged one."""
    known = acknowledged.select(F.col(client), F.col("acknowledged"))
    return requests.join(known, client, "left").filter(F.col(request) > F.coalesce("acknowledged", F.lit(-1))).drop("acknowledged")


def append_state(operations: DataFrame, key: str, value: str, order: str, separator: str = "") -> DataFrame:
    """Final value of each key when every operation appends: its values in order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("string").alias("v"))))
    return operations.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["v"]), separator).alias("state"))


def key_value_state(operations: DataFrame) -> DataFrame:
    """Final values after (seq, key, op, value) operations, op PUT, APPEND or GET: the last PUT and what was appended since."""
    last_put = Window.partitionBy("key").orderBy("seq")
    epoch = F.sum(F.when(F.col("op") == "PUT", 1).otherwise(0)).over(last_put.rowsBetween(Window.unboundedPreceding, 0))
    writes = operations.filter(F.col("op").isin("PUT", "APPEND")).withColumn("epoch", epoch)
    newest = writes.groupBy("key", "epoch").agg(F.array_sort(F.collect_list(F.struct("seq", "value"))).alias("parts"))
    final = newest.groupBy("key").agg(F.max_by("parts", "epoch").alias("parts"))
    return final.select("key", F.array_join(F.transform("parts", lambda p: p["value"]), "").alias("value"))


def broken_append_chains(results: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose results are no strict chain: ordered by length, each must be a proper prefix of the next."""
    by_length = Window.partitionBy(key).orderBy(F.char_length(value), value)
    pairs = results.select(key, F.col(value).alias("now"), F.lead(value).over(by_length).alias("then"))
    broken = F.col("then").isNotNull() & (~F.col("then").startswith(F.col("now")) | (F.col("then") == F.col("now")))
    return pairs.filter(broken).select(key).distinct()


def outcome_counts(results: DataFrame, key: str, value: str) -> DataFrame:
    """Per key: answers, different answers, and how many are undecided (null)."""
    return results.groupBy(key).agg(F.count(value).alias("answers"), F.countDistinct(value).alias("different"), F.count(F.when(F.col(value).isNull(), 1)).alias("undecided"))


def reachable_states(start: DataFrame, steps: DataFrame, depth: int) -> DataFrame:
    """Breadth-first search over (state, next) steps from start states: state and its distance, at most ``depth``.

    The frontier and what was seen are cut each round, so the plan stays small.
    """
    seen = cut(start.select("state").distinct().withColumn("distance", F.lit(0)))
    frontier = seen
    for d in range(1, depth + 1):
        frontier = cut(frontier.select("state").join(steps, "state").select(F.col("next").alias("state")).distinct().join(seen, "state", "left_anti").withColumn("distance", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    return seen

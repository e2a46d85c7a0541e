"""Analysis of transaction schedules and version histories.

A schedule is a table (seq, txn, op, item) with op READ, WRITE, COMMIT or ABORT.
Work per item or per transaction is shuffled by it; only the edges between
transactions are ever walked as a graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

ACCESS = ("READ", "WRITE")
BROADCAST_ROWS = 200_000  #: nodes; a side of more is shuffled
FEW_ROUNDS = 4  #: of peeling, before what is left goes to one task,
TASK_EDGES = 16_000_000  #: if it has no more edges than this, some 50 bytes each


def conflict_edges(schedule: DataFrame) -> DataFrame:
    """Distinct (before, after) transactions with accesses to one item, in that order, at least one a write.

    Each access needs only the earliest access of every transaction to its item and
    each kind, so an item's accesses are paired with at most two rows a transaction.
    """
    access = schedule.filter(F.col("op").isin(*ACCESS))
    first = access.groupBy("item", "txn", "op").agg(F.min("seq").alias("seq")).alias("a")
    last = access.groupBy("item", "txn", "op").agg(F.max("seq").alias("seq")).alias("b")
    both = (F.col("a.item") == F.col("b.item")) & (F.col("a.txn") != F.col("b.txn")) & (F.col("a.seq") < F.col("b.seq"))
    writes = (F.col("a.op") == "WRITE") | (F.col("b.op") == "WRITE")
    return first.join(last, both & writes).select(F.col("a.txn").alias("before"), F.col("b.txn").alias("after")).distinct()


def conflict_steps(schedule: DataFrame) -> DataFrame:
    """Conflict edges (before, after) through which every other one leads: the same nodes reach each other, with two edges an access.

    Of an item, each write leads to the accesses up to the next one that is written at, and each read to
    that next write; a conflict of accesses farther apart is a path through the writes between them.
    """
    access = schedule.filter(F.col("op").isin(*ACCESS) & F.col("item").isNotNull() & F.col("txn").isNotNull() & F.col("seq").isNotNull())
    told = F.struct("txn", (F.col("op") == "WRITE").alias("write"))
    moments = access.groupBy("item", "seq").agg(F.collect_set(told).alias("all")).withColumn("written", F.exists("all", lambda a: a["write"]).cast("long"))
    earlier = Window.partitionBy("item").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    numbered = moments.withColumn("at", F.coalesce(F.sum("written").over(earlier), F.lit(0)))  # moments of writes before
    each = cut(numbered.select("item", "at", "written", F.explode("all").alias("a")).select("item", "at", "written", "a.txn", "a.write").distinct())
    writes = each.filter("write")
    forth = writes.select("item", (F.col("at") + 1).alias("at"), F.col("txn").alias("before")).join(each.select("item", "at", F.col("txn").alias("after")), ["item", "at"])
    reads = each.filter("not write").select("item", (F.col("at") + F.col("written")).alias("at"), F.col("txn").alias("before"))
    onto = reads.join(writes.select("item", "at", F.col("txn").alias("after")), ["item", "at"])
    return forth.unionByName(onto).filter("before != after").select("before", "after").distinct()


def cyclic_nodes(edges: DataFrame, before: str = "before", after: str = "after", max_rounds: int = 1000) -> DataFrame:
    """Nodes left after peeling off, round by round, all that lack a predecessor or a successor: empty iff there is no cycle.

    The rest holds every cycle and the nodes on paths between cycles.  An acyclic
    chain loses a node at each end a round, so what is left after a few rounds and
    fits one task is peeled to the end there, in time linear in its edges.  One too
    long for ``max_rounds`` is an error, as what is left then says nothing of cycles.
    """
    links = cut(edges.select(F.col(before).alias("x"), F.col(after).alias("y")).distinct())
    rest, count = links, None
    ends = F.explode(F.array(F.struct(F.col("x").alias("n"), F.lit(1).alias("end")), F.struct(F.col("y").alias("n"), F.lit(2).alias("end"))))
    for done in range(max_rounds):
        if done == FEW_ROUNDS and rest.count() <= TASK_EDGES:
            return _peeled(rest)
        # Only nodes are written each round; the edges stay, and those of nodes that are gone are passed over.
        inner = cut(rest.select(ends.alias("e")).groupBy("e.n").agg(F.bit_or("e.end").alias("ends")).filter("ends = 3").select("n"))
        left = inner.count()
        if left == count or not left:
            return inner.toDF("node")
        count = left
        few = F.broadcast(inner) if left <= BROADCAST_ROWS else inner
        rest = links.join(few.toDF("x"), "x", "left_semi").join(few.toDF("y"), "y", "left_semi").select("x", "y")
    raise RuntimeError(f"cycles did not settle in {max_rounds} rounds")


def _peeled(links: DataFrame) -> DataFrame:
    """``cyclic_nodes`` of no more than ``TASK_EDGES`` edges (x, y) without nulls, in one task."""
    import numpy as np
    import pyarrow as pa

    def neighbours(nodes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct other ends of the nodes' edges, and how many edges lead there."""
        sizes = starts[nodes + 1] - starts[nodes]
        places = np.repeat(starts[nodes] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return np.unique(ends[places], return_counts=True)

    def peel(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        both = pa.chunked_array(table["x"].chunks + table["y"].chunks).combine_chunks().dictionary_encode()
        x, y = np.split(both.indices.to_numpy(), 2)
        n = len(both.dictionary)
        degrees = [np.bincount(e, minlength=n) for e in (y, x)]  # edges in and out of a node
        starts = [np.concatenate(([0], np.cumsum(d))) for d in degrees]
        order = [y[np.argsort(x, kind="stable")], x[np.argsort(y, kind="stable")]]
        left = np.ones(n, bool)
        gone = np.flatnonzero((degrees[0] == 0) | (degrees[1] == 0))
        while gone.size:
            left[gone] = False
            met = []
            for lost, start, other in ((degrees[0], starts[1], order[0]), (degrees[1], starts[0], order[1])):
                nodes, edges = neighbours(gone, start, other)
                lost[nodes] -= edges
                met.append(nodes[left[nodes] & (lost[nodes] == 0)])
            gone = np.unique(np.concatenate(met))
        yield pa.RecordBatch.from_arrays([both.dictionary.take(pa.array(np.flatnonzero(left)))], names=["node"])

    return cut(links.repartition(1).mapInArrow(peel, f"node {links.schema['x'].dataType.simpleString()}"))


def is_conflict_serializable(schedule: DataFrame) -> bool:
    return cyclic_nodes(conflict_steps(schedule)).isEmpty()


def has_deadlock(waits_for: DataFrame) -> bool:
    """``waits_for``: (before, after), the first waiting for the second."""
    return not cyclic_nodes(waits_for).isEmpty()


def reads_from(schedule: DataFrame) -> DataFrame:
    """Each read with the transaction that last wrote its item (null: none): seq, txn, item, writer.

    Writes of transactions that abort before the read do not count.
    """
    aborts = schedule.filter("op = 'ABORT'").groupBy("txn").agg(F.min("seq").alias("aborted"))
    access = schedule.filter(F.col("op").isin(*ACCESS)).select("seq", "txn", "op", "item").join(aborts, "txn", "left")
    # Of the writes that never abort the last one before the read, found in one pass over each item.
    before = Window.partitionBy("item").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    write = F.struct(F.col("seq").alias("written"), F.col("txn").alias("writer"))
    lasting = F.last(F.when((F.col("op") == "WRITE") & F.col("aborted").isNull(), write), ignorenulls=True).over(before)
    reads = access.withColumn("lasting", lasting).filter("op = 'READ'").select("seq", "txn", "item", "lasting")
    # A write that aborts later is read only until then.
    passing = access.filter("op = 'WRITE' and aborted is not null").select("item", write.alias("write"), "aborted")
    seen = reads.select("seq", "txn", "item").join(passing, "item").filter("write.written < seq and aborted > seq")
    passing = seen.groupBy("seq", "txn", "item").agg(F.max("write").alias("passing"))
    known = reads.join(passing, ["seq", "txn", "item"], "left")
    return known.select("seq", "txn", "item", F.greatest("lasting", "passing")["writer"].alias("writer"))


def last_writer(schedule: DataFrame) -> DataFrame:
    """The same where nothing aborts, with one pass over each item: seq, txn, item, writer."""
    before = Window.partitionBy("item").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    writer = F.last(F.when(F.col("op") == "WRITE", F.col("txn")), ignorenulls=True).over(before)
    return schedule.filter(F.col("op").isin(*ACCESS)).withColumn("writer", writer).filter("op = 'READ'").select("seq", "txn", "item", "writer")


def recovery_classes(schedule: DataFrame) -> dict[str, bool]:
    """Is the schedule recoverable, cascadeless, strict?"""
    commits = schedule.filter("op = 'COMMIT'").groupBy("txn").agg(F.min("seq").alias("committed"))
    ends = schedule.filter(F.col("op").isin("COMMIT", "ABORT")).groupBy("txn").agg(F.min("seq").alias("ended"))
    reads = reads_from(schedule).filter("writer is not null and writer != txn")
    known = reads.join(commits.toDF("writer", "writer_committed"), "writer", "left").join(commits.toDF("txn", "reader_committed"), "txn", "left")
    open_commit = (F.col("reader_committed").isNotNull()) & (F.col("writer_committed").isNull() | (F.col("writer_committed") > F.col("reader_committed")))
    dirty = F.col("writer_committed").isNull() | (F.col("writer_committed") > F.col("seq"))
    # A write is overwritten or read too early, if ever, by the first access of another transaction that follows it: the one
    # after the run of its own transaction's accesses to the item.
    by_item = Window.partitionBy("item").orderBy("seq")
    access = schedule.filter(F.col("op").isin(*ACCESS)).withColumn("before", F.lag("txn").over(by_item))
    runs = access.withColumn("run", F.sum(F.when(F.col("before") == F.col("txn"), 0).otherwise(1)).over(by_item))
    in_run = Window.partitionBy("item", "run").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wrote = runs.withColumn("wrote", F.max((F.col("op") == "WRITE").cast("int")).over(in_run))
    after = wrote.withColumn("exposed", F.lag("wrote").over(by_item) == 1).filter("exposed and before != txn")
    loose = after.join(ends.toDF("before", "ended"), "before", "left").filter(F.col("ended").isNull() | (F.col("ended") > F.col("seq")))
    return {"recoverable": known.filter(open_commit).isEmpty(), "cascadeless": known.filter(dirty).isEmpty(), "strict": loose.isEmpty()}


def snapshot_read(versions: DataFrame, key: str, written: str, timestamp: Column, visible: Column | None = None) -> DataFrame:
    """Of each key the newest version written at or before a timestamp, among the visible ones."""
    shown = versions.filter(F.col(written) <= timestamp)
    shown = shown if visible is None else shown.filter(visible)
    whole = F.struct(*(F.col(c) for c in versions.columns))
    return shown.groupBy(key).agg(F.max_by(whole, F.col(written)).alias("__v")).select("__v.*")


def stale_reads(observed: DataFrame, current: DataFrame, key: str, version: str) -> DataFrame:
    """Backward validation: reads (txn, key, version) whose version is no longer current."""
    now = current.select(F.col(key), F.col(version).alias("__now"))
    return observed.join(now, key, "left").filter(~F.col(version).eqNullSafe(F.col("__now"))).drop("__now")


def predicate_edges(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """Read-write edges by predicate: a reader's range (txn, item, low, high) holds another's written value (txn, item, value)."""
    r, w = reads.alias("r"), writes.alias("w")
    hit = (F.col("r.item") == F.col("w.item")) & (F.col("r.txn") != F.col("w.txn")) & F.col("w.value").between(F.col("r.low"), F.col("r.high"))
    return r.join(w, hit).select(F.col("r.txn").alias("reader"), F.col("w.txn").alias("writer")).distinct()


def dangerous_pivots(edges: DataFrame) -> DataFrame:
    """Transactions with an incoming and an outgoing read-write edge."""
    return edges.select(F.col("writer").alias("txn")).distinct().join(edges.select(F.col("reader").alias("txn")).distinct(), "txn", "left_semi")


def timestamp_order(schedule: DataFrame) -> DataFrame:
    """Basic timestamp ordering, the transaction number being its timestamp: each access with ``accepted``.

    An item's accesses are folded in order; a rejected one leaves the item's times alone.
    """
    import pandas as pd

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        read_time = write_time = -1
        out = []
        for op, txn in zip(rows.sort_values("seq")["op"], rows.sort_values("seq")["txn"], strict=True):
            fine = txn >= write_time and (op == "READ" or txn >= read_time)
            if fine and op == "READ":
                read_time = max(read_time, txn)
            elif fine:
                write_time = txn
            out.append(fine)
        return rows.sort_values("seq").assign(accepted=out)

    access = schedule.filter(F.col("op").isin(*ACCESS)).select("seq", "txn", "op", "item")
    types = {f.name: f.dataType.simpleString() for f in access.schema}
    return access.groupBy("item").applyInPandas(fold, ", ".join(f"{c} {t}" for c, t in types.items()) + ", accepted boolean")


def redo_undo(log: DataFrame) -> DataFrame:
    """State after recovery from a log (lsn, txn, op, item, before, after): the last write of a committed transaction to
    each item, or the value from before its first write if none committed."""
    committed = log.filter("op = 'COMMIT'").select("txn").distinct()
    writes = log.filter("op = 'WRITE'")
    won = writes.join(committed, "txn", "left_semi").groupBy("item").agg(F.max_by("after", "lsn").alias("redone"), F.lit(True).alias("won"))
    start = writes.groupBy("item").agg(F.min_by("before", "lsn").alias("original"))
    return start.join(won, "item", "left").select("item", F.when(F.col("won"), F.col("redone")).otherwise(F.col("original")).alias("value"))


def first_committer_losers(transactions: DataFrame, writes: DataFrame) -> DataFrame:
    """First committer wins: transactions (txn, started, committed) that must abort, because one that ran at the same time
    and committed earlier wrote one of their items."""
    mine = writes.select("txn", "item").distinct().join(transactions, "txn")
    earlier = mine.select(F.col("txn").alias("winner"), "item", F.col("committed").alias("won"))
    clash = (F.col("winner") != F.col("txn")) & (F.col("won") > F.col("started")) & (F.col("won") < F.col("committed"))
    return mine.join(earlier, "item").filter(clash).select("txn").distinct()


def nonrepeatable_reads(schedule: DataFrame) -> DataFrame:
    """(txn, item) read more than once with different last writers, the later one another transaction."""
    reads = last_writer(schedule).withColumn("seen", F.coalesce("writer", F.lit(-1)))
    again = Window.partitionBy("txn", "item").orderBy("seq")
    changed = (F.col("seen") != F.lag("seen").over(again)) & (F.col("seen") != F.col("txn"))
    return reads.withColumn("changed", changed).filter("changed").select("txn", "item").distinct()


def dirty_reads(schedule: DataFrame) -> DataFrame:
    """Reads (seq, txn, item, writer) of a value whose writer, another transaction, had not committed by then."""
    commits = schedule.filter("op = 'COMMIT'").groupBy(F.col("txn").alias("writer")).agg(F.min("seq").alias("committed"))
    reads = reads_from(schedule).filter("writer is not null and writer != txn").join(commits, "writer", "left")
    return reads.filter(F.col("committed").isNull() | (F.col("committed") > F.col("seq"))).select("seq", "txn", "item", "writer")

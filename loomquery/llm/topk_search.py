"""Exact top-k inner-product search with an impact-ordered index, score at a time.

Vectors are quantised to whole numbers and stored in blocks.  In a block the
postings (vector, dimension, value) fall into segments by quantised impact, the
bit length of the value.  A block of queries takes the segments in descending
order, each adding to all scores at once.  After a segment, what the rest can
still add to a vector's score is at most the product of the query's norm and the
norm of the vector's postings yet to come.  A query stops when that proves all
but a few vectors to lie below its k-th best exact score; the few are scored
exactly.  Without proof it goes on to the last segment, where scores are exact.

Queries meet vectors block by block; a block of queries is sent to the vectors'
tasks if all queries are small enough to broadcast, else both sides are shuffled
by query block.  A task returns k rows a query, whatever it has read.

Defined results: vectors that are null, or hold a null or a component that is not
finite, take no part, neither as query nor as candidate.  Vectors of unlike
length are compared on the positions both have.  A row is never its own
candidate, but rows that repeat are candidates of each other, each query row with
ranks of its own.  A null id is no query and sorts after all ids.  A score beyond
64 bits is held at the limit.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, read_table, size_bytes

NO_ID = np.iinfo(np.int64).max  #: stands for a null id
EXACT = 2.0**53


@dataclass(frozen=True)
class SearchOptions:
    k: int = 5
    scale: float = 256.0  #: components are floor(scale * x)
    block: int = 4096  #: vectors of an index block
    query_block: int = 1024
    rescore: int = 64  #: a query stops when at most so many vectors of a block are still possible
    broadcast_bytes: int = 16 << 20


_BLOCK = "block long, ids binary, cells binary, width int, bytes int"


def _quantise(value: float, scale: float) -> int:
    """floor(scale * value) as whole number; exact for any finite double."""
    return int(np.floor(np.float64(value) * scale)) if abs(value) * scale < 2.0**1023 else int(value) * int(scale)


def _cells(rows: list[np.ndarray], scale: float) -> np.ndarray:
    """Quantised components, shorter vectors filled up with 0; 64-bit if they fit, else Python numbers."""
    width = max((len(r) for r in rows), default=0)
    raw = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        raw[i, : len(r)] = r
    if np.abs(raw).max(initial=0.0) * scale < 2.0**62:
        return np.floor(raw * scale).astype(np.int64)
    return np.array([[_quantise(x, scale) for x in row] for row in raw], dtype=object)


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", options: SearchOptions = SearchOptions()) -> DataFrame:
    """Blocks of the usable vectors: block, ids, cells (row by row, little-endian), width, bytes a cell (0: too large for 64 bits)."""
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    usable = vectors.filter(F.col(vector_col).isNotNull()).filter(~bad).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            for start in range(0, batch.num_rows, options.block):
                some = batch.slice(start, options.block)
                ids = some.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype("<i8")
                cells = _cells([v.values.to_numpy(zero_copy_only=False) for v in some.column(1)], options.scale)
                if cells.dtype == object:
                    body, size = "\n".join(str(c) for c in cells.ravel()).encode(), 0
                else:
                    most = int(np.abs(cells).max(initial=0))
                    size = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
                    body = cells.astype(f"<i{size}").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(part << 32) + made]), pa.array([ids.tobytes()], pa.binary()), pa.array([body], pa.binary()), pa.array([cells.shape[1]], pa.int32()), pa.array([size], pa.int32())],
                    names=["block", "ids", "cells", "width", "bytes"],
                )
                made += 1

    return usable.mapInArrow(build, _BLOCK)


def _load(ids: bytes, cells: bytes, width: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    names = np.frombuffer(ids, dtype="<i8")
    if size == 0:
        flat = np.array([int(x) for x in cells.split(b"\n")], dtype=object)
    else:
        flat = np.frombuffer(cells, dtype=f"<i{size}").astype(np.int64)
    return names, flat.reshape(len(names), width)


class ImpactBlock:
    """One block's postings in segments of descending impact."""

    def __init__(self, ids: np.ndarray, cells: np.ndarray):
        self.ids, self.cells = ids, cells
        self.most = float(max((abs(int(c)) for c in (cells.max(initial=0), cells.min(initial=0))), default=0))
        self.dense = cells.astype(np.float64)
        self.level = np.frexp(np.abs(self.dense))[1] * (self.dense != 0)  # bit length of the magnitude
        self.levels = sorted({int(x) for x in np.unique(self.level)} - {0}, reverse=True)
        self.left = {}  # norm of a vector's postings below each level
        for level in self.levels:
            rest = np.where(self.level < level, self.dense, 0.0)
            with np.errstate(over="ignore"):  # a norm that is no number proves nothing
                self.left[level] = np.sqrt((rest * rest).sum(axis=1))

    def segment(self, level: int) -> np.ndarray:
        return np.where(self.level == level, self.dense, 0.0)


def _exact(queries: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Exact scores of all pairs, as 64-bit numbers held at their limits."""
    width = min(queries.shape[1], cells.shape[1])
    scores = queries[:, :width].astype(object) @ cells[:, :width].T.astype(object)
    limits = np.iinfo(np.int64)
    return np.clip(scores, limits.min, limits.max).astype(np.int64) if scores.size else np.zeros(scores.shape, dtype=np.int64)


class Best:
    """Running k best (score, id, row) of a block of queries: ties to the smaller id, then row."""

    def __init__(self, count: int, k: int):
        self.k = k
        self.rows: list[list[tuple[int, int, int]]] = [[] for _ in range(count)]  # (-score, id, row), sorted

    def floor(self) -> np.ndarray:
        """Score below which nothing can still enter, for each query."""
        return np.array([-r[-1][0] if len(r) == self.k else -np.inf for r in self.rows], dtype=np.float64)

    def add(self, q: int, scores, ids, rows) -> None:
        merged = set(self.rows[q]) | {(-int(s), int(i), int(r)) for s, i, r in zip(scores, ids, rows, strict=True)}
        self.rows[q] = sorted(merged)[: self.k]


def search_block(queries: np.ndarray, own_rows: np.ndarray, block: ImpactBlock, first_row: int, best: Best, options: SearchOptions) -> int:
    """Let a block of queries take the segments of a block of vectors; returns how many (query, segment) steps the proofs saved."""
    rows = first_row + np.arange(len(block.ids))
    width = min(queries.shape[1], block.dense.shape[1])
    largest = max((abs(int(x)) for x in (queries.max(initial=0), queries.min(initial=0))), default=0)
    if not len(rows) or not len(queries):
        return 0
    if largest * block.most * max(1, width) >= EXACT:
        scores = _exact(queries, block.cells)
        for q in range(len(queries)):
            other = rows != own_rows[q]
            best.add(q, scores[q][other], block.ids[other], rows[other])
        return 0
    wide = queries[:, :width].astype(np.float64)
    norms = np.sqrt((wide * wide).sum(axis=1))
    active = np.arange(len(queries))
    scores = np.zeros((len(queries), len(rows)))
    mine = own_rows[:, None] == rows[None, :]
    saved = 0
    cells = block.dense[:, :width]
    for step, level in enumerate([*block.levels, 0]):
        if level:
            scores[active] += wide[active] @ block.segment(level)[:, :width].T
            slack = norms[active][:, None] * block.left[level][None, :] * (1 + 1e-9) + 1e-6
            if not step:  # the best by what is known so far set a first floor
                for q, known in zip(active.tolist(), np.where(mine, -np.inf, scores), strict=True):
                    top = np.argpartition(-known, min(options.k, len(known) - 1))[: options.k]
                    top = top[~mine[q][top]]
                    best.add(q, cells[top] @ wide[q], block.ids[top], rows[top])
        else:
            slack = 0.0
        possible = (scores[active] + slack >= best.floor()[active][:, None]) & ~mine[active]
        count = possible.sum(axis=1)
        done = (count <= options.rescore) | (level == 0)
        for q, members in zip(active[done].tolist(), possible[done], strict=True):
            at = np.flatnonzero(members)
            best.add(q, cells[at] @ wide[q], block.ids[at], rows[at])
        saved += int(done.sum()) * (len(block.levels) - step) if level else 0
        active = active[~done]
        if not len(active):
            break
    return saved


def top_k(index: DataFrame, is_query: Column, options: SearchOptions = SearchOptions()) -> DataFrame:
    """The k best of all rows for each query row: query_id, rank, vec_id, score.  ``is_query`` is a condition on column ``id``."""

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, _, _, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                names = np.frombuffer(ids, dtype="<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), block)), pa.array(np.arange(len(names))), pa.array(names)], names=["block", "at", "id"])

    index = materialise(index, "index")
    wanted = index.mapInArrow(rows_of, "block long, at long, id long").withColumn("id", F.when(F.col("id") != NO_ID, F.col("id"))).filter(is_query)
    chosen = wanted.groupBy("block").agg(F.array_sort(F.collect_list("at")).alias("at"))  # at most a block's rows each

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, cells, width, size, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                names, values = _load(ids, cells, width, size)
                body = "\n".join(str(c) for c in values[at].ravel()).encode() if size == 0 else values[at].astype(f"<i{size}").tobytes()
                rows = (np.int64(block) * options.block + np.array(at, dtype=np.int64)).astype("<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[at].tobytes()], pa.binary()), pa.array([rows.tobytes()], pa.binary()), pa.array([body], pa.binary()), pa.array([width], pa.int32()), pa.array([size], pa.int32())],
                    names=["q_ids", "q_rows", "q_cells", "q_width", "q_bytes"],
                )

    picked = index.join(chosen, "block").select("block", "ids", "cells", "width", "bytes", "at").mapInArrow(pick, "q_ids binary, q_rows binary, q_cells binary, q_width int, q_bytes int")
    numbered = materialise(picked.withColumn("q_block", F.monotonically_increasing_id()), "queries")
    groups = numbered.select("q_block", F.floor(F.sum(F.length("q_ids") / 8).over(Window.orderBy("q_block").rowsBetween(Window.unboundedPreceding, -1)) / options.query_block).alias("g"))
    groups = groups.select("q_block", F.dense_rank().over(Window.orderBy(F.coalesce("g", F.lit(0)))).cast("long") - 1).toDF("q_block", "g")  # one small row a block
    queries = materialise(numbered.join(groups, "q_block").groupBy("g").agg(F.collect_list(F.struct("q_ids", "q_rows", "q_cells", "q_width", "q_bytes")).alias("parts")), "query_blocks")
    # Every query block meets every vector block, each pair once; the larger side is never copied by a broadcast.
    dealt = index.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, queries.count() - 1)).cast("long"))))
    paired = dealt.join(F.broadcast(queries) if size_bytes(queries) <= options.broadcast_bytes else queries, "g")
    paired = paired.select("g", "parts", "block", "ids", "cells", "width", "bytes")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        blocks: dict[int, ImpactBlock] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                g, block = batch.column(0)[r].as_py(), batch.column(2)[r].as_py()
                if g not in held:
                    loaded = [(_load(p["q_ids"], p["q_cells"], p["q_width"], p["q_bytes"]), np.frombuffer(p["q_rows"], dtype="<i8")) for p in batch.column(1)[r].as_py()]
                    width = max(v.shape[1] for (_, v), _ in loaded)
                    cells = np.concatenate([np.pad(v, ((0, 0), (0, width - v.shape[1]))) for (_, v), _ in loaded])
                    ids, rows = np.concatenate([n for (n, _), _ in loaded]), np.concatenate([o for _, o in loaded])
                    held[g] = (ids, rows, cells, Best(len(ids), options.k))
                if block not in blocks:
                    blocks = {block: ImpactBlock(*_load(*(batch.column(i)[r].as_py() for i in (3, 4, 5, 6))))}
                ids, rows, cells, best = held[g]
                search_block(cells, rows, blocks[block], block * options.block, best, options)
        for ids, rows, _, best in held.values():
            flat = [(int(rows[q]), int(ids[q]), -s, i, row) for q in range(len(ids)) for s, i, row in best.rows[q]]
            columns = zip(*flat, strict=True) if flat else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["q_row", "query_id", "score", "vec_id", "row"])

    found = paired.mapInArrow(search, "q_row long, query_id long, score long, vec_id long, row long")
    order = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= options.k)
    return ranked.select("query_id", "rank", F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return top_k(build_index(vectors), F.col("id") % 50 == 0)


TOPK_SQL = """WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
    SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), r AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""

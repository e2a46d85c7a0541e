"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Each benchmark item is a sequence of words (lower case, ASCII punctuation
dropped).  Its n-grams are counted over the whole corpus; its rarer ones are
seeds.  Rare is relative to the item's other n-grams, not an absolute count, so
that an item leaked into a third of all documents still has seeds.  Wherever a
document holds a seed, the stretch of the document around it is aligned with the
item by Smith-Waterman over words, which scores copies with replaced, inserted
and deleted words.  The score is the best local alignment's as a share of the
item's alignment with itself.

The index of items is broadcast in blocks of at most ``block_grams`` n-grams; a
larger benchmark takes several passes over the corpus.  Documents are never
shuffled.  What is gathered is one count for each n-gram of the block.

Defined results: null and empty texts leak nothing; items that are null or have
fewer than ``gram`` words match nothing; items that repeat are each reported; rows
that repeat each get their own result; an empty benchmark or an empty table gives
an empty result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from .common import fresh_name, make_room, materialise, read_table
from .shingling import ALPHANUMERIC, Words, chunks, runs_of

MATCH, MISMATCH, GAP = 2, -1, 1


@dataclass(frozen=True)
class LeakOptions:
    gram: int = 3  #: words of a seed
    rare_share: float = 0.75  #: share of an item's distinct n-grams that are seeds, the rarest
    threshold: float = 0.5  #: score from which a document counts as contaminated by the item
    block_grams: int = 1_000_000  #: n-grams of the items that one pass looks for
    cells: int = 4_000_000  #: alignment cells worked on at once


def _bodies(texts) -> list[bytes]:
    return [t.lower().encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


@dataclass
class ItemIndex:
    """Seeds of a block of items: sorted hashes with the items and places that have them."""

    ids: list
    words: list[np.ndarray]
    grams: np.ndarray = field(init=False)  # sorted, with repetition
    item: np.ndarray = field(init=False)
    place: np.ndarray = field(init=False)
    distinct: np.ndarray = field(init=False)
    maybe: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.set_seeds([], [], [])

    @classmethod
    def build(cls, rows: list[tuple], options: LeakOptions) -> ItemIndex:
        found = Words(_bodies([t for _, t in rows]), ALPHANUMERIC)
        grams = found.grams(options.gram)
        words, all_grams, items, places = [], [], [], []
        for d in range(len(rows)):
            low, high = int(found.bounds[d]), int(found.bounds[d + 1])
            words.append(found.hashes[low:high].copy())
            own = grams[low : max(low, high - options.gram + 1)]
            all_grams.append(own)
            items.append(np.full(len(own), d))
            places.append(np.arange(len(own)))
        index = cls([i for i, _ in rows], words)
        index.set_seeds(all_grams, items, places)
        return index

    def set_seeds(self, grams: list[np.ndarray], items: list[np.ndarray], places: list[np.ndarray]) -> None:
        empty = np.empty(0, dtype=np.int64)
        flat = np.concatenate([empty.astype(np.uint64), *grams])
        by = np.argsort(flat, kind="stable")
        self.grams = flat[by]
        self.item = np.concatenate([empty, *items])[by]
        self.place = np.concatenate([empty, *places])[by]
        self.distinct = np.unique(self.grams)
        self.maybe = np.zeros(1 << 22, dtype=bool)
        self.maybe[(self.distinct & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def keep_rare(self, counts: dict[int, int], share: float) -> None:
        """Keep each item's rarer distinct n-grams, ties included."""
        n = np.array([counts.get(g, 0) for g in self.grams.view(np.int64).tolist()], dtype=np.int64)
        keep = np.zeros(len(n), dtype=bool)
        for d in range(len(self.ids)):
            own = np.flatnonzero(self.item == d) if len(self.ids) < 64 else self._of_item(d)
            if len(own):
                _, first = np.unique(self.grams[own], return_index=True)
                ordered = np.sort(n[own[first]])
                limit = ordered[max(0, int(np.ceil(share * len(ordered))) - 1)]
                keep[own] = n[own] <= limit
        self.set_seeds([self.grams[keep]], [self.item[keep]], [self.place[keep]])
        self._rows = None

    _rows: tuple | None = None

    def _of_item(self, d: int) -> np.ndarray:
        if self._rows is None:
            by = np.argsort(self.item, kind="stable")
            self._rows = (by, np.searchsorted(self.item[by], np.arange(len(self.ids) + 1)))
        by, edges = self._rows
        return by[edges[d] : edges[d + 1]]

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """Positions of those of ``grams`` that are in the index."""
        at = np.flatnonzero(self.maybe[(grams & np.uint64((1 << 22) - 1)).astype(np.int64)])
        if not len(at):
            return at
        where = np.minimum(np.searchsorted(self.distinct, grams[at]), len(self.distinct) - 1)
        return at[self.distinct[where] == grams[at]]


def smith_waterman(items: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local scores of item rows against window rows, and the window word each alignment ends with.

    Rows are padded with 0 (items) and 1 (windows).  The gaps along a row are a running maximum.
    """
    count, width = windows.shape
    slope = np.arange(width + 1, dtype=np.int32) * GAP
    above = np.zeros((count, width + 1), dtype=np.int32)
    best, end = np.zeros(count, dtype=np.int32), np.zeros(count, dtype=np.int64)
    rows = np.arange(count)
    for i in range(items.shape[1]):
        step = np.where(items[:, i : i + 1] == windows, MATCH, MISMATCH).astype(np.int32)
        here = np.zeros_like(above)
        here[:, 1:] = np.maximum(np.maximum(above[:, :-1] + step, above[:, 1:] - GAP), 0)
        here = np.maximum.accumulate(here + slope, axis=1) - slope
        top = here.argmax(axis=1)
        better = here[rows, top] > best
        best = np.where(better, here[rows, top], best)
        end = np.where(better, top - 1, end)
        above = here
    return best, end


def _padded(rows: list[np.ndarray], filler: int) -> np.ndarray:
    out = np.full((len(rows), max(map(len, rows))), filler, dtype=np.uint64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def align(jobs: list[tuple[np.ndarray, np.ndarray]], cells: int) -> list[tuple[float, int, int]]:
    """Score, first and last window word of each (item, window) pair; pairs of like size are worked on together."""
    out: list[tuple[float, int, int]] = [(0.0, 0, -1)] * len(jobs)
    order = sorted(range(len(jobs)), key=lambda j: (len(jobs[j][1]), len(jobs[j][0])))
    start = 0
    while start < len(order):
        end = start + 1
        while end < len(order) and (end - start) * len(jobs[order[end]][1]) * 8 < cells:
            end += 1
        some = order[start:end]
        items, windows = ([jobs[j][k] for j in some] for k in (0, 1))
        score, last = smith_waterman(_padded(items, 0), _padded(windows, 1))
        _, back = smith_waterman(_padded([x[::-1] for x in items], 0), _padded([w[: e + 1][::-1] for w, e in zip(windows, last, strict=True)], 1))
        for j, s, e, b in zip(some, score.tolist(), last.tolist(), back.tolist(), strict=True):
            out[j] = (s / (MATCH * len(jobs[j][0])), e - b, e)
        start = end
    return out


def leaks_of(texts: list[str | None], index: ItemIndex, options: LeakOptions) -> list[list[tuple]]:
    """For each text the contaminating items: (item's id, score, first word, last word), best window each."""
    out: list[list[tuple]] = [[] for _ in texts]
    if not len(index.distinct):
        return out
    bodies = _bodies(texts)
    for first, end in chunks(bodies):
        found = Words(bodies[first:end], ALPHANUMERIC)
        grams = found.grams(options.gram)
        at = index.hits(grams)
        if not len(at):
            continue
        doc = np.searchsorted(found.bounds, at, side="right") - 1
        inside = at + options.gram <= found.bounds[doc + 1]
        at, doc = at[inside], doc[inside]
        low = np.searchsorted(index.grams, grams[at], side="left")
        copies = np.searchsorted(index.grams, grams[at], side="right") - low
        entry = np.repeat(low - np.cumsum(copies) + copies, copies) + np.arange(copies.sum())
        at, doc = np.repeat(at, copies), np.repeat(doc, copies)
        item, begin = index.item[entry], at - index.place[entry]  # where the item would begin
        sizes = np.array([len(w) for w in index.words])[item]
        by = np.lexsort((begin, item, doc))
        at, doc, item, begin, sizes = at[by], doc[by], item[by], begin[by], sizes[by]
        new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > sizes[1:]))) if len(at) else np.empty(0, dtype=bool)
        starts = np.flatnonzero(new)
        owners, jobs = [], []
        for k, s in enumerate(starts.tolist()):
            e = int(starts[k + 1]) if k + 1 < len(starts) else len(at)
            d, i, size = int(doc[s]), int(item[s]), int(sizes[s])
            pad = size // 2 + 2
            low_word = max(int(found.bounds[d]), int(begin[s]) - pad)
            high_word = min(int(found.bounds[d + 1]), int(begin[e - 1]) + size + pad)
            owners.append((d, i, low_word - int(found.bounds[d])))
            jobs.append((index.words[i], found.hashes[low_word:high_word]))
        best: dict[tuple[int, int], tuple] = {}
        for (d, i, shift), (score, a, b) in zip(owners, align(jobs, options.cells), strict=True):
            if score >= options.threshold and score > best.get((d, i), (0.0,))[0]:
                best[d, i] = (score, shift + a, shift + b)
        for (d, i), (score, a, b) in sorted(best.items()):
            out[first + d].append((index.ids[i], score, a, b))
    return out


def corpus_counts(docs: DataFrame, index: ItemIndex, text_col: str, options: LeakOptions) -> dict[int, int]:
    """Documents that hold each n-gram of the index.  At most one number an n-gram reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(len(index.distinct), dtype=np.int64)
        for batch in batches:
            for run in runs_of(batch.column(0)):
                found = Words(_bodies(run.to_pylist()), ALPHANUMERIC)
                grams = found.grams(options.gram)
                at = index.hits(grams)
                doc = np.searchsorted(found.bounds, at, side="right") - 1
                inside = at + options.gram <= found.bounds[doc + 1]
                which = np.searchsorted(index.distinct, grams[at[inside]])
                seen = np.unique(doc[inside] * len(index.distinct) + which)
                totals += np.bincount(seen % max(1, len(index.distinct)), minlength=len(totals))
        some = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(index.distinct[some].view(np.int64)), pa.array(totals[some])], names=["gram", "n"])

    rows = docs.select(text_col).filter(F.col(text_col).isNotNull()).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"]: r["n"] for r in rows.collect()}


def _block_count(items: DataFrame, text_col: str, options: LeakOptions) -> int:
    words = items.agg(F.sum(F.size(F.split(text_col, r"\s+"))).alias("n")).first()["n"] or 0
    return max(1, -(-int(words) // options.block_grams))


def _block(items: DataFrame, id_col: str, text_col: str, b: int, total: int) -> list[tuple]:
    """One block of the items, small enough to broadcast."""
    usable = items.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = usable.filter(F.pmod(F.xxhash64("id", "text"), F.lit(total)) == b).collect()
    return sorted(((r["id"], r["text"]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def _finder(index: ItemIndex, kind: str, options: LeakOptions):
    names = ("item_id", "score", "first_word", "last_word")
    arrow_kind = to_arrow_type(_parse_datatype_string(kind))

    @F.arrow_udf(kind)
    def find(texts: pa.Array) -> pa.Array:
        found = [leaks_of(run.to_pylist(), index, options) for run in runs_of(texts)]
        return pa.array([[dict(zip(names, leak, strict=True)) for leak in leaks] for some in found for leaks in some], arrow_kind)

    return find


def with_leaks(docs: DataFrame, items: DataFrame, out: str = "leaks", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", options: LeakOptions = LeakOptions()) -> DataFrame:
    """``docs`` with a column of the items that contaminate each text: array of (item_id, score, first_word, last_word).

    A column of the documents that is named ``out`` gets a trailing underscore.  With
    several blocks of items, each block's hits are written before the next block is
    read, so that a task holds the index of one block.
    """
    id_type = items.schema[item_id].dataType.simpleString()
    kind = f"array<struct<item_id:{id_type},score:double,first_word:int,last_word:int>>"
    docs = make_room(docs, out) if out != text_col else docs
    total = _block_count(items, item_text, options)
    key = [F.xxhash64(F.lit(i), text_col) for i in (1, 2)]
    hits: DataFrame | None = None
    for b in range(total):
        index = ItemIndex.build(_block(items, item_id, item_text, b, total), options)
        index.keep_rare(corpus_counts(docs, index, text_col, options), options.rare_share)
        found = _finder(index, kind, options)(F.col(text_col))
        if total == 1:
            return docs.withColumn(out, found)
        some = docs.filter(F.col(text_col).isNotNull()).select(key[0].alias("t1"), key[1].alias("t2"), found.alias("leaks")).filter(F.size("leaks") > 0)
        some = materialise(some.dropDuplicates(["t1", "t2"]), "leaks")  # a text's leaks depend on the text alone
        hits = some if hits is None else hits.unionByName(some)
    gathered = hits.groupBy("t1", "t2").agg(F.flatten(F.collect_list("leaks")).alias("leaks"))
    names = {k: fresh_name(docs, f"__{k}") for k in ("t1", "t2", "leaks")}
    keyed = docs.withColumns({names["t1"]: key[0], names["t2"]: key[1]})
    joined = keyed.join(gathered.select(*(F.col(k).alias(v) for k, v in names.items())), [names["t1"], names["t2"]], "left")
    return joined.withColumn(out, F.coalesce(names["leaks"], F.array().cast(kind))).drop(*names.values())


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_leaks(docs, read_table(spark, sf_dir, "benchmark"))
    leaks = found.select("doc_id", F.explode("leaks").alias("leak"))
    return leaks.select("doc_id", "leak.item_id", "leak.score", "leak.first_word", "leak.last_word")

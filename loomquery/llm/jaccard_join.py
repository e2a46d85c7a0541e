"""Exact n-gram Jaccard self-join with count-vector R-trees.

A document's shingles are hashed into groups; the numbers of shingles in each
group are its point.  Two sets cannot overlap by more than the sum, over the
groups, of the smaller count, and for all points below a tree node not by more
than the same sum with the node's largest counts.  Pairs whose bound reaches the
overlap that the threshold asks for are verified on the sets themselves.

One tree over all points would meet every pair of like size, so the points are
dealt to many small trees, without losing a pair: shingles have one global order,
rare ones first; documents that reach a Jaccard similarity t share one of their
first n - ceil(t n) + 1 shingles in that order.  The documents that share such a
shingle are named after their smallest signature, and all that are named alike
form one tree.  The order is fitted on a bounded sample of documents
(``JoinOptions.fit_documents``); it decides the cost alone, never the result.

That gives candidates by their bounds.  What candidates connect are families, each
set being in one; only a family's sets are built again and verified, in a second
round of trees, one for each family.

Large groups of near copies are not listed pair by pair.  Equal sets are one
class from the start.  A tree skips the pairs that its links connect already, and
returns the links that connected something: fewer than it has sets.  A tree with
more than ``tile`` sets is cut into tiles, and the pairs of tiles are separate tasks'
work.

The result is one row a document: the size of its set and the smallest document
id in its component.

Defined results: null, empty and blank texts have no shingles and link with
nothing; rows that repeat belong to one class; a null id never becomes a
component id unless its component has no other, and then it is null; an empty
table gives an empty result; columns that are not asked for are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_name, materialise, read_table, size_bytes
from .graph import connected_components
from .shingling import mix, runs_of, shingle_sets

BROADCAST_BYTES = 16 << 20  #: a side whose files are larger than this is shuffled


@dataclass(frozen=True)
class JoinOptions:
    percent: int = 75  #: two documents link when 100 * intersection >= percent * union
    shingle: int = 5
    groups: int = 128  #: fewest coordinates of a point; it has about a quarter of its set's size,
    most_groups: int = 1 << 16  #: as a power of two, but not more than these
    leaf: int = 32
    fan_out: int = 16
    tile: int = 1024  #: sets of a tree beyond which it is cut into tiles
    fit_documents: int = 8_000  #: about so many documents fit the order of shingles
    fit_seen: int = 3  #: seen in so many of them, a shingle counts as frequent
    fit_entries: int = 200_000  #: the most frequent are kept


def enough(options: JoinOptions, overlap, x, y):
    """Does the overlap of sets of x and y shingles reach the threshold?  (In whole numbers.)"""
    return (100 + options.percent) * overlap >= options.percent * (x + y)


class CountTree:
    """An R-tree over count vectors, packed bottom-up in order of set size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, marks: np.ndarray, options: JoinOptions):
        """``marks``: points with the same mark need not be paired."""
        self.options = options
        self.order = np.lexsort((points.argmax(axis=1), sizes))
        self.rank = np.argsort(self.order)
        self.points, self.sizes, self.marks = points[self.order], sizes[self.order], marks[self.order]
        edges = np.arange(0, len(points), options.leaf)
        level = self._node_level(edges, self.points, self.sizes, self.sizes, self.marks, self.marks)
        self.levels = [level]
        while len(level["high"]) > 1:
            edges = np.arange(0, len(level["high"]), options.fan_out)
            level = self._node_level(edges, level["high"], level["least"], level["most"], level["low_mark"], level["high_mark"])
            self.levels.append(level)

    @staticmethod
    def _node_level(edges, high, least, most, low_mark, high_mark) -> dict:
        return {
            "high": np.maximum.reduceat(high, edges, axis=0),
            "least": np.minimum.reduceat(least, edges),
            "most": np.maximum.reduceat(most, edges),
            "low_mark": np.minimum.reduceat(low_mark, edges),
            "high_mark": np.maximum.reduceat(high_mark, edges),
        }

    def _possible(self, a: dict, i: int, b: dict, js: np.ndarray) -> np.ndarray:
        """Those of the nodes ``js`` of ``b`` that may hold a partner for a point of node i of ``a``."""
        o = self.options
        bound = np.minimum(a["high"][i], b["high"][js]).sum(axis=1, dtype=np.int64)
        like = (o.percent * b["least"][js] <= 100 * a["most"][i]) & (o.percent * a["least"][i] <= 100 * b["most"][js])
        mixed = (a["low_mark"][i] != a["high_mark"][i]) | (b["low_mark"][js] != b["high_mark"][js]) | (a["low_mark"][i] != b["low_mark"][js])
        return js[like & mixed & enough(o, bound, a["least"][i], b["least"][js])]

    def pairs(self) -> Iterator[tuple[int, np.ndarray]]:
        """For each point those points (by the constructor's numbering) whose bound reaches the threshold and whose
        mark differs, each pair once: the tree joined with itself, level by level."""
        yield from self._descend(len(self.levels) - 1, 0, np.array([0]))

    def _descend(self, depth: int, i: int, js: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        level = self.levels[depth]
        js = self._possible(level, i, level, js)
        if not len(js):
            return
        if depth == 0:
            yield from self._leaves(i, js)
            return
        fan, below = self.options.fan_out, len(self.levels[depth - 1]["high"])
        children = (js[:, None] * fan + np.arange(fan)).ravel()
        children = children[children < below]
        for child in range(i * fan, min((i + 1) * fan, below)):
            yield from self._descend(depth - 1, child, children[children <= child])

    def _leaves(self, i: int, js: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        o = self.options
        for p in range(i * o.leaf, min((i + 1) * o.leaf, len(self.points))):
            q = (js[:, None] * o.leaf + np.arange(o.leaf)).ravel()
            q = q[q < p]
            q = q[(self.marks[q] != self.marks[p]) & (o.percent * self.sizes[p] <= 100 * self.sizes[q])]  # q < p, so q is no larger
            if len(q):
                bound = np.minimum(self.points[p], self.points[q]).sum(axis=1, dtype=np.int64)
                q = q[enough(o, bound, self.sizes[p], self.sizes[q])]
                if len(q):
                    yield int(self.order[p]), self.order[q]

    def connect(self, a: int, b: int) -> None:
        """Give the groups of two points (by the constructor's numbering) one mark, so that their pairs are skipped from now on."""
        x, y = self.marks[self.rank[a]], self.marks[self.rank[b]]
        self.marks[self.marks == max(x, y)] = min(x, y)

    def connected(self, a: int, b: int) -> bool:
        return self.marks[self.rank[a]] == self.marks[self.rank[b]]


def group_count(n: int, options: JoinOptions) -> int:
    """Coordinates of the point of a set of n shingles."""
    return min(options.most_groups, max(options.groups, 1 << max(0, (n // 4).bit_length() - 1)))


def point_of(hashes: np.ndarray, options: JoinOptions) -> np.ndarray:
    count = group_count(len(hashes), options)
    return np.bincount((mix(hashes) & np.uint64(count - 1)).astype(np.int64), minlength=count)


def pack_point(point: np.ndarray) -> bytes:
    """In as few bytes a count as the largest needs."""
    most = point.max(initial=0)
    return point.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes()


def unpack_point(packed: bytes, n: int, options: JoinOptions) -> np.ndarray:
    return np.frombuffer(packed, dtype={1: "<u1", 2: "<u2", 4: "<u4"}[len(packed) // group_count(n, options)])


def folded(point: np.ndarray, count: int) -> np.ndarray:
    """The point with fewer coordinates: groups whose numbers agree modulo ``count`` are one."""
    return point.reshape(-1, count).sum(axis=0, dtype=np.int64)


def fine_bound(x: np.ndarray, y: np.ndarray) -> int:
    """Bound of the overlap at the finest grouping that both points have."""
    count = min(len(x), len(y))
    return int(np.minimum(folded(x, count), folded(y, count)).sum())


def _links(points: np.ndarray, sizes: np.ndarray, sides: np.ndarray, options: JoinOptions, linked) -> list[tuple[int, int]]:
    """Links by which ``linked`` pairs connect; of sides 0 and 1, each pairs with the other alone."""
    if len(points) < 2:
        return []
    tree = CountTree(points, sizes, np.arange(len(points)), options)
    links = []
    for a, others in tree.pairs():
        for b in others[(sides[others] != sides[a]) | (sides[a] == 2)].tolist():
            if not tree.connected(a, b) and linked(a, b):
                links.append((a, b))
                tree.connect(a, b)
    return links


def candidate_links(packed: list[bytes], sizes: np.ndarray, sides: np.ndarray, options: JoinOptions) -> list[tuple[int, int]]:
    """Links between sets that their points' bounds cannot keep apart."""
    fine = [unpack_point(p, int(n), options) for p, n in zip(packed, sizes.tolist(), strict=True)]
    coarse = np.stack([folded(p, options.groups) for p in fine])
    return _links(coarse, sizes, sides, options, lambda a, b: bool(enough(options, fine_bound(fine[a], fine[b]), int(sizes[a]), int(sizes[b]))))


def exact_links(packed: list[bytes], sizes: np.ndarray, sides: np.ndarray, options: JoinOptions) -> list[tuple[int, int]]:
    """Links between sets (sorted hashes) that reach the threshold."""
    sets = [np.frombuffer(p, dtype=np.uint64) for p in packed]
    groups = min(2048, max(options.groups, 1 << int(np.median(sizes)).bit_length()))
    points = np.stack([np.bincount((mix(s) & np.uint64(groups - 1)).astype(np.int64), minlength=groups) for s in sets])
    points = points.astype(np.int16 if points.max() < 1 << 15 else np.int64)
    return _links(points, sizes, sides, options, lambda a, b: bool(enough(options, len(np.intersect1d(sets[a], sets[b], assume_unique=True)), int(sizes[a]), int(sizes[b]))))


def _sets(column: pa.Array, options: JoinOptions) -> Iterator[np.ndarray]:
    """The shingle set of each value of a binary column."""
    for run in runs_of(column):
        yield from shingle_sets([v or b"" for v in run.to_pylist()], options.shingle)


def _signature(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    with np.errstate(over="ignore"):
        return int(mix(hashes).sum(dtype=np.uint64)), int(mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Identity of a document: two independent hashes of its id and text."""
    return [F.xxhash64(F.lit(i), F.col(id_col), F.col(text_col)).alias(f"r{i}") for i in (1, 2)]


def describe_sets(docs: DataFrame, options: JoinOptions) -> DataFrame:
    """(r1, r2, id) with the set's size n, signature s1, s2 and point; reads columns r1, r2, id, body."""
    id_type = docs.schema["id"].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, s1, s2, points = [], [], [], []
            for hashes in _sets(batch.column(3), options):
                first, second = _signature(hashes)
                sizes.append(len(hashes))
                s1.append(first)
                s2.append(second)
                points.append(pack_point(point_of(hashes, options)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sizes, pa.int64()), _signed(s1), _signed(s2), pa.array(points, pa.binary())],
                names=["r1", "r2", "id", "n", "s1", "s2", "point"],
            )

    return docs.select("r1", "r2", "id", "body").mapInArrow(describe, f"r1 long, r2 long, id {id_type}, n long, s1 long, s2 long, point binary")


def frequent_shingles(docs: DataFrame, total: int, options: JoinOptions) -> np.ndarray:
    """Hashes of frequent shingles, most frequent first, from a bounded sample."""
    sample = docs.select("body").filter(F.rand(7) < min(1.0, options.fit_documents / max(1, total)))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes in _sets(batch.column(0), options):
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], names=["h"])

    counted = sample.mapInArrow(emit, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= options.fit_seen)
    rows = counted.orderBy(F.desc("n"), "h").limit(options.fit_entries).collect()  # at most fit_entries hashes
    return np.array([r["h"] for r in rows], dtype=np.int64).view(np.uint64)


class PrefixOrder:
    """The global order of shingles: unlisted ones by hash, then the frequent ones, most frequent last."""

    def __init__(self, frequent: np.ndarray):
        by = np.argsort(frequent, kind="stable")
        self.table = frequent[by]
        self.place = len(frequent) - by  # larger: less frequent comes first
        self.maybe = np.zeros(1 << 22, dtype=bool)
        self.maybe[(frequent & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def prefix(self, hashes: np.ndarray, percent: int) -> np.ndarray:
        """First n - ceil(percent n / 100) + 1 shingles of a sorted set."""
        n = len(hashes)
        size = n - -(-percent * n // 100) + 1 if n else 0
        hit = np.flatnonzero(self.maybe[(hashes & np.uint64((1 << 22) - 1)).astype(np.int64)])
        if len(hit):
            at = np.minimum(np.searchsorted(self.table, hashes[hit]), max(0, len(self.table) - 1))
            known = self.table[at] == hashes[hit]
            hit, at = hit[known], at[known]
        if not len(hit):
            return hashes[:size]
        rare = np.delete(hashes, hit)
        if len(rare) >= size:
            return rare[:size]
        common = hashes[hit][np.argsort(self.place[at], kind="stable")]
        return np.concatenate((rare, common))[:size]


def tree_members(docs: DataFrame, frequent: np.ndarray, options: JoinOptions) -> DataFrame:
    """(key, s1) of all sets that share a prefix shingle with another set, each once."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = PrefixOrder(frequent)
        for batch in batches:
            keys, owners, held = [], [], 0
            seen: set[int] = set()  # copies within a batch are emitted once; what is left of them goes when keys are sorted
            for hashes in _sets(batch.column(0), options):
                if not len(hashes):
                    continue
                name, _ = _signature(hashes)
                if name in seen:
                    continue
                seen.add(name)
                prefix = order.prefix(hashes, options.percent)
                keys.append(prefix)
                owners.append(np.full(len(prefix), name, dtype=np.uint64))
                held += len(prefix)
                if held > 500_000:
                    yield _two_longs(keys, owners)
                    keys, owners, held = [], [], 0
            if keys:
                yield _two_longs(keys, owners)

    postings = docs.select("body").mapInArrow(emit, "key long, s1 long")
    sorted_keys = postings.repartition("key").sortWithinPartitions("key", "s1")
    return sorted_keys.mapInArrow(_shared_only, "key long, s1 long")


def _two_longs(keys: list[np.ndarray], owners: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners).view(np.int64))], names=["key", "s1"])


def _shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a stream sorted by (key, s1), the distinct rows whose key has several s1.  Holds one row between batches."""
    last: tuple[int, int] | None = None  # last row seen
    sent = False  # whether it has been passed on
    for batch in batches:
        keys, owners = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if last is not None:
            keys, owners = np.concatenate(([last[0]], keys)), np.concatenate(([last[1]], owners))
        if not len(keys):
            continue
        new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])))
        keys, owners = keys[new], owners[new]
        same = keys[1:] == keys[:-1]
        keep = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        if last is not None and sent:
            keep[0] = False
            sent_last = True if len(keys) == 1 else bool(keep[-1])
        else:
            sent_last = bool(keep[-1])
        last, sent = (int(keys[-1]), int(owners[-1])), sent_last
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(owners[keep])], names=["key", "s1"])


def _rebuilt_sets(names: DataFrame, classes: DataFrame, docs: DataFrame, options: JoinOptions) -> DataFrame:
    """(s1, hashes) of the named sets, made again from each class's first document."""
    wanted = materialise(classes.join(names, "s1").select("r1", "r2", "s1"), "wanted")
    if size_bytes(wanted) <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[tuple[int, int]] = set()  # rows that repeat within a batch are sent once
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            new = [i for i, k in enumerate(keys) if k not in seen and not seen.add(k)]
            some = batch.take(pa.array(new, pa.int64()))
            sets = [h.tobytes() for h in _sets(some.column(2), options)]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sets, pa.binary())], names=["s1", "hashes"])

    chosen = docs.join(wanted, ["r1", "r2"]).select("s1", "r1", "body")
    return chosen.mapInArrow(rebuild, "s1 long, hashes binary").repartition("s1").dropDuplicates(["s1", "hashes"])


def _trees(named: DataFrame, options: JoinOptions) -> DataFrame:
    """(tree, side, s1) of distinct (name, s1): a tree for each name, or for each pair of tiles of a large one."""
    tiles = named.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("name", F.ceil(F.col("n") / options.tile).cast("int").alias("tiles"))
    placed = named.join(tiles, "name").withColumn("tile", F.pmod(F.xxhash64("s1"), F.col("tiles")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tree = F.xxhash64("name", F.least("tile", "other"), F.greatest("tile", "other"))
    side = F.when(F.col("tile") == F.col("other"), F.lit(2)).when(F.col("tile") < F.col("other"), F.lit(0)).otherwise(F.lit(1))
    return dealt.select(tree.alias("tree"), side.alias("side"), "s1")


def _search(trees: DataFrame, linker, options: JoinOptions) -> DataFrame:
    """Links (a, b) found in the trees.  Rows: tree, side, s1, n, packed; a tree's rows are brought together."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the rows of one tree, at most two tiles
        for batch in batches:
            if not batch.num_rows:
                continue
            tree = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(tree[1:] != tree[:-1]) + 1).tolist(), batch.num_rows]
            if held and held[0].column(0)[0].as_py() != int(tree[0]):
                yield from links_of(held)
                held = []
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                held.append(batch.slice(low, high - low))
                if high < batch.num_rows:
                    yield from links_of(held)
                    held = []
        if held:
            yield from links_of(held)

    def links_of(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows)
        sides, names, sizes = (table.column(i).to_numpy() for i in (1, 2, 3))
        links = np.array(linker(table.column(4).to_pylist(), sizes, sides, options), dtype=np.int64).reshape(-1, 2)
        if len(links):
            yield pa.RecordBatch.from_arrays([pa.array(names[links[:, 0]]), pa.array(names[links[:, 1]])], names=["a", "b"])

    return trees.repartition("tree").sortWithinPartitions("tree").mapInArrow(search, "a long, b long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: JoinOptions = JoinOptions()) -> DataFrame:
    """One row a document: r1, r2 (identity), id, n, component_id, component (a name of its component; null for an empty set)."""
    rows = docs.select(*row_key(id_col, text_col), F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("body"))
    described = materialise(describe_sets(rows, options), "sets")
    filled = described.filter("n > 0")
    merged = filled.groupBy("s1", "s2").agg(F.min("id").alias("low"), F.min(F.struct("r1", "r2")).alias("r"), F.max("n").alias("n"), F.max("point").alias("point"))
    classes = materialise(merged.select("s1", "s2", "low", "r.r1", "r.r2", "n", "point"), "classes")
    total = described.count()
    frequent = frequent_shingles(rows, total, options)
    members = materialise(tree_members(rows, frequent, options), "members")

    hubs = members.groupBy("key").agg(F.min("s1").alias("hub"))
    named = materialise(members.join(hubs, "key").select(F.col("hub").alias("name"), "s1").distinct(), "named")
    points = classes.select("s1", "n", F.col("point").alias("packed"))
    likely = _search(_trees(named, options).join(points, "s1").select("tree", "side", "s1", "n", "packed"), candidate_links, options)
    families = connected_components(materialise(likely, "likely")).select(F.col("component").alias("name"), F.col("node").alias("s1"))
    sets = _rebuilt_sets(families.select("s1"), classes, rows, options).select("s1", (F.length("hashes") / 8).cast("long").alias("n"), F.col("hashes").alias("packed"))
    sure = _search(_trees(families, options).join(sets, "s1").select("tree", "side", "s1", "n", "packed"), exact_links, options)
    groups = connected_components(materialise(sure, "links"))

    rooted = classes.join(groups, F.col("s1") == F.col("node"), "left").select("s1", "s2", "low", F.coalesce("component", "s1").alias("root"), "component")
    lowest = rooted.filter(F.col("component").isNotNull()).groupBy("root").agg(F.min("low").alias("lowest"))
    named = materialise(rooted.join(lowest, "root", "left").select("s1", "s2", "root", F.coalesce("lowest", "low").alias("component_id")), "components")
    told = described.select("r1", "r2", "id", "n", "s1", "s2").join(named, ["s1", "s2"], "left")
    return told.select("r1", "r2", "id", "n", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), F.col("root").alias("component"))


def keep_one_of_each_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: JoinOptions = JoinOptions()) -> DataFrame:
    """``docs`` with the document of the smallest id (null last) of each component, once; empty sets all stay."""
    found = materialise(jaccard_components(docs, id_col, text_col, options), "joined").filter("n > 0")
    copies = materialise(found.groupBy("component", "id", "r1", "r2").agg(F.count(F.lit(1)).alias("copies")), "copies")
    rank = F.struct(F.col("id").isNull().alias("null_id"), F.col("id").alias("id"), F.col("r1").alias("r1"), F.col("r2").alias("r2"))
    kept = copies.groupBy("component").agg(F.min(rank).alias("kept"))
    told = copies.join(kept, "component").withColumn("stays", (F.col("r1") == F.col("kept.r1")) & (F.col("r2") == F.col("kept.r2")))
    notes = materialise(told.filter(~F.col("stays") | (F.col("copies") > 1)).select("r1", "r2", "stays"), "notes")
    names = {k: fresh_name(docs, f"__{k}") for k in ("r1", "r2", "stays")}
    keyed = docs.withColumns(dict(zip((names["r1"], names["r2"]), row_key(id_col, text_col), strict=True)))
    renamed = notes.select(*(F.col(k).alias(v) for k, v in names.items()))
    noted = keyed.join(F.broadcast(renamed) if size_bytes(notes) <= BROADCAST_BYTES else renamed, [names["r1"], names["r2"]], "left")
    single = noted.filter(F.col(names["stays"]).isNull())
    if not notes.filter("stays").isEmpty():  # rows that repeat: one of them stays
        single = single.unionByName(noted.filter(names["stays"]).dropDuplicates([names["r1"], names["r2"]]))
    return single.drop(*names.values())


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = jaccard_components(docs)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")

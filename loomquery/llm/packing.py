"""Best-fit packing by hierarchical residuals.

Every input partition packs its own pieces by best fit (longest first, each into
the fullest bin that still holds it), run by run.  Bins that are nearly full become
final sequences at once.  All others go up a tree: a level deals the open bins to
nodes of about ``node_bins`` each, every node packs its bins again as items, and
what is still open goes on to the next level, until one node holds all of them or a
level finds nothing to merge.  No bin is closed for want of space in a task: the
size of a task is set by the number of nodes.

Only (bin, length) pairs move through the tree; pieces stay where they are and
are joined to their bin's place at the end.

Defined results: a null text is an empty one and becomes the closing id alone;
repeated rows are packed each; an empty table gives no sequences; other columns
of the documents are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import make_room, materialise, read_table

END_ID = 0


@dataclass(frozen=True)
class PackOptions:
    capacity: int = 2048
    slack: int = 4  #: a bin with at most so much room left is nearly full
    local_bytes: int = 16 << 20  #: about so many bytes of items are packed at once; a larger partition is packed in several runs
    node_bins: int = 1 << 16  #: open bins that one node of the tree packs


def tokenizer_path() -> str:
    """The byte-level vocabulary of the public tokenizers; a parameter everywhere else."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids exactly as the vocabulary file's own tokenizer gives them.

    Text whose characters are all below U+0250 (their Unicode classes are fixed
    since long) and that names no special token goes to an equivalent, faster
    byte-pair encoder when the same vocabulary lies beside the file as ranks;
    everything else goes to the tokenizer itself.
    """

    def __init__(self, path: str):
        self.path, self.full = path, None  # the tokenizer is loaded when a text needs it
        self.fast = None
        self.plain = re.compile(r"[^\x00-ɏ]|<\|")
        ranks_path = path.removesuffix(".json") + ".tiktoken"
        try:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        except (ImportError, OSError):
            pass  # no ranks beside the file: the tokenizer does all the work

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and not self.plain.search(text):
            found = self.fast.encode_ordinary(text)
        else:
            if self.full is None:
                from tokenizers import Tokenizer

                self.full = Tokenizer.from_file(self.path)
            found = self.full.encode(text, add_special_tokens=False).ids
        return np.fromiter(found, dtype="<u4", count=len(found))


def tokenize_pieces(docs: DataFrame, path: str | None = None, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut every document's ids (closed by id 0) into pieces: id, piece, start, length, ids.

    ``ids`` is binary, unsigned 32-bit little-endian.  Only documents longer than
    ``capacity`` are cut; the first piece takes the remainder.
    """
    rows = docs.select(F.col(id_col), F.col(text_col))
    id_type = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(_cutter(path, capacity, id_col), _PIECE.format(id_col=id_col, id_type=id_type))


_PIECE = "`{id_col}` {id_type}, piece int, start long, length long, ids binary"


def _cutter(path: str | None, capacity: int, id_col: str):
    """From batches of (id, text) to batches of pieces."""
    path = tokenizer_path() if path is None else path

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder(path)
        for batch in batches:
            owner, piece, start, length, ids, held = [], [], [], [], [], 0

            def emit() -> pa.RecordBatch:
                keys = batch.column(0).take(pa.array(owner, pa.int64()))
                return pa.RecordBatch.from_arrays(
                    [keys, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                    names=[id_col, "piece", "start", "length", "ids"],
                )

            for row, text in enumerate(batch.column(1)):
                whole = np.append(encoder.ids(text.as_py() or ""), np.array([END_ID], dtype="<u4"))
                at, number = 0, 0
                while at < len(whole):
                    size = (len(whole) - at) % capacity if at == 0 else capacity
                    size = size or capacity
                    owner.append(row)
                    piece.append(number)
                    start.append(at)
                    length.append(size)
                    ids.append(whole[at : at + size].astype("<u4").tobytes())
                    at, number, held = at + size, number + 1, held + size
                if held > 2_000_000:  # bounds the Arrow batch
                    yield emit()
                    owner, piece, start, length, ids, held = [], [], [], [], [], 0
            if owner:
                yield emit()

    return cut


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, longest first: (bin of each item, offset of each item, filled length of each bin)."""
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    filled: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: some bin has exactly r left
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        above = open_rooms >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            where = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
        else:
            where, room = len(filled), capacity
            filled.append(0)
        bins[item], offsets[item] = where, filled[where]
        filled[where] += size
        left = room - size
        if left:
            by_room[left].append(where)
            open_rooms |= 1 << left
    return bins, offsets, np.array(filled, dtype=np.int64)


def best_fit_pack(items: DataFrame, length_col: str = "length", options: PackOptions = PackOptions()) -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset``; lengths must be 1 to ``capacity``.  A column that has a name of the result's gets a trailing underscore."""
    items = make_room(items, "sequence_id", "offset", "__bin", "__at", "__filled")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    packed = items.mapInArrow(_local_packer(items.columns.index(length_col), options), f"{fields}, {_PLACE}")
    return _merged(materialise(packed, "packed"), items.columns, options)


_PLACE = "__bin long, __at long, __filled long"


def _local_packer(at: int, options: PackOptions):
    """From batches of items, whose column ``at`` is the length, to the same with each item's place in its partition's bins."""
    capacity = options.capacity

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held, size, used = [], 0, 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size > options.local_bytes:
                used += yield from pack(held, part, used)
                held, size = [], 0
        if held:
            yield from pack(held, part, used)

    def pack(held: list[pa.RecordBatch], part: int, used: int):
        lengths = np.concatenate([b.column(at).to_numpy(zero_copy_only=False) for b in held]).astype(np.int64)
        if lengths.min() < 1 or lengths.max() > capacity:
            raise ValueError("an item's length lies outside 1..capacity")
        bins, offsets, filled = best_fit(lengths, capacity)
        first = (part << 33) + used + bins
        done = 0
        for b in held:
            rows = slice(done, done + b.num_rows)
            done += b.num_rows
            extra = [pa.array(first[rows]), pa.array(offsets[rows]), pa.array(filled[bins[rows]])]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, "__bin", "__at", "__filled"])
        return len(filled)

    return local


def _merged(packed: DataFrame, columns: list[str], options: PackOptions) -> DataFrame:
    """The tree: merges the open bins of locally packed items and gives each item its final place."""
    full = options.capacity - options.slack
    bins = packed.filter(F.col("__filled") < full).groupBy("__bin").agg(F.first("__filled").alias("filled"))
    level = bins.select("__bin", F.col("__bin").alias("root"), F.lit(0).cast("long").alias("base"), "filled")
    level = materialise(level, "open")
    done: list[DataFrame] = []  # bins that no later level touches
    left, depth = level.count(), 0
    while left:
        nodes = -(-left // options.node_bins)
        dealt = level.withColumn("node", F.pmod(F.xxhash64("root", F.lit(depth)), F.lit(nodes)).cast("int"))
        level = materialise(dealt.groupBy("node").applyInArrow(_merger(options), level.schema), "level")
        # A merged bin keeps the smallest name of its parts, so the rows that name themselves are the bins.
        merged = left - level.filter("__bin = root").count()
        if nodes == 1 or not merged:
            break
        done.append(level.filter(F.col("filled") >= full))
        level = level.filter(F.col("filled") < full)
        left, depth = level.filter("__bin = root").count(), depth + 1
    places = reduce(DataFrame.unionByName, done, level)
    return packed.join(places.select("__bin", "root", "base"), "__bin", "left").select(
        *columns,
        F.coalesce("root", "__bin").alias("sequence_id"),
        (F.col("__at") + F.coalesce("base", F.lit(0))).alias("offset"),
    )


def _merger(options: PackOptions):
    """One node of the tree: packs its open bins as items."""
    capacity = options.capacity

    def merge(table: pa.Table) -> pa.Table:
        bins, root, base, filled = (table.column(c).to_numpy() for c in ("__bin", "root", "base", "filled"))
        roots, first, of = np.unique(root, return_index=True, return_inverse=True)
        where, offset, total = best_fit(filled[first], capacity)
        leader = np.full(len(total), np.iinfo(np.int64).max)
        np.minimum.at(leader, where, roots)
        new = where[of]
        return pa.table([pa.array(bins), pa.array(leader[new]), pa.array(base + offset[of]), pa.array(total[new])], names=["__bin", "root", "base", "filled"])

    return merge


def pack_documents(docs: DataFrame, path: str | None = None, options: PackOptions = PackOptions(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed pieces with their token ids: id, piece, start, length, ids, sequence_id, offset."""
    rows = docs.select(F.col(id_col), F.col(text_col))
    id_type = rows.schema[0].dataType.simpleString()
    cut, local = _cutter(path, options.capacity, id_col), _local_packer(3, options)
    schema = f"{_PIECE.format(id_col=id_col, id_type=id_type)}, {_PLACE}"
    packed = rows.mapInArrow(lambda batches: local(cut(batches)), schema)  # in one pass, so the ids go to the JVM once
    return _merged(materialise(packed, "packed"), [id_col, "piece", "start", "length", "ids"], options)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    pieces = tokenize_pieces(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return best_fit_pack(pieces)

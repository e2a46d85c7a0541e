"""Quality scores by compression.

Two zstandard dictionaries are built, one of texts labelled good and one of texts
labelled bad.  A text that is like the good ones compresses better with the good
dictionary.  The difference of the two compressed sizes, normalised by size, goes
through a logistic calibration fitted on labelled texts that neither dictionary has
seen.  Nothing else decides a score: without the dictionaries all scores are one.

The fit uses a bounded sample of labelled rows (``QualityOptions``): at most
about ``fit_rows`` a class, chosen by hash.  The two dictionaries and the weights
are some 2 MB whatever the corpus holds.  Scoring is a narrow map over every whole
text.

Defined results: null and empty texts score like an empty text; a label row
whose document is missing, or with a null label, is not learned from; documents
that repeat are scored each; without rows of both classes every score is the
share of class 1 (0.5 without any rows).  A payload column named ``score`` or
``predicted`` gets a trailing underscore.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held_out, make_room, materialise, read_table, release

DIFFERENCE_SCALE = 2000  # bytes of text over which the size difference is a rate


@dataclass(frozen=True)
class QualityOptions:
    fit_rows: int = 6_000  #: labelled texts a class that are learned from: half for dictionaries, half for calibration
    dictionary_bytes: int = 1 << 20  #: of a class's whole texts, joined in order of a hash
    level: int = 9


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    level: int
    constant: float | None = None  #: the score of all texts, where nothing could be learned


class Compressors:
    """The two compressors of a model, set up once for a task."""

    def __init__(self, good: bytes, bad: bytes, level: int):
        plain = {"level": level, "write_content_size": False, "write_dict_id": False, "write_checksum": False}

        def load(data: bytes) -> zstandard.ZstdCompressionDict:
            loaded = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            loaded.precompute_compress(level=level)
            return loaded

        self.good = zstandard.ZstdCompressor(dict_data=load(good), **plain)
        self.bad = zstandard.ZstdCompressor(dict_data=load(bad), **plain)

    def features(self, text: bytes) -> tuple[float, float]:
        """The size difference as a share of the size, and as a rate of the text's bytes."""
        good, bad = (len(c.compress(text)) for c in (self.good, self.bad))
        return ((bad - good) / max(bad, good), (bad - good) / min(len(text) + 1, DIFFERENCE_SCALE))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> np.ndarray:
    """Weights (intercept first) by Newton's method with a little shrinkage."""
    z = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _features_of(texts: pa.Array, pack: Compressors) -> np.ndarray:
    return np.array([pack.features(v.as_py() or b"") for v in texts]).reshape(-1, 2)


def fit_quality(docs: DataFrame, labels: DataFrame, options: QualityOptions = QualityOptions(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Fit on a bounded sample of the labelled documents.  The driver gets the texts of the two dictionaries, no more than
    these hold and one text each, and two numbers for each text of the calibration."""
    usable = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    usable = usable.withColumn("bucket", F.shiftrightunsigned(F.xxhash64("id"), 11))
    counts = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    limit = F.lit(1 << 53)
    for label, n in counts.items():
        if n > options.fit_rows:
            limit = F.when(F.col("label") == label, F.lit(-(-(options.fit_rows << 53) // n))).otherwise(limit)
    chosen = usable.filter(F.col("bucket") < limit).select("id", "label").distinct()
    texts = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    # `chosen` has at most about 2 * fit_rows ids, so it may be broadcast whatever the corpus holds.  An id of many rows gives one text.
    found = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    fold = F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(2)).cast("int")
    found = materialise(found.select("id", "label", "text", fold.alias("fold")), "fit")
    sizes = {(r["fold"], r["label"]): r["n"] for r in found.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).collect()}  # four rows
    if len(sizes) < 4:
        ones, rows = sum(n for (_, y), n in sizes.items() if y), sum(sizes.values())
        return QualityModel(b"", b"", (), (), (), options.level, ones / rows if rows else 0.5)

    earlier = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.octet_length("text")).over(earlier), F.lit(0))
    first = found.filter("fold = 0").withColumn("before", before).filter(F.col("before") < options.dictionary_bytes)
    rows = first.select("before", "label", F.substring("text", 1, options.dictionary_bytes).alias("text")).orderBy("label", "before").collect()
    good, bad = ((b"\n".join(bytes(r["text"]) for r in rows if r["label"] == label)[: options.dictionary_bytes] or b"\n") for label in (1, 0))

    def calibrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = Compressors(good, bad, options.level)
        for batch in batches:
            x = _features_of(batch.column(1), pack)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x[:, 0]), pa.array(x[:, 1])], names=["label", "share", "rate"])

    told = found.filter("fold = 1").select("label", "text").mapInArrow(calibrate, "label int, share double, rate double").collect()  # about fit_rows rows
    told = sorted((r["label"], r["share"], r["rate"]) for r in told)
    x, y = np.array([t[1:] for t in told]), np.array([t[0] for t in told], dtype=float)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    weights = _logistic((x - mean) / scale, y)
    release(found)
    return QualityModel(good, bad, tuple(mean), tuple(scale), tuple(weights), options.level)


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", payload: list[str] | None = None, threshold: float = 0.7) -> DataFrame:
    """``payload`` columns with ``score`` and ``predicted``."""
    payload = [c for c in docs.columns if c != text_col] if payload is None else payload
    docs = docs.select(F.col(text_col).alias("__body"), *payload)
    docs, text_col = make_room(docs, "score", "predicted"), "__body"
    payload = docs.columns[1:]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = Compressors(model.good, model.bad, model.level) if model.constant is None else None
        for batch in batches:
            if pack is None:
                values = np.full(batch.num_rows, model.constant)
            else:
                x = _features_of(batch.column(0), pack)
                z = (x - model.mean) / model.scale @ np.array(model.weights[1:]) + model.weights[0]
                values = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(values)], names=[*payload, "score"])

    chosen = docs.select(F.col(text_col).cast("binary").alias("__body"), *payload)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[1:]] + ["score double"])
    scored = chosen.mapInArrow(score, schema)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    model = fit_quality(docs, labels)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return score_quality(rows, model, payload=["doc_id", "held_out"])

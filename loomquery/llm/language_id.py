"""Language identification by rank-order profiles (Cavnar and Trenkle, 1994).

A profile is a language's most frequent character n-grams in rank order.  A
document's own most frequent n-grams are compared with each profile by the
out-of-place distance: for each n-gram the difference of its two ranks, or the
profile's length if the profile lacks it.  The nearest language wins, ties going
to the smaller name.

Text is lower-cased, everything that is no letter separates words, words are
padded with one space on each side, and an n-gram never spans two words.

Profiles are learned from text and non-null labels only.  N-grams are counted
inside the map tasks, so that a task sends one row for each distinct (language,
n-gram), whatever the size of its input.  Learning may stop at a bounded number
of documents a language (``ProfileOptions.fit_documents``); it is a bound on the
training sample alone, and prediction reads every whole text.

Defined results: a null text or one without letters gives ``und`` with score 0,
and so does every text when no language was learned; a null label is not
learned from; a null id is not held out; repeated rows each get their own answer.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_name, held_out, make_room, read_table
from .shingling import runs_of

UNDETERMINED = "und"
_CODES = 0x110000
_letters: np.ndarray | None = None


@dataclass(frozen=True)
class ProfileOptions:
    max_n: int = 3  #: longest n-gram
    profile_size: int = 400  #: n-grams in a language's profile
    document_size: int = 300  #: n-grams of a document that are compared
    fit_documents: int = 20_000  #: about so many training documents a language, chosen by hash; a language with fewer gives all
    chunk_chars: int = 1 << 18  #: characters counted at once, which bounds a worker's memory


def _is_letter() -> np.ndarray:
    """Per code point: a letter?  The table is built once for a worker."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(_CODES)), dtype=bool, count=_CODES)
    return _letters


def _code_points(text: str) -> np.ndarray:
    """Letters of the lower-cased text, with one 0 before, between and after words."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    points = np.where(_is_letter()[raw], raw, 0)
    points = np.concatenate(([0], points, [0]))
    keep = (points != 0) | np.concatenate(([True], points[:-1] != 0))
    return points[keep].astype(np.int64)


class Grams:
    """Counted n-grams of a chunk of documents: parallel arrays sorted by document, then n-gram."""

    def __init__(self, texts: Iterable[str], max_n: int):
        parts = [_code_points(t) for t in texts]
        points = np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        flags = np.zeros(_CODES, dtype=bool)
        flags[points] = True
        flags[0] = True
        self.alphabet = np.flatnonzero(flags)  # ascending, 0 first: order of codes is order of code points
        self.base = len(self.alphabet) + 1
        self.max_n = max_n
        if len(parts) * float(self.base) ** max_n >= 2.0**63:
            raise OverflowError("chunk too large for its alphabet")
        rank = np.zeros(_CODES, dtype=np.int64)
        rank[self.alphabet] = np.arange(1, self.base)
        dense = rank[points]  # 1 is the space, 0 is "no character"
        space = dense == 1
        keys = []
        code = np.zeros(len(dense), dtype=np.int64)
        valid = np.ones(len(dense), dtype=bool)
        for n in range(1, max_n + 1):
            size = len(dense) - n + 1
            if size <= 0:
                break
            code = code[:size] * self.base + dense[n - 1 :]
            valid = valid[:size] & (owner[:size] == owner[n - 1 :])
            if n > 2:  # the character before the last may no longer be a space
                valid &= ~space[n - 2 : n - 2 + size]
            ok = valid & ~(space[:size] & space[n - 1 :]) if n <= 2 else valid
            shift = self.base ** (max_n - n)
            keys.append(owner[:size][ok] * self.base**max_n + code[ok] * shift)
        flat = np.concatenate(keys) if keys else np.empty(0, dtype=np.int64)
        unique, self.counts = np.unique(flat, return_counts=True)
        self.owners, self.codes = np.divmod(unique, self.base**max_n)

    def spell(self, codes: np.ndarray) -> list[str]:
        """The n-grams as text, spaces as spaces."""
        digits = []
        for _ in range(self.max_n):
            codes, digit = np.divmod(codes, self.base)
            digits.append(digit)
        points = np.concatenate(([0], self.alphabet))
        points[1] = ord(" ")
        columns = [points[d] for d in reversed(digits)]
        return ["".join(chr(c) for c in row if c) for row in zip(*(c.tolist() for c in columns), strict=True)]

    def encode(self, grams: list[str]) -> np.ndarray:
        """Codes of n-grams in this chunk's alphabet; -1 for those that cannot occur in it."""
        where = {int(p): i + 1 for i, p in enumerate(self.alphabet)}
        where[ord(" ")] = 1
        out = np.full(len(grams), -1, dtype=np.int64)
        for i, gram in enumerate(grams):
            digits = [where.get(ord(c)) for c in gram]
            if None not in digits and len(digits) <= self.max_n:
                code = 0
                for d in digits + [0] * (self.max_n - len(digits)):
                    code = code * self.base + d
                out[i] = code
        return out

    def ranked(self, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, n-gram code, rank from 0) of each document's ``most`` most frequent n-grams; ties in order of code points."""
        order = np.lexsort((self.codes, -self.counts, self.owners))
        owners, codes = self.owners[order], self.codes[order]
        first = np.concatenate(([True], owners[1:] != owners[:-1])) if len(owners) else np.empty(0, dtype=bool)
        start = np.maximum.accumulate(np.where(first, np.arange(len(owners)), 0)) if len(owners) else np.empty(0, dtype=np.int64)
        rank = np.arange(len(owners)) - start
        keep = rank < most
        return owners[keep], codes[keep], rank[keep]


def _chunks(texts: list[str], chars: int, max_n: int) -> Iterator[tuple[int, int, Grams]]:
    """Counted runs of documents, each of about ``chars`` characters; a chunk with a huge alphabet is halved."""
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) <= chars):
            size += len(texts[end])
            end += 1
        while True:
            try:
                grams = Grams(texts[start:end], max_n)
                break
            except OverflowError:
                if end - start == 1:
                    raise
                end = start + (end - start) // 2
        yield start, end, grams
        start = end


def out_of_place(texts: list[str], profiles: dict[str, list[str]], options: ProfileOptions = ProfileOptions()) -> tuple[list[str], list[float]]:
    """Nearest language and score of each text.  The score is 1 less the mean displacement as a share of the profile size."""
    names = sorted(profiles)
    best, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    if not names:
        return best, scores
    penalty = options.profile_size
    for start, end, grams in _chunks(texts, options.chunk_chars, options.max_n):
        owners, codes, ranks = grams.ranked(options.document_size)
        size = end - start
        used = np.bincount(owners, minlength=size)
        distance = np.empty((len(names), size))
        for i, name in enumerate(names):
            known = grams.encode(profiles[name])
            by = np.argsort(known, kind="stable")
            table = known[by]
            at = np.minimum(np.searchsorted(table, codes), len(table) - 1)
            found = table[at] == codes
            moved = np.where(found, np.minimum(np.abs(by[at] - ranks), penalty), penalty)
            distance[i] = np.bincount(owners, weights=moved, minlength=size)
        nearest = distance.argmin(axis=0)
        for d in np.flatnonzero(used):
            best[start + d] = names[nearest[d]]
            scores[start + d] = 1.0 - float(distance[nearest[d], d]) / (penalty * int(used[d]))
    return best, scores


def fit_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", options: ProfileOptions = ProfileOptions(), sample_key: Column | None = None) -> dict[str, list[str]]:
    """Learn a profile for each label of ``docs``.  Only profile_size n-grams a language reach the driver.

    ``sample_key`` decides by its hash which documents are learned from when a
    language has more than ``fit_documents``; by default the text.
    """
    usable = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    key = F.col(text_col) if sample_key is None else sample_key
    rows = usable.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.shiftrightunsigned(F.xxhash64(key), 11).alias("bucket"))
    per_language = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    large = {k: -(-(options.fit_documents << 53) // n) for k, n in per_language.items() if n > options.fit_documents}
    if large:
        limits = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in large.items()))
        rows = rows.filter(F.col("bucket") < F.coalesce(limits[F.col("lang")], F.lit(1 << 53)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[str, str], int] = {}

        def flush() -> pa.RecordBatch:
            langs, grams = zip(*totals, strict=True) if totals else ((), ())
            out = pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(grams, pa.string()), pa.array(totals.values(), pa.int64())], names=["lang", "gram", "n"])
            totals.clear()
            return out

        for some in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            langs, texts = some.column(0).to_pylist(), some.column(1).to_pylist()
            for lang in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                for _, _, grams in _chunks(own, options.chunk_chars, options.max_n):
                    codes, inverse = np.unique(grams.codes, return_inverse=True)
                    sums = np.bincount(inverse, weights=grams.counts).astype(np.int64)
                    for gram, n in zip(grams.spell(codes), sums.tolist(), strict=True):
                        totals[lang, gram] = totals.get((lang, gram), 0) + n
                    if len(totals) > 500_000:
                        yield flush()
        yield flush()

    counted = rows.select("lang", "text").mapInArrow(count, "lang string, gram string, n long")
    summed = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = summed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= options.profile_size)
    profiles: dict[str, list[str]] = {}
    for r in sorted(top.collect(), key=lambda r: (r["lang"], r["rank"])):  # profile_size rows a language
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


def predict_language(docs: DataFrame, profiles: dict[str, list[str]], text_col: str = "text", out: tuple[str, str] = ("lang_pred", "score"), options: ProfileOptions = ProfileOptions()) -> DataFrame:
    """``docs`` with the predicted language and its score; a column that has such a name already gets a trailing underscore, all others pass through untouched."""
    docs = make_room(docs, *(n for n in out if n != text_col))

    @F.arrow_udf("lang string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        langs, scores = [], []
        for run in runs_of(texts, options.chunk_chars):
            names, values = out_of_place([t or "" for t in run.to_pylist()], profiles, options)
            langs += names
            scores += values
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    struct = fresh_name(docs, "__language")
    found = docs.withColumn(struct, predict(F.col(text_col)))
    return found.withColumns({out[0]: F.col(struct)["lang"], out[1]: F.col(struct)["score"]}).drop(struct)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    train = docs.filter(~held_out(F.col("doc_id")))
    profiles = fit_profiles(train, sample_key=F.col("doc_id"))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict_language(rows, profiles).select("doc_id", "held_out", "lang_pred", "score")

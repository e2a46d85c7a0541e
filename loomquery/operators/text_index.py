"""Positional inverted index: postings, term lookup, proximity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, position, term): lower-case words between runs of white space, positions from 0."""
    words = F.filter(F.split(F.lower(text_col), r"\s+"), lambda w: w != "")
    return docs.select(F.col(id_col), F.posexplode(words).alias("position", "term"))


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, doc_id, positions)."""
    return tokens(docs, id_col, text_col).groupBy("term", id_col).agg(F.array_sort(F.collect_list("position")).alias("positions"))


def lookup(docs: DataFrame, term: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents that have a term; none for an unknown one."""
    return tokens(docs, id_col, text_col).filter(F.col("term") == term.lower()).select(id_col).distinct()


def proximity(docs: DataFrame, first: str, second: str, distance: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with the two terms at most ``distance`` positions apart.

    A document is judged from its own words in one walk over them, which remembers
    where each term was last seen: the nearest pair of positions is always one of
    those.  Nothing is shuffled but the ids found.
    """
    one, other, body = first.lower(), second.lower(), F.lower(text_col)
    words = F.filter(F.split(body, r"\s+"), lambda w: w != "")
    nowhere = F.lit(None).cast("int")
    start = F.struct(F.lit(0).alias("i"), nowhere.alias("a"), nowhere.alias("b"), F.lit(False).alias("near"))

    def step(seen: Column, w: Column) -> Column:
        a = F.when(w == one, seen["i"]).otherwise(seen["a"])
        b = F.when(w == other, seen["i"]).otherwise(seen["b"])
        near = seen["near"] | (w.isin(one, other) & F.coalesce(F.abs(a - b) <= distance, F.lit(False)))
        return F.struct((seen["i"] + 1).alias("i"), a.alias("a"), b.alias("b"), near.alias("near"))

    both = docs.filter(F.contains(body, F.lit(one)) & F.contains(body, F.lit(other)))
    return both.filter(F.aggregate(words, start, step, lambda seen: seen["near"])).select(id_col).distinct()

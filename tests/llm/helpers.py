"""Brute-force versions and small fixtures for the corpus operators."""

from __future__ import annotations

import re
import struct

import xxhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, rows, parts=3):
    """A documents table of (doc_id, text) or (doc_id, text, lang) rows."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(parts) if full else spark.createDataFrame([], DOCS)


def xx(data: bytes, seed: int = 42) -> int:
    return xxhash.xxh64(data, seed=seed).intdigest()


def xx_int(value: int, seed: int = 42) -> int:
    """Spark's xxhash64 of an int literal."""
    return xx(struct.pack("<i", value), seed)


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def components(nodes, links):
    """Smallest node reachable from each node."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def words(text: str) -> list[str]:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def shingles(text: str | None) -> set[tuple[str, ...]]:
    w = words(text or "")
    if not w:
        return set()
    if len(w) < 5:
        return {tuple(w)}
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

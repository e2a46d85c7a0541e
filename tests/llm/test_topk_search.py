import math
import random

import pytest
from pyspark.sql import functions as F

from loomquery.llm.topk_search import NO_ID, SearchOptions, build_index, op7_topk_search, top_k

VECTORS = "vec_id long, embedding array<double>, label int"


def plain(rows, k, scale=256):
    usable = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(usable):
        if i is None or i % 50:
            continue
        held = [(max(min(sum(x * y for x, y in zip(q, v)), 2**63 - 1), -(2**63)), j) for b, (j, v) in enumerate(usable) if a != b]
        scored = sorted((-s, NO_ID if j is None else j) for s, j in held)
        out += [(i, rank + 1, None if j == NO_ID else j, -s) for rank, (s, j) in enumerate(scored[:k])]
    return sorted(out, key=str)


def search(spark, rows, options=SearchOptions(), parts=3):
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).repartition(parts)
    return sorted((tuple(r) for r in top_k(build_index(frame, options=options), F.col("id") % 50 == 0, options).collect()), key=str)


@pytest.mark.parametrize("options", [SearchOptions(), SearchOptions(block=40, query_block=3, rescore=4), SearchOptions(block=64, query_block=2, broadcast_bytes=0, rescore=0)])
def test_against_all_pairs(spark, options):
    rng = random.Random(3)
    centres = [[rng.gauss(0, 0.2) for _ in range(12)] for _ in range(9)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in rng.choice(centres)]) for i in range(700)]
    assert search(spark, rows, options) == plain(rows, options.k)


def test_own_tables(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = sorted((tuple(r) for r in op7_topk_search(spark, sf_dir).collect()), key=str)
    assert got == plain(rows, 5)


def test_ties_and_odd_rows(spark):
    one, nan, inf = [0.5, -0.25], [float("nan"), 1.0], [1.0, float("inf")]
    rows = [(i, one) for i in (9, 8, 7, 50, 100, 3, 2)] + [(0, None), (150, [None, 1.0]), (200, nan), (250, inf), (None, one), (50, one), (300, []), (11, [0.5]), (350, [1.0, 1.0, 7.0])]
    assert search(spark, rows) == plain(rows, 5)


def test_few_rows_and_none(spark):
    rows = [(0, [1.0]), (1, [2.0])]
    assert search(spark, rows) == [(0, 1, 1, 131072)]
    assert search(spark, [(0, [1.0])]) == [] and search(spark, []) == [] and search(spark, [(1, [1.0]), (2, [3.0])]) == []


def test_huge_components(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice((1e17, -3e14, 2.5e300, -1e305, 0.1)) for _ in range(3)]) for i in range(60)]
    assert search(spark, rows) == plain(rows, 5)

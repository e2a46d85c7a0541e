import random
from collections import defaultdict

import numpy as np
import pytest

from loomquery.llm.jaccard_join import CountTree, JoinOptions, PrefixOrder, enough, jaccard_components
from loomquery.llm.shingling import shingle_sets

from .helpers import components, docs_frame, shingles


def brute_force(rows):
    """Sorted (id, n, component): every pair of different sets that share a shingle is compared."""
    by_set = defaultdict(list)
    for i, t in rows:
        by_set[frozenset(shingles(t))].append(i)
    sets = list(by_set)
    holders = defaultdict(list)
    links = set()
    for x, s in enumerate(sets):
        for y in {y for g in s for y in holders[g]}:
            both = len(s & sets[y])
            if 100 * both >= 75 * len(s | sets[y]):
                links.add((y, x))
        for g in s:
            holders[g].append(x)
    group = components(range(len(sets)), links)
    low = defaultdict(list)
    for x, s in enumerate(sets):
        low[group[x]] += [i for i in by_set[s] if i is not None]
    out = []
    for x, s in enumerate(sets):
        for i in by_set[s]:
            component = i if not s else min(low[group[x]], default=None)
            out.append((i, len(s), component))
    return sorted(out, key=str)


def check(spark, rows, options=JoinOptions(), parts=3):
    frame = docs_frame(spark, rows, parts).withColumnRenamed("n_chars", "n")
    got = sorted(((r["id"], r["n"], r["component_id"]) for r in jaccard_components(frame, options=options).collect()), key=str)
    assert got == brute_force(rows)
    return got


def near_copies(seed, groups, size, words=(1, 160)):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(*words))]
        for _ in range(rng.randint(1, size)):
            copy = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 3, 5))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [JoinOptions(), JoinOptions(groups=16, most_groups=64, leaf=4, fan_out=2, tile=8, fit_seen=2)])
def test_near_copies(spark, options):
    got = check(spark, near_copies(3, 60, 9), options)
    assert len({c for *_, c in got}) < len(got)


def test_one_large_group(spark):
    check(spark, near_copies(5, 1, 1, (90, 90)) + near_copies(5, 3, 150, (90, 110)), JoinOptions(tile=32, leaf=8, fan_out=4))


def test_own_tables(spark, sf_dir):
    check(spark, [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])


def test_threshold_is_met_exactly(spark):
    base = [f"a{i}" for i in range(18)]  # 14 shingles
    rows = [(1, " ".join(base)), (2, " ".join(base[:16] + ["x", "y"])), (3, " ".join(base[:16])), (4, " ".join(base + ["z", "q", "r"]))]
    check(spark, rows)


def test_odd_rows(spark):
    long_text = " ".join(f"v{i % 9000}x{i % 7}" for i in range(60_000))
    rows = [
        (5, None), (6, ""), (7, " \t\n"), (8, "One two"), (9, "one\x0btwo"), (9, "one two"), (10, "one two three"),
        (None, "one two three"), (None, "all alone here in this line"), (11, long_text), (12, long_text + " tail"), (12, long_text),
        (13, "é È one"), (14, "É È one"), (15, "one two three four five"),
    ]
    got = check(spark, rows)
    assert (9, 1, 8) in got and (12, got[[g[0] for g in got].index(12)][1], 11) in got and (6, 0, 6) in got


def test_empty_table(spark):
    assert jaccard_components(docs_frame(spark, [])).count() == 0


def test_sets_match_plain_words():
    texts = ["a b c d e f", "", "x", "A  b\tc d E f a b c d e f", "é " * 12]
    sizes = [len(s) for s in shingle_sets([t.encode() for t in texts])]
    assert sizes == [len(shingles(t)) for t in texts]


def test_tree_keeps_every_possible_pair():
    rng = np.random.default_rng(1)
    options = JoinOptions(groups=8, leaf=4, fan_out=3)
    points = rng.poisson(rng.integers(1, 9, size=(150, 1)), size=(150, 8)).astype(np.int64)
    marks = rng.integers(0, 120, 150)
    sizes = points.sum(axis=1)
    found = {tuple(sorted((a, b))) for a, y in CountTree(points, sizes, marks, options).pairs() for b in y.tolist()}
    want = {(i, j) for j in range(150) for i in range(j) if marks[i] != marks[j] and enough(options, np.minimum(points[i], points[j]).sum(), sizes[i], sizes[j]) and 75 * max(sizes[i], sizes[j]) <= 100 * min(sizes[i], sizes[j])}
    assert found == want


def test_prefix_puts_frequent_shingles_last():
    order = PrefixOrder(np.array([5, 40, 20], dtype=np.uint64))
    assert order.prefix(np.array([5, 7, 20, 30, 40], dtype=np.uint64), 25).tolist() == [7, 30, 20, 40]

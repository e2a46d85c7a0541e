import itertools
import random

import pytest
from pyspark.sql import functions as F

from loomquery.operators import encodings, requests, schedules, text_index, vectors
from loomquery.operators.aggregates import aggregate
from loomquery.operators.joins import equi_join, filtered_by
from loomquery.operators.ordering import ordered_positions

OPS = {"r": "READ", "w": "WRITE", "c": "COMMIT", "a": "ABORT"}


def schedule(spark, text):
    """r1x w2y c1 ... as rows."""
    rows = [(i, int(s[1]), OPS[s[0]], s[2:] or None) for i, s in enumerate(text.split())]
    return spark.createDataFrame(rows, "seq long, txn long, op string, item string")


def edges(spark, text):
    return {(r["before"], r["after"]) for r in schedules.conflict_edges(schedule(spark, text)).collect()}


def test_conflicts_and_serializability(spark):
    assert edges(spark, "r1x w2x r2y w1y") == {(1, 2), (2, 1)}
    assert not schedules.is_conflict_serializable(schedule(spark, "r1x w2x r2y w1y"))
    assert schedules.is_conflict_serializable(schedule(spark, "r1x w1x r2x w2x c1 c2"))
    assert edges(spark, "r1x r2x c1 c2") == set()
    assert schedules.is_conflict_serializable(schedule(spark, "r1x r2x"))


def test_conflict_edges_against_all_pairs(spark):
    rng = random.Random(4)
    for _ in range(3):
        text = " ".join(f"{rng.choice('rw')}{rng.randint(1, 6)}{rng.choice('xyz')}" for _ in range(40))
        rows = [(int(s[1]), s[0], s[2:]) for s in text.split()]
        want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if a[2] == b[2] and a[0] != b[0] and "w" in (a[1], b[1])}
        assert edges(spark, text) == want


def reached(edges):
    """Transitive closure."""
    out = set(edges)
    while more := {(a, d) for a, b in out for c, d in out if b == c} - out:
        out |= more
    return out


def test_conflict_steps_reach_what_conflicts_do(spark):
    rng = random.Random(6)
    for moments in (60, 12):  # the second time, accesses at one moment do not conflict
        rows = [(rng.randrange(moments), rng.randint(1, 9), rng.choice(("READ", "READ", "WRITE")), rng.choice("xyz")) for _ in range(40)]
        rows += [(3, None, "WRITE", "x"), (5, 2, "WRITE", None)]
        s = spark.createDataFrame(rows, "seq long, txn long, op string, item string")
        steps, conflicts = ({tuple(r) for r in f(s).collect()} for f in (schedules.conflict_steps, schedules.conflict_edges))
        assert steps <= conflicts
        assert {p for p in reached(steps) if p[0] != p[1]} == {p for p in reached(conflicts) if p[0] != p[1]}


def test_conflict_steps_do_not_grow_with_pairs(spark):
    s = schedule(spark, "w1x").select(F.explode(F.sequence(F.lit(0), F.lit(299))).alias("seq")).select("seq", (F.col("seq") % 100).alias("txn"), F.lit("WRITE").alias("op"), F.lit("x").alias("item"))
    assert schedules.conflict_steps(s).count() == 100 < schedules.conflict_edges(s).count()


def test_deadlock(spark):
    waits = lambda *e: spark.createDataFrame(list(e), "before long, after long")
    assert schedules.has_deadlock(waits((1, 2), (2, 3), (3, 1), (4, 1)))
    assert not schedules.has_deadlock(waits((1, 2), (2, 3), (1, 3), (4, 1)))


@pytest.mark.parametrize(
    ("text", "want"),
    [("w1x r2x c2 c1", (False, False, False)), ("w1x r2x c1 c2", (True, False, False)), ("w1x c1 r2x c2", (True, True, True)), ("w1x w2x c1 c2", (True, True, False)), ("w1x a1 r2x c2", (True, True, True))],
)
def test_recovery_classes(spark, text, want):
    got = schedules.recovery_classes(schedule(spark, text))
    assert (got["recoverable"], got["cascadeless"], got["strict"]) == want


def test_timestamp_order(spark):
    got = {r["seq"]: r["accepted"] for r in schedules.timestamp_order(schedule(spark, "r2x w1x w3x r2x r4x w3x")).collect()}
    assert got == {0: True, 1: False, 2: True, 3: False, 4: True, 5: False}


def test_redo_and_undo(spark):
    log = [(1, 1, "WRITE", "x", "0", "1"), (2, 2, "WRITE", "x", "1", "2"), (3, 2, "WRITE", "y", "5", "6"), (4, 1, "COMMIT", None, None, None), (5, 3, "WRITE", "z", "7", "8")]
    state = schedules.redo_undo(spark.createDataFrame(log, "lsn long, txn long, op string, item string, before string, after string"))
    assert {r["item"]: r["value"] for r in state.collect()} == {"x": "1", "y": "5", "z": "7"}


def test_dangerous_pivots(spark):
    got = schedules.dangerous_pivots(spark.createDataFrame([(1, 2), (2, 3)], "reader long, writer long"))
    assert [r["txn"] for r in got.collect()] == [2]


def test_requests(spark):
    ops = spark.createDataFrame([(1, "k", "PUT", "a"), (2, "k", "APPEND", "b"), (3, "k", "GET", None), (4, "k", "PUT", "c"), (5, "k", "APPEND", "d"), (6, "j", "APPEND", "z")], "seq long, key string, op string, value string")
    assert {r["key"]: r["value"] for r in requests.key_value_state(ops).collect()} == {"k": "cd", "j": "z"}
    chain = spark.createDataFrame([("ok", "a"), ("ok", "ab"), ("ok", "abc"), ("bad", "a"), ("bad", "ba"), ("same", "a"), ("same", "a")], "key string, r string")
    assert {r["key"] for r in requests.broken_append_chains(chain, "key", "r").collect()} == {"bad", "same"}
    cached = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "client long, request long")
    left = requests.uncompacted(cached, spark.createDataFrame([(1, 1)], "client long, acknowledged long"), "client", "request")
    assert sorted((r["client"], r["request"]) for r in left.collect()) == [(1, 2), (2, 1)]


def test_state_search(spark):
    steps = spark.createDataFrame([(i, (i * 2) % 11) for i in range(11)] + [(i, (i + 3) % 11) for i in range(11)], "state long, next long")
    start = spark.createDataFrame([(1,)], "state long")
    distance, frontier = {1: 0}, {1}
    for d in range(1, 4):
        frontier = {n for s in frontier for n in ((s * 2) % 11, (s + 3) % 11)} - set(distance)
        distance |= {n: d for n in frontier}
    assert {r["state"]: r["distance"] for r in requests.reachable_states(start, steps, 3).collect()} == distance


def test_text_index(spark):
    docs = spark.createDataFrame([(1, "The cat  saw\tthe dog"), (2, ""), (3, None), (4, "dog cat"), (5, "cat a b c dog")], "doc_id long, text string")
    assert {(r["term"], r["doc_id"]): r["positions"] for r in text_index.postings(docs).collect()}["the", 1] == [0, 3]
    assert sorted(r["doc_id"] for r in text_index.lookup(docs, "DOG").collect()) == [1, 4, 5] and text_index.lookup(docs, "cow").count() == 0
    assert sorted(r["doc_id"] for r in text_index.proximity(docs, "cat", "dog", 3).collect()) == [1, 4]


def test_vectors(spark):
    rng = random.Random(2)
    rows = [(i, [rng.random() for _ in range(3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    want = sorted((sum((a - 0.5) ** 2 for a in v), i) for i, v in rows)[:5]
    assert [r["id"] for r in vectors.nearest(df, "id", "v", [0.5] * 3, 5).collect()] == [i for _, i in want]
    assert {r["id"] for r in vectors.in_box(df, "v", [0.1, 0.2], [0.6, 0.9]).collect()} == {i for i, v in rows if 0.1 <= v[0] <= 0.6 and 0.2 <= v[1] <= 0.9}
    with pytest.raises(KeyError):
        vectors.exact_key(df, "id", 999)


def test_encodings_round_trip(spark):
    rng = random.Random(9)
    rows = [(i, i // 10, rng.randint(-50, 50), rng.choice("abcd")) for i in range(95)]
    df = spark.createDataFrame(rows, "i long, block long, v long, s string")
    back = encodings.delta_decode(encodings.delta_encode(df, "v", "i", ["block"]).drop("v"), "i", ["block"], "v")
    assert {r["i"]: r["v"] for r in back.collect()} == {r[0]: r[2] for r in rows}
    framed = encodings.frame_of_reference(df, "v", ["block"]).collect()
    assert all(r["base"] + r["offset"] == r["v"] and 0 <= r["offset"] < 2 ** r["bits"] for r in framed)
    coded = encodings.dictionary_encode(df, "s")
    plain = encodings.dictionary_decode(coded.drop("s"), encodings.dictionary(df, "s"), "code", "s")
    assert {r["i"]: r["s"] for r in plain.collect()} == {r[0]: r[3] for r in rows}
    counts = {k: sum(r[3] == k for r in rows) for k in "abcd"}
    codes = encodings.huffman_codes(df, "s")
    assert sum(counts[k] * len(c) for k, c in codes.items()) <= 2 * len(rows)
    assert sum(2.0 ** -len(c) for c in codes.values()) == 1.0


def test_joins_and_aggregates(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k long, x string")
    right = spark.createDataFrame([(1, "p"), (1, "q"), (None, "r")], "k long, y string")
    want = sorted([(1, "a", "p"), (1, "a", "q"), (1, "b", "p"), (1, "b", "q")])
    for strategy in ("auto", "hash", "merge", "nested_loop", "broadcast"):
        assert sorted(tuple(r) for r in equi_join(left, right, ["k"], strategy).collect()) == want
    assert sorted(r["x"] for r in filtered_by(left, "k", right, "k").collect()) == ["a", "b"]
    assert aggregate(left.filter("k = 9"), [], {"n": ("COUNT", "k")}).collect() == []
    assert aggregate(left, [], {"low": ("MIN", "x"), "n": ("COUNT", "k")}).first().asDict() == {"low": "a", "n": 3}
    with pytest.raises(ValueError):
        equi_join(left, right, ["k"], "magic")


def test_anomalies(spark):
    assert [tuple(r) for r in schedules.dirty_reads(schedule(spark, "w1x r2x c1 c2")).select("txn", "item", "writer").collect()] == [(2, "x", 1)]
    assert schedules.dirty_reads(schedule(spark, "w1x c1 r2x c2")).isEmpty()
    assert [tuple(r) for r in schedules.nonrepeatable_reads(schedule(spark, "r1x w2x c2 r1x r1y r1y c1")).collect()] == [(1, "x")]
    assert schedules.nonrepeatable_reads(schedule(spark, "r1x w1x r1x c1")).isEmpty()


def test_first_committer_wins(spark):
    runs = spark.createDataFrame([(1, 0, 10), (2, 5, 8), (3, 11, 12), (4, 0, 20)], "txn long, started long, committed long")
    writes = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, "y")], "txn long, item string")
    assert [r["txn"] for r in schedules.first_committer_losers(runs, writes).collect()] == [1]


def test_a_long_chain_is_no_cycle(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(12)], "before long, after long")
    assert schedules.cyclic_nodes(chain).count() == 0
    with pytest.raises(RuntimeError):
        schedules.cyclic_nodes(chain, max_rounds=3)


def test_long_chains_settle_in_few_rounds(spark):
    """Chains before, between and after two cycles, far longer than the rounds allowed."""
    links = [(i, i + 1) for i in range(300)] + [(102, 100), (203, 200)]
    got = sorted(r["node"] for r in schedules.cyclic_nodes(spark.createDataFrame(links, "before long, after long"), max_rounds=20).collect())
    assert got == list(range(100, 204))
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(300)], "before string, after string")
    assert schedules.cyclic_nodes(chain, max_rounds=20).count() == 0


def test_peeling_in_a_task_is_the_rounds_result(spark):
    rng = random.Random(12)
    for n in (30, 60):
        links = {(rng.randrange(n), rng.randrange(n)) for _ in range(n)}
        frame = spark.createDataFrame(sorted(links), "x long, y long")
        nodes = set(range(n))
        while (rest := {v for v in nodes if any(y == v and x in nodes for x, y in links) and any(x == v and y in nodes for x, y in links)}) != nodes:
            nodes = rest
        assert {r["node"] for r in schedules._peeled(frame).collect()} == nodes


def test_reads_from_against_all_writes(spark):
    rng = random.Random(6)
    for _ in range(3):
        parts = [f"{rng.choice('rw')}{rng.randint(1, 6)}{rng.choice('xy')}" for _ in range(60)]
        for t, op in ((1, "a"), (2, "a"), (3, "c"), (4, "c"), (5, "a")):
            parts.insert(rng.randint(5, len(parts)), f"{op}{t}")
        rows = [(i, int(s[1]), s[0], s[2:]) for i, s in enumerate(parts)]
        end = {}
        for i, t, op, _ in rows:
            if op in "ac":
                end.setdefault(t, (op, i))
        want = {}
        for i, t, op, item in rows:
            if op == "r":
                valid = [(j, u) for j, u, o, x in rows if o == "w" and x == item and j < i and not (end.get(u, "c")[0] == "a" and end[u][1] < i)]
                want[i] = max(valid)[1] if valid else None
        got = schedules.reads_from(schedule(spark, " ".join(parts)))
        assert {r["seq"]: r["writer"] for r in got.collect()} == want
        loose = any(a[2] == "w" and b[2] in "rw" and a[3] == b[3] and a[1] != b[1] and a[0] < b[0] and (a[1] not in end or end[a[1]][1] > b[0]) for a in rows for b in rows)
        assert schedules.recovery_classes(schedule(spark, " ".join(parts)))["strict"] == (not loose)


def test_ordered_positions(spark):
    rng = random.Random(8)
    for rows in ([], [("a", 3)], [(str(rng.random()), rng.randint(1, 5)) for _ in range(500)]):
        df = spark.createDataFrame(rows, "v string, n long")
        total, want = 0, {}
        for v, n in sorted(rows):
            want[v] = total
            total += n
        assert {r["v"]: r["position"] for r in ordered_positions(df, "v", "n", 16).collect()} == want
        assert {r["v"]: r["position"] for r in ordered_positions(df, "v").collect()} == {v: i for i, (v, _) in enumerate(sorted(rows))}

import numpy as np

from loomquery.llm.sharding import assign_shards, jump_hash, op9_sharding, write_shards

from .helpers import docs_frame


def plain_jump(key, buckets):
    b, j = -1, 0
    while j < buckets:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_jump_hash_against_the_plain_loop():
    keys = np.random.default_rng(1).integers(0, 2**64, 2000, dtype=np.uint64)
    for buckets in (1, 2, 24, 25, 1000):
        assert jump_hash(keys, buckets).tolist() == [plain_jump(int(k), buckets) for k in keys]


def test_slots_are_gapless_and_growth_only_fills_the_new_shard(spark, sf_dir):
    rows = op9_sharding(spark, sf_dir).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))
    moved = sum(r["grown_shard"] == 24 for r in rows)
    assert 0 < moved < len(rows) / 8


def test_odd_rows(spark):
    rows = [(None, "a"), (None, None), (1, "x" * 100_000), (1, "x" * 100_000), (2, "")]
    got = assign_shards(docs_frame(spark, rows), 3).collect()
    slots = sorted((r["shard"], r["slot"]) for r in got)
    assert len(set(slots)) == 5 and len({r["shard"] for r in got if r["doc_id"] is None}) == 1
    assert len({r["shard"] for r in got if r["doc_id"] == 1}) == 1
    assert assign_shards(docs_frame(spark, [])).count() == 0


def test_clashing_names(spark):
    frame = docs_frame(spark, [(1, "a")]).withColumnRenamed("n_chars", "slot")
    assert set(assign_shards(frame).columns) == {"doc_id", "shard", "slot", "grown_shard"}


def test_written_shards_hold_every_row(spark, tmp_path):
    frame = docs_frame(spark, [(i, f"t{i}") for i in range(200)])
    write_shards(frame, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["doc_id"], r["text"]) for r in back.collect()) == [(i, f"t{i}") for i in range(200)]

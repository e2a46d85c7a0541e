import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest

from loomquery.llm.packing import Encoder, PackOptions, best_fit, best_fit_pack, op2_packing, pack_documents, tokenizer_path

from .helpers import docs_frame


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def check_layout(rows, capacity):
    """Sequences without gaps or overlaps, none too long; returns their number."""
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_own_tables(spark, sf_dir, tokenizer):
    rows = op2_packing(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sequences = check_layout(rows, 2048)
    total = sum(r["length"] for r in rows)
    assert sequences <= 1.02 * -(-total // 2048) + 1
    pieces = defaultdict(dict)
    for r in rows:
        pieces[r["doc_id"]][r["piece"]] = r
    assert set(pieces) == set(texts)
    for i, own in pieces.items():
        ids = [*tokenizer.encode(texts[i], add_special_tokens=False).ids, 0]
        assert sorted(own) == list(range(len(own))) and (len(own) == 1) == (len(ids) <= 2048)
        at = 0
        for k in range(len(own)):
            r = own[k]
            assert r["start"] == at and (k == 0 or r["length"] == 2048)
            part = ids[at : at + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += r["length"]
        assert at == len(ids)


@pytest.mark.parametrize("options", [PackOptions(), PackOptions(capacity=100, slack=0, node_bins=5, local_bytes=900), PackOptions(capacity=50, slack=10, node_bins=7)])
def test_any_lengths_pack_without_loss(spark, options):
    rng = random.Random(4)
    items = [(i, rng.choice((1, options.capacity, options.capacity // 2 + 1, rng.randint(1, options.capacity)))) for i in range(700)]
    rows = best_fit_pack(spark.createDataFrame(items, "name long, length long").repartition(9), options=options).collect()
    assert sorted((r["name"], r["length"]) for r in rows) == items
    check_layout(rows, options.capacity)


def test_best_fit_against_a_plain_search():
    rng = np.random.default_rng(3)
    for _ in range(30):
        capacity = int(rng.integers(5, 60))
        lengths = rng.integers(1, capacity + 1, int(rng.integers(0, 80)))
        bins, offsets, filled = best_fit(lengths, capacity)
        rooms = []
        for item in np.argsort(-lengths, kind="stable"):
            fits = [r for r in rooms if r >= lengths[item]]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - lengths[item])
            else:
                rooms.append(capacity - lengths[item])
        assert len(rooms) == len(filled) and sorted(capacity - filled) == sorted(rooms)


def test_odd_rows(spark, tokenizer):
    long_text = "wörd ünd more " * 30_000
    rows = [(None, None), (1, ""), (1, ""), (2, long_text), (3, "a <|endoftext|> b"), (4, "日本語 text"), (5, " \n\t ")]
    frame = docs_frame(spark, rows).withColumnRenamed("n_chars", "start")
    got = pack_documents(frame).collect()
    check_layout(got, 2048)
    assert sum(r["length"] == 1 for r in got) >= 3
    ids = defaultdict(bytes)
    for r in sorted(got, key=lambda r: r["piece"]):
        if r["doc_id"] is not None and r["doc_id"] > 1:
            ids[r["doc_id"]] += bytes(r["ids"])
    for i, text in rows[3:]:
        want = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        assert np.frombuffer(ids[i], dtype="<u4").tolist() == want
    assert pack_documents(docs_frame(spark, [])).count() == 0


def test_fast_encoder_gives_the_tokenizers_ids(tokenizer):
    rng = random.Random(8)
    encoder = Encoder(tokenizer_path())
    assert encoder.fast is not None
    alphabet = [chr(c) for c in range(1, 0x250)] + [" ", "\n", "a", "'s", "  "] * 40
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120)))
        assert encoder.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_runs_of_one_partition_merge(spark):
    rows = [(i, 1100 if i % 2 else 900) for i in range(400)]
    items = spark.createDataFrame(rows, "piece_id long, length long").orderBy("length").coalesce(1)
    for options in (PackOptions(), PackOptions(local_bytes=800), PackOptions(local_bytes=800, node_bins=50)):
        got = best_fit_pack(items, options=options).groupBy("sequence_id").sum("length").collect()
        assert len(got) == 200 or (options.node_bins == 50 and len(got) <= 210), (options, len(got))


def test_pack_empty_and_clashing_names(spark):
    items = spark.createDataFrame([(1, 5, 7)], "sequence_id long, length long, offset long")
    assert best_fit_pack(items.limit(0)).count() == 0
    (row,) = best_fit_pack(items).collect()
    assert (row["sequence_id_"], row["offset_"], row["offset"]) == (1, 7, 0)

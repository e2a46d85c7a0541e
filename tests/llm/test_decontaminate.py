import random

import numpy as np
from pyspark.sql import functions as F

from loomquery.llm.decontaminate import LeakOptions, align, op5_decontaminate, with_leaks

from .helpers import docs_frame

ITEM = "item_id long, text string"


def plain_score(item, window):
    """Best local alignment: match 2, mismatch -1, gap -1."""
    best = 0
    above = [0] * (len(window) + 1)
    for x in item:
        row = [0]
        for j, y in enumerate(window, 1):
            row.append(max(0, above[j - 1] + (2 if x == y else -1), above[j] - 1, row[-1] - 1))
        best = max(best, *row)
        above = row
    return best


def test_alignment_against_the_plain_table():
    rng = np.random.default_rng(2)
    jobs = [(rng.integers(2, 8, rng.integers(1, 14)).astype(np.uint64), rng.integers(2, 8, rng.integers(1, 40)).astype(np.uint64)) for _ in range(120)]
    for (item, window), (score, first, last) in zip(jobs, align(jobs, 500), strict=True):
        want = plain_score(item.tolist(), window.tolist())
        assert abs(score - want / (2 * len(item))) < 1e-9
        if want:
            assert plain_score(item.tolist(), window[first : last + 1].tolist()) == want


def prose(rng, n, tag):
    return [f"{tag}{rng.randrange(400)}" for _ in range(n)]


def test_exact_edited_and_clean(spark):
    rng = random.Random(1)
    items = {i: prose(rng, rng.randint(12, 50), "w") for i in range(12)}
    rows, dirty = [], set()
    for d in range(150):
        text = prose(rng, rng.randint(1, 300), "w")
        if d % 3 == 0:
            i = rng.choice(list(items))
            copy = list(items[i])
            edits = len(copy) // 8 if d % 2 else 0
            for _ in range(edits):
                k = rng.randrange(len(copy))
                copy[k : k + 1] = rng.choice(([], ["new"], [copy[k], "more"]))
            at = rng.randint(0, len(text))
            text[at:at] = copy
            dirty.add((d, i))
        rows.append((d, " ".join(text).replace(" w1", ", W1")))
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], ITEM)
    for options in (LeakOptions(), LeakOptions(block_grams=40)):  # one block of items, and many
        got = with_leaks(docs_frame(spark, rows), table, options=options).select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.*").collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == dirty
        for r in got:
            words = rows[r["doc_id"]][1].lower().replace(",", " ").split()[r["first_word"] : r["last_word"] + 1]
            assert abs(r["score"] - plain_score(items[r["item_id"]], words) / (2 * len(items[r["item_id"]]))) < 1e-9


def test_an_item_in_every_document_is_still_found(spark):
    rng = random.Random(2)
    item = prose(rng, 30, "q")
    rows = [(d, " ".join(prose(rng, 40, "w") + item)) for d in range(60)]
    table = spark.createDataFrame([(7, " ".join(item))], ITEM)
    assert with_leaks(docs_frame(spark, rows), table).filter("size(leaks) = 1").count() == 60


def test_own_tables(spark, sf_dir):
    fold = lambda t: " ".join("".join(c if c.isalnum() or ord(c) > 127 else " " for c in t.lower()).split())
    docs = {r["doc_id"]: fold(r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r["item_id"]: fold(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in op5_decontaminate(spark, sf_dir).collect()}
    exact = {(d, i) for d, t in docs.items() for i, s in items.items() if f" {s} " in f" {t} "}
    assert exact and exact <= got
    assert len({d for d, _ in got}) <= len({d for d, _ in exact}) + 2


def test_odd_rows(spark):
    item = "alpha beta gamma delta epsilon zeta"
    rows = [(None, item), (1, None), (2, ""), (3, item.upper() + "!"), (3, item), (3, item), (4, "x " * 200_000 + item), (5, "alpha beta")]
    table = spark.createDataFrame([(1, item), (1, item), (2, None), (3, "alpha beta"), (4, "")], ITEM)
    frame = docs_frame(spark, rows).withColumnRenamed("n_chars", "item_id")
    got = sorted((str(r["doc_id"]), [x["item_id"] for x in r["leaks"]]) for r in with_leaks(frame, table).collect())
    assert got == [("1", []), ("2", []), ("3", [1, 1]), ("3", [1, 1]), ("3", [1, 1]), ("4", [1, 1]), ("5", []), ("None", [1, 1])]
    assert with_leaks(docs_frame(spark, []), table).count() == 0
    assert with_leaks(docs_frame(spark, rows), spark.createDataFrame([], ITEM)).filter("size(leaks) > 0").count() == 0


def test_recall_of_edited_copies_in_own_documents(spark, sf_dir):
    """Benchmark items with some 15 % of their words replaced, dropped or doubled, put into documents that hold no item."""
    rng = random.Random(21)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    texts = {r["item_id"]: r["text"].split() for r in items.collect() if len(r["text"].split()) >= 12}
    clean = [r["text"] for r in with_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text"), items).filter("size(leaks) = 0 and length(text) > 400").collect()]
    rows = []
    for item, words in texts.items():
        copy = []
        for w in words:
            chance = rng.random()
            copy += [w] if chance > 0.15 else [rng.choice(words[::-1])] if chance > 0.08 else [] if chance > 0.04 else [w, w]
        host = rng.choice(clean).split(" ")
        at = rng.randrange(len(host))
        rows.append((item, " ".join(host[:at] + copy + host[at:])))
    got = with_leaks(spark.createDataFrame(rows, "planted long, text string").repartition(3), items, options=LeakOptions(block_grams=500)).collect()
    found = sum(r["planted"] in {x["item_id"] for x in r["leaks"]} for r in got)
    extra = sum(len({x["item_id"] for x in r["leaks"]} - {r["planted"]}) for r in got)
    assert len(got) == len(rows) >= 10 and found >= 0.9 * len(rows) and extra <= 0.1 * len(rows), (found, extra, len(rows))

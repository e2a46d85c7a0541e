from loomquery.llm.quality import QualityOptions, fit_quality, op6_quality, score_quality

from .helpers import docs_frame

LABEL = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = op6_quality(spark, sf_dir).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(rows) == 1000 and len(held) > 50
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.9 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_odd_rows(spark):
    good, bad = "plain words that follow one another in a row", "### $$$ %%% ### $$$ &&&"
    rows = [(i, f"{good} {i}" if i % 2 else f"{bad} {i}") for i in range(60)] + [(60, None), (61, ""), (None, good), (62, good * 20_000), (62, good * 20_000)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (999, 0, 0), (61, None, 0), (3, 1, 0)], LABEL)
    docs = docs_frame(spark, rows).withColumnRenamed("n_chars", "predicted").withColumnRenamed("source", "score")
    scored = score_quality(docs, fit_quality(docs, labels)).collect()
    assert len(scored) == len(rows) and all(0 <= r["score"] <= 1 for r in scored)
    by = {r["doc_id"]: r["score"] for r in scored}
    assert by[60] == by[61]
    assert by[31] > by[30]


def test_without_both_classes(spark):
    docs = docs_frame(spark, [(1, "a b c"), (2, "d e f")])
    none = spark.createDataFrame([], LABEL)
    assert {r["score"] for r in score_quality(docs, fit_quality(docs, none)).collect()} == {0.5}
    ones = spark.createDataFrame([(1, 1, 0)], LABEL)
    assert {r["score"] for r in score_quality(docs, fit_quality(docs, ones)).collect()} == {1.0}
    assert score_quality(docs_frame(spark, []), fit_quality(docs, none)).count() == 0


def test_fit_is_bounded(spark):
    docs = docs_frame(spark, [(i, f"text {i} " + "xyz "[i % 3 :] * 9) for i in range(300)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)], LABEL)
    model = fit_quality(docs, labels, QualityOptions(fit_rows=40))
    assert model.constant is None


def test_equals_plain_python(spark):
    """Scores from two dictionaries and the calibration, computed again beside the operator."""
    import numpy as np
    import zstandard

    rows = [(i, " ".join(f"{'good' if i % 2 else 'bad'}{(i * j) % 17}" for j in range(30))) for i in range(80)]
    docs = docs_frame(spark, rows)
    model = fit_quality(docs, spark.createDataFrame([(i, i % 2, 0) for i in range(80)], LABEL))
    packs = [zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False, write_checksum=False) for d in (model.good, model.bad)]
    assert b"good" in model.good and b"bad" not in model.good and b"bad" in model.bad
    for r in score_quality(docs, model).collect():
        text = dict(rows)[r["doc_id"]].encode()
        good, bad = (len(p.compress(text)) for p in packs)
        x = np.array([(bad - good) / max(bad, good), (bad - good) / min(len(text) + 1, 2000)])
        z = model.weights[0] + sum((x - model.mean) / model.scale * model.weights[1:])
        assert abs(r["score"] - 1 / (1 + np.exp(-z))) < 1e-6 and r["predicted"] == int(r["score"] >= 0.7)
        assert (bad > good) == (r["doc_id"] % 2 == 1)

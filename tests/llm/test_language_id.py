import random
from collections import Counter

from loomquery.llm.language_id import Grams, ProfileOptions, fit_profiles, op1_language_id, out_of_place, predict_language

from .helpers import docs_frame

SMALL = ProfileOptions(profile_size=40, document_size=30, chunk_chars=50)


def plain_grams(text, n=3):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    counts = Counter()
    for w in words:
        padded = f" {w} "
        for size in range(1, n + 1):
            for i in range(len(padded) - size + 1):
                gram = padded[i : i + size]
                if gram.strip() and not (size == 2 and gram == "  "):
                    counts[gram] += 1
    return counts


def plain_rank(counts, most):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], [ord(c) if c != " " else 0 for c in x[0]]))][:most]


def plain_predict(text, profiles, options):
    own = plain_rank(plain_grams(text or ""), options.document_size)
    if not own or not profiles:
        return "und", 0.0
    best = None
    for name in sorted(profiles):
        rank = {g: i for i, g in enumerate(profiles[name])}
        d = sum(min(abs(rank[g] - i), options.profile_size) if g in rank else options.profile_size for i, g in enumerate(own))
        if best is None or d < best[0]:
            best = (d, name)
    return best[1], 1 - best[0] / (options.profile_size * len(own))


def test_counts_against_plain_python():
    rng = random.Random(5)
    texts = ["".join(rng.choice("abc éß Ñ'1.\n") for _ in range(rng.randint(0, 60))) for _ in range(40)] + ["", "日本 語", "a" * 300]
    grams = Grams(texts, 3)
    got = [Counter() for _ in texts]
    for owner, gram, n in zip(grams.owners, grams.spell(grams.codes), grams.counts):
        got[owner][gram] += int(n)
    assert got == [plain_grams(t) for t in texts]


def test_prediction_against_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = fit_profiles(docs, options=SMALL)
    texts = [r["text"][:3000] for r in docs.collect()]
    for lang, grams in profiles.items():
        total = Counter()
        for r in docs.filter(docs.lang == lang).collect():
            total += plain_grams(r["text"])
        assert sorted(total[g] for g in grams) == sorted(total[g] for g in plain_rank(total, 40))
    langs, scores = out_of_place(texts, profiles, SMALL)
    for t, lang, score in zip(texts, langs, scores):
        want = plain_predict(t, profiles, SMALL)
        assert lang == want[0] and abs(score - want[1]) < 1e-9


def test_held_out_accuracy(spark, sf_dir):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = [r for r in op1_language_id(spark, sf_dir).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in rows) >= 0.97 * len(rows)


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "", None), (None, "the the the", None), (5, "123 !!", "de"), (5, "und der", None), (6, "the and " * 100_000, None)]
    docs = docs_frame(spark, rows).withColumnRenamed("n_chars", "lang_pred_")
    profiles = fit_profiles(docs)
    assert set(profiles) == {"en", "de"}
    got = {(r["doc_id"], r["text"] and r["text"][:9]): (r["found"], r["score"]) for r in predict_language(docs, profiles, out=("found", "score")).collect()}
    assert got[3, None] == ("und", 0.0) and got[4, ""] == ("und", 0.0) and got[5, "123 !!"] == ("und", 0.0)
    assert got[None, "the the t"][0] == "en" and got[5, "und der"][0] == "de" and got[6, "the and t"][0] == "en"
    assert all(0 <= s <= 1 for _, s in got.values())


def test_nothing_learned_and_empty_table(spark):
    docs = docs_frame(spark, [(1, "some text", None)])
    assert fit_profiles(docs) == {}
    assert predict_language(docs, {}).first()["lang_pred"] == "und"
    assert predict_language(docs_frame(spark, []), {"en": ["e"]}).count() == 0


def test_bounded_fit_keeps_small_languages(spark):
    rows = [(i, f"wort{i} und der", "de") for i in range(400)] + [(1000 + i, "the and", "en") for i in range(3)]
    assert set(fit_profiles(docs_frame(spark, rows), options=ProfileOptions(fit_documents=50))) == {"de", "en"}

import random
import re

from pyspark.sql import functions as F

from loomquery.llm.secrets import BASE_RULES, EXTRA_RULES, RULES, Rule, findings_by_path, op3_secrets, read_ledger, scan_unseen, scan_versions

from .helpers import docs_frame

NAME = "(?:" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
PLAIN = [
    ("assign", re.compile(f"({NAME.replace('_?', '_?')})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
    ("github", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"), 0, 1),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 0, 1),
    ("pem", re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"), 0, 1),
    ("slack", re.compile(r"xox[abposr]-[A-Za-z0-9-]{10,}"), 0, 1),
]


def plain_spans(text, rules=PLAIN):
    found = []
    for order, (kind, pattern, group, least) in enumerate(rules):
        for m in pattern.finditer(text or ""):
            if len(m.group(group)) >= least:
                found.append((m.start(), order, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(found)]


def spans(row):
    return [(f["kind"], f["start"], f["end"]) for f in row["findings"]]


def soup(seed, n):
    rng = random.Random(seed)
    bits = ["password", "Secret", "TOKEN", "api_key", "apiKey", "passwd", "=", ":", " ", "  ", '"', "'", "é", "😀", "\n", "abc123", "x" * 7, "AKIA", "AKIAAKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "ghp_" + "a" * 36, "eyJhbGciOi9.eyJzdWIiOi9.abcdefgh1", "-----BEGIN RSA PRIVATE KEY-----", "xoxb-1234567890", "-", ".", "token=abc", "ſecret=abcdef", "K"]
    return [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))) for i in range(n)]


def test_against_plain_search(spark, tmp_path):
    rows = soup(3, 400)
    got = scan_versions(docs_frame(spark, rows), str(tmp_path / "ledger"), payload=["doc_id"]).collect()
    texts = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        assert spans(r) == plain_spans(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_own_tables(spark, sf_dir):
    import hashlib

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op3_secrets(spark, sf_dir).collect():
        base = plain_spans(texts[r["doc_id"]], PLAIN[:3])
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(b[0] == k for b in base) for k in ("assign", "access", "hex")]


def test_only_unseen_pairs_are_scanned(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    first, second = soup(5, 40), soup(6, 40)
    scan_unseen(docs_frame(spark, first), ledger, BASE_RULES)
    blobs = len({t for _, t in first})
    assert read_ledger(spark, ledger).count() == blobs
    scan_unseen(docs_frame(spark, first), ledger, BASE_RULES)
    assert read_ledger(spark, ledger).count() == blobs  # nothing new was read
    newer = (*BASE_RULES[:2], Rule("hex", r"[0-9a-f]{8,}", version=2))
    scan_unseen(docs_frame(spark, first + second), ledger, newer)
    rescanned = [r["rules"] for r in read_ledger(spark, ledger).collect()]
    assert rescanned.count(["hex@2"]) == blobs
    assert rescanned.count(["assign@1", "access@1", "hex@2"]) == len({t for _, t in second} - {t for _, t in first})
    plain = [*PLAIN[:2], ("hex", re.compile("[0-9a-f]{8,}"), 0, 1)]
    texts = {("a", i): t for i, t in first} | {("b", i): t for i, t in second}
    both = docs_frame(spark, first).withColumn("source", F.lit("a")).union(docs_frame(spark, second).withColumn("source", F.lit("b")))
    for r in findings_by_path(both, ledger, newer, ["source", "doc_id"]).collect():
        assert spans(r) == plain_spans(texts[r["source"], r["doc_id"]], plain)


def test_an_unfinished_run_is_ignored(spark, tmp_path):
    ledger = tmp_path / "ledger"
    scan_unseen(docs_frame(spark, soup(7, 5)), str(ledger))
    (run,) = list(ledger.iterdir())
    (run / "_SUCCESS").unlink()
    assert read_ledger(spark, str(ledger)).count() == 0


def test_odd_rows(spark, tmp_path):
    key = "token = 0123456789abcdef0123456789abcdef"
    rows = [(None, key), (1, None), (1, key), (1, key), (2, ""), (3, "é" * 100_000 + key + (" " + "a1" * 12) * 3_000)]
    frame = docs_frame(spark, rows).withColumnRenamed("n_chars", "findings_")
    got = sorted(((r["doc_id"] or 0, spans(r)) for r in scan_versions(frame, str(tmp_path / "ledger"), RULES, ["doc_id"]).collect()), key=str)
    assert got == sorted(((i or 0, plain_spans(t)) for i, t in rows), key=str)
    assert scan_versions(docs_frame(spark, []), str(tmp_path / "none"), payload=["doc_id"]).count() == 0


def test_order_of_rules_is_the_readers(spark, tmp_path):
    docs = docs_frame(spark, [(1, "password=abcdef123 ghp_" + "a" * 36), (2, "deadbeef" * 4)]).withColumnRenamed("source", "findings").withColumnRenamed("lang", "blob")
    ledger = f"file://{tmp_path}/ledger"
    scan_unseen(docs, ledger, EXTRA_RULES + BASE_RULES)
    rows = findings_by_path(docs, ledger, RULES).collect()
    for r in rows:
        assert r["blob_"] == "en" and r["findings_"] == "s"
        assert all(RULES[f["ord"]].key == f["rule"] for f in r["findings"]) and r["findings"]

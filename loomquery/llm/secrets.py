"""Secret scanning over an incremental blob ledger.

Every version of a file is addressed by the SHA-256 of its text.  Equal versions
are one blob, however many paths hold it, and the ledger says which rule versions
have already been run over a blob.  A scan reads only the blobs that lack some
rule version, runs just the missing rules, appends what it found (also that
nothing was found) to the ledger, and joins the findings back to all paths.

DataFrame functions only.  Positions come from splitting a text at a rule's
matches: the lengths of the parts and of the matches, summed up in order, are
the offsets in code points.  Copies of a blob collapse before the shuffle.

A ledger is a folder with one Parquet table a run: blob, rules (name@version),
findings.  Runs that did not finish are ignored, and running again repeats
nothing that an earlier run recorded.

Defined results: a null text is an empty one; rows that repeat, and paths with
several versions, each get their findings; a null path is a value like any
other; an empty table gives an empty result; columns outside the payload are not read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import make_room, materialise, read_table, scratch_path


@dataclass(frozen=True)
class Rule:
    """A pattern; group ``size_group`` of a match must have at least ``min_size`` characters."""

    kind: str
    pattern: str
    size_group: int = 0
    min_size: int = 1
    literals: tuple[str, ...] = ()  #: a text without any of these (compared in lower case) cannot match
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


BASE_RULES = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, ("akia",)),
    Rule("hex", r"[0-9a-f]{24,}"),  # the same runs as [0-9a-f]+ of at least 24
)

EXTRA_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", literals=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", literals=("eyj",)),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", literals=("-----begin ",)),
    Rule("slack", r"xox[abposr]-[A-Za-z0-9-]{10,}", literals=("xoxa-", "xoxb-", "xoxp-", "xoxo-", "xoxs-", "xoxr-")),
)

RULES = BASE_RULES + EXTRA_RULES

_FINDING = "struct<start:bigint,ord:int,kind:string,end:bigint,rule:string>"


def blob_address(text: Column) -> Column:
    """Binary SHA-256 of a text; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _raw_matches(rule: Rule, text: Column, lowered: Column, due: Column) -> Column:
    """Per match: the length of the text before it (from the last match on), its own, and that of the size group."""
    regex = F.lit(rule.pattern)
    before = F.transform(F.split(text, rule.pattern, -1), F.char_length)
    whole = F.transform(F.regexp_extract_all(text, regex, 0), F.char_length)
    sized = F.transform(F.regexp_extract_all(text, regex, rule.size_group), F.char_length)
    rows = F.transform(F.arrays_zip(whole.alias("whole"), sized.alias("sized"), F.slice(before, F.lit(1), F.size(whole)).alias("before")), lambda m: F.struct(m["before"].alias("before"), m["whole"].alias("whole"), m["sized"].alias("sized")))
    possible = due
    if rule.literals:
        possible = possible & reduce(lambda x, y: x | y, [F.contains(lowered, F.lit(x)) for x in rule.literals])
    possible = possible & F.regexp_like(text, regex)
    return F.when(possible, rows).otherwise(F.array().cast("array<struct<before:int,whole:int,sized:int>>"))


def _finished_runs(spark: SparkSession, ledger: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(ledger)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    runs = [s.getPath().toString() for s in files.listStatus(root) if s.isDirectory()]
    return sorted(r for r in runs if files.exists(jvm.org.apache.hadoop.fs.Path(f"{r}/_SUCCESS")))


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """All finished runs: blob, rules, findings.  One row for each blob and run that scanned it."""
    schema = f"blob binary, rules array<string>, findings array<{_FINDING}>"
    runs = _finished_runs(spark, ledger)
    return spark.read.schema(schema).parquet(*runs) if runs else spark.createDataFrame([], schema)


def scan_unseen(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> None:
    """Run the rules over the blobs of ``versions`` that the ledger does not have them for, and append the findings."""
    spark = versions.sparkSession
    wanted = F.array(*(F.lit(r.key) for r in rules))
    text = F.coalesce(F.col(text_col), F.lit(""))
    blobs = versions.select(blob_address(F.col(text_col)).alias("blob"), text.alias("text")).groupBy("blob").agg(F.max("text").alias("text"))
    if _finished_runs(spark, ledger):
        seen = read_ledger(spark, ledger).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("due", F.when(F.col("seen").isNull(), wanted).otherwise(F.array_except(wanted, "seen"))).filter(F.size("due") > 0)
    else:
        blobs = blobs.withColumn("due", wanted)
    blobs = blobs.select("blob", "text", "due", F.lower("text").alias("lowered"))
    found = blobs.select(
        "blob",
        "due",
        *(_raw_matches(r, F.col("text"), F.col("lowered"), F.array_contains("due", r.key)).alias(f"m{i}") for i, r in enumerate(rules)),
    )
    raw = materialise(found, "matches")
    parts = []
    for order, rule in enumerate(rules):
        single = raw.filter(F.size(f"m{order}") > 0).select("blob", F.posexplode(f"m{order}").alias("i", "m"))
        parts.append(single.select("blob", F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), F.lit(rule.key).alias("rule"), F.lit(rule.min_size).alias("least"), "i", "m.before", "m.whole", "m.sized"))
    matches = reduce(DataFrame.unionAll, parts)
    so_far = Window.partitionBy("blob", "ord").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = (
        matches.withColumn("end", F.sum((F.col("before") + F.col("whole")).cast("long")).over(so_far))
        .filter(F.col("sized") >= F.col("least"))
        .select("blob", F.struct((F.col("end") - F.col("whole")).alias("start"), "ord", "kind", "end", "rule").alias("finding"))
        .groupBy("blob")
        .agg(F.array_sort(F.collect_list("finding")).alias("findings"))
    )
    entries = raw.select("blob", F.col("due").alias("rules")).join(spans, "blob", "left")
    findings = F.coalesce("findings", F.array().cast(f"array<{_FINDING}>"))
    entries.select("blob", "rules", findings.alias("findings")).write.option("compression", "zstd").parquet(f"{ledger}/{uuid.uuid4().hex}")


def findings_by_path(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, payload: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """Every row of ``versions``: its ``payload`` columns, blob and findings (sorted by start, then in the order of ``rules``; possibly empty).

    A payload column named ``blob`` or ``findings`` gets a trailing underscore.
    """
    payload = [c for c in versions.columns if c != text_col] if payload is None else payload
    keys = F.array(*(F.lit(r.key) for r in rules))
    # The ledger's order of rules is that of some earlier scan; this reader's is its own.
    current = F.transform(
        F.filter("findings", lambda f: F.array_contains(keys, f["rule"])),
        lambda f: F.struct(f["start"].alias("start"), (F.array_position(keys, f["rule"]) - 1).cast("int").alias("ord"), f["kind"].alias("kind"), f["end"].alias("end"), f["rule"].alias("rule")),
    )
    hits = (
        read_ledger(versions.sparkSession, ledger)
        .select(F.col("blob").alias("__hit"), current.alias("__found"))
        .filter(F.size("__found") > 0)
        .groupBy("__hit")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("__found")))).alias("__found"))
    )
    rows = make_room(versions.select(blob_address(F.col(text_col)).alias("__blob"), *payload), "blob", "findings")
    payload = rows.columns[1:]
    joined = rows.join(hits, F.col("__blob") == F.col("__hit"), "left")
    empty = F.array().cast(f"array<{_FINDING}>")
    return joined.select(*payload, F.col("__blob").alias("blob"), F.coalesce("__found", empty).alias("findings"))


def scan_versions(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, payload: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """Scan what is new and return the findings of all rows."""
    scan_unseen(versions, ledger, rules, text_col)
    return findings_by_path(versions, ledger, rules, payload, text_col)


def span_text(findings: Column) -> Column:
    """``kind:start:end`` of each finding, comma-joined."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = scan_versions(docs, scratch_path(spark, "ledger"), payload=["doc_id"])
    base = F.filter("findings", lambda f: f["ord"] < len(BASE_RULES))

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *(count(r.kind) for r in BASE_RULES),
        F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"),
        span_text(F.col("findings")).alias("spans"),
    )

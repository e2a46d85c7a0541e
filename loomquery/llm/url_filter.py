"""URL filtering by a path-template tree.

Per host, paths become templates in two steps.  Lexically, runs of digits and
hexadecimal ids turn into ``<n>`` and ``<h>``.  Then the tree is walked from the
root down: the children of a node whose label mix (blocked, allowed, unlabelled) is
near that of their siblings and no significant departure from it merge into a
wildcard branch, and so do, for each label, those whose pages all have it.  A template is rejected when the
smoothed share of blocked pages among its labelled ones is high enough.  Rules
label the pages; where a rule fits a page, the rule's own action is the verdict.

One aggregation and one join a level; the tree is never collected, and a hot
host is aggregated before it is shuffled.  Segments beyond ``max_depth`` are kept
as one last segment, which is a branch like any other, so the number of levels has a
bound and nothing of a path is left out.

Defined results: a url that is null or has no ``://`` has an empty host and
path; rows that repeat are counted and answered as often as they come; an empty
table gives an empty result; the table's other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read_table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A host (with its subdomains) and a path prefix."""

    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class TreeOptions:
    max_depth: int = 8  #: levels; what lies deeper is one last segment
    merge_below: float = 9.21  #: chi-square (2 degrees, 1 %) under which branches can be alike
    merge_distance: float = 0.2  #: and the largest difference of their label shares
    prior: float = 0.5  #: blocked share that a template without labels has
    prior_weight: float = 2.0
    reject_from: float = 0.8  #: smoothed blocked share


RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def rule_column(host: Column, path: Column, rules: tuple[Rule, ...], value: str) -> Column:
    """``text`` or ``action`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):  # the longest is outermost, so it wins
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(getattr(rule, value))).otherwise(out)
    return out


def lexical_template(path: Column) -> Column:
    """The path with its numeric and hexadecimal segments generalised (a file ending stays)."""
    digits = F.regexp_replace(path, r"(?<=/)[0-9]+(?=[/.]|$)", "<n>")
    return F.regexp_replace(digits, r"(?<=/)(?=[^/]*[0-9])[0-9a-fA-F-]{8,}(?=[/.]|$)", "<h>")


def _chi_square() -> Column:
    """Homogeneity of a child (nb, na, nu) against the rest of its siblings (pb-nb, ...)."""
    n, rest = F.col("n"), F.col("pn") - F.col("n")
    terms = []
    for kind in "bau":
        child, total = F.col(f"n{kind}"), F.col(f"p{kind}")
        want, want_rest = total * n / F.col("pn"), total * rest / F.col("pn")
        term = (child - want) * (child - want) / want + (total - child - want_rest) * (total - child - want_rest) / want_rest
        terms.append(F.when((want > 0) & (want_rest > 0), term).otherwise(F.lit(0.0)))
    return reduce(lambda x, y: x + y, terms)


def _distance() -> Column:
    """Largest difference between a child's label shares and those of the rest of its siblings."""
    rest = F.col("pn") - F.col("n")
    return F.greatest(*(F.abs(F.col(f"n{k}") / F.col("n") - (F.col(f"p{k}") - F.col(f"n{k}")) / rest) for k in "bau"))


def template_tree(labelled: DataFrame, options: TreeOptions = TreeOptions()) -> DataFrame:
    """Templates of ``labelled`` (host, lexical, action): a row for each (host, lexical).

    Returns host, lexical, template, n, blocked, allowed, purity, verdict.
    """
    deep = options.max_depth
    paths = labelled.groupBy("host", "lexical").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("action") == "block", 1)).alias("nb"),
        F.count(F.when(F.col("action") == "allow", 1)).alias("na"),
    )
    split = F.split("lexical", "/")
    segments = F.when(F.size(split) > deep, F.concat(F.slice(split, 1, deep), F.array(F.array_join(F.slice(split, F.lit(deep + 1), F.size(split)), "/")))).otherwise(split)
    tree = materialise(paths.select("host", "lexical", F.lit("").alias("template"), segments.alias("segments"), "n", "nb", "na"), "tree")
    levels = tree.agg(F.max(F.size("segments")).alias("d")).first()["d"] or 0
    sums = [F.sum(c).alias(c) for c in ("n", "nb", "na")]
    pure = {"block": F.col("nb") == F.col("n"), "allow": F.col("na") == F.col("n"), "none": F.col("nb") + F.col("na") == 0}
    for level in range(levels):
        segment = F.get("segments", F.lit(level))
        children = tree.filter(F.size("segments") > level).groupBy("host", "template", segment.alias("segment")).agg(*sums)
        parents = children.groupBy("host", "template").agg(
            F.count(F.lit(1)).alias("k"), F.sum("n").alias("pn"), F.sum("nb").alias("pb"), F.sum("na").alias("pa"), *(F.count(F.when(c, 1)).alias(f"k_{name}") for name, c in pure.items())
        )
        alike = (F.col("k") > 1) & (_chi_square() < options.merge_below) & (_distance() <= options.merge_distance)
        step = F.when(alike, "*")
        for name, condition in pure.items():
            step = step.when(condition & (F.col(f"k_{name}") > 1), f"*{name}")
        step = step.otherwise(F.col("segment"))
        choice = (
            children.join(parents, ["host", "template"])
            .withColumns({"nu": F.col("n") - F.col("nb") - F.col("na"), "pu": F.col("pn") - F.col("pb") - F.col("pa")})
            .select("host", "template", "segment", step.alias("step"))
        )
        here = tree.withColumn("segment", segment)
        stepped = here.join(choice, ["host", "template", "segment"], "left")
        name = F.when(F.col("segment").isNull(), F.col("template")).otherwise(
            F.concat("template", F.lit("/" if level else ""), "step")
        )
        tree = materialise(stepped.select("host", "lexical", name.alias("template"), "segments", "n", "nb", "na"), "tree")
    purity = (F.col("blocked") + options.prior * options.prior_weight) / (F.col("blocked") + F.col("allowed") + options.prior_weight)
    templates = (
        tree.groupBy("host", "template")
        .agg(F.sum("n").alias("n_template"), F.sum("nb").alias("blocked"), F.sum("na").alias("allowed"))
        .withColumn("purity", purity)
        .withColumn("verdict", F.when(F.col("purity") >= options.reject_from, "block").otherwise("allow"))
    )
    return tree.select("host", "lexical", "template").join(templates, ["host", "template"])


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, options: TreeOptions = TreeOptions(), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge every url: id, host, path, rule, verdict, template, purity."""
    host, path = url_parts(F.col(url_col))
    parsed = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    parsed = parsed.select(
        id_col,
        "host",
        "path",
        lexical_template(F.col("path")).alias("lexical"),
        rule_column(F.col("host"), F.col("path"), rules, "text").alias("rule"),
        rule_column(F.col("host"), F.col("path"), rules, "action").alias("action"),
    )
    tree = template_tree(parsed, options).select("host", "lexical", "template", "purity", F.col("verdict").alias("learned"))
    judged = parsed.join(tree, ["host", "lexical"], "left")
    return judged.select(
        id_col, "host", "path", "rule", F.coalesce("action", "learned", F.lit("allow")).alias("verdict"), "template", F.round("purity", 6).alias("purity")
    )


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages"))

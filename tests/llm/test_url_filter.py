import re

from loomquery.llm.url_filter import RULES, Rule, TreeOptions, filter_urls, op8_url_filters, template_tree

PAGE = "page_id long, url string, html string"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], PAGE)


def plain(url, rules=RULES):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.text), default=None)


URLS = [
    "http://A.Example.COM/en/825?page=2", "https://example.com/en/7", "https://notexample.com/en/7x", "http://com/en/", "http://x.com/en", "ftp://a.net/de/8#x",
    "http://example.net/de/81", "http://b.example.net/de/9/?q=/de/", "http://org/es/", "http://x.org/ES/1", "no scheme", None, "", "://", "http://", "http:///en/1",
    "http://a.com?x=/en/", "http://a.com#/en/", "http://É.com/en/1", "a://b://c.com/en/", "http://u:p@a.com:80/en/1", "http://a.com/en/\nb", "\nhttp://a.com/en/2",
]


def test_hosts_paths_and_rules(spark):
    got = {r["page_id"]: r for r in filter_urls(pages(spark, URLS + URLS)).collect()}
    assert len(got) == 2 * len(URLS)
    for i, url in enumerate(URLS + URLS):
        host, path, rule = plain(url)
        assert (got[i]["host"], got[i]["path"]) == (host, path), url
        assert got[i]["rule"] == (rule.text if rule else None), url
        assert got[i]["verdict"] == rule.action if rule else got[i]["verdict"] in ("allow", "block")


def test_own_tables(spark, sf_dir):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = op8_url_filters(spark, sf_dir).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(urls)
    for r in rows:
        host, path, rule = plain(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule.text if rule else None)


def test_templates_learn_from_labels(spark):
    rules = (Rule("block", "a.com", "/ads/1"), Rule("allow", "a.com", "/news/1"))
    urls = [f"http://a.com/ads/{i}" for i in range(100, 160)] + [f"http://a.com/news/{i}" for i in range(100, 160)] + ["http://a.com/ads/977", "http://a.com/news/977", "http://b.com/ads/977"]
    got = {(r["host"], r["path"]): r for r in filter_urls(pages(spark, urls), rules).collect()}
    assert got["a.com", "/ads/977"]["verdict"] == "block" and got["a.com", "/ads/977"]["rule"] is None
    assert got["a.com", "/news/977"]["verdict"] == "allow" and got["b.com", "/ads/977"]["verdict"] == "allow"


def test_like_branches_merge_and_unlike_ones_stay(spark):
    rows = [("h", f"/{c}/<n>", action) for c, action in (("de", None), ("fr", None), ("es", None), ("en", "block")) for _ in range(40)]
    tree = template_tree(spark.createDataFrame(rows, "host string, lexical string, action string")).collect()
    names = {r["lexical"]: r["template"] for r in tree}
    assert names["/en/<n>"] == "/en/<n>"
    verdicts = {r["lexical"]: r["verdict"] for r in tree}
    assert verdicts["/en/<n>"] == "block" and verdicts["/de/<n>"] == "allow"


def test_deep_and_wide_paths(spark):
    urls = ["http://h.com/" + "/".join(f"s{k}" for k in range(60)) for _ in range(3)] + [f"http://h.com/x/w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = filter_urls(pages(spark, urls), options=TreeOptions(max_depth=3)).collect()
    assert len(rows) == len(urls)
    assert {r["template"] for r in rows if "/x/" in r["path"]} == {"/x/*"} or len({r["template"] for r in rows}) < 10


def test_clashing_columns_and_empty_table(spark):
    frame = pages(spark, URLS).withColumnRenamed("html", "host")
    assert filter_urls(frame).count() == len(URLS)
    assert filter_urls(pages(spark, []).withColumnRenamed("html", "verdict")).count() == 0


def test_rare_branches_merge_only_within_a_label(spark):
    rows = [("h", f"/d{i}/<n>", None) for i in range(70) for _ in range(40)] + [("h", "/en/<n>", "block")] * 3 + [("h", f"/ok{i}/<n>", "allow") for i in range(3)]
    tree = {r["lexical"]: r for r in template_tree(spark.createDataFrame(rows, "host string, lexical string, action string")).collect()}
    assert {tree[f"/d{i}/<n>"]["verdict"] for i in range(70)} == {"allow"}
    assert tree["/en/<n>"]["verdict"] == "block" and tree["/en/<n>"]["blocked"] == 3
    assert len({tree[f"/ok{i}/<n>"]["template"] for i in range(3)}) == 1


def test_rules_are_those_of_the_contract(spark):
    """The list and the verdicts are written out here, so that a wrong word in ``RULES`` shows."""
    assert {(r.action, r.text) for r in RULES} == {("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")}
    want = {
        "http://a.com/en/1": ("com/en/", "block"),
        "http://b.example.com/en/71": ("example.com/en/7", "allow"),
        "http://a.net/de/1": ("net/de/", "allow"),
        "http://net/de/": ("net/de/", "allow"),
        "http://example.net/de/9": ("net/de/", "allow"),
        "http://b.example.net/de/81": ("example.net/de/8", "block"),
        "http://a.org/es/1": ("org/es/", "block"),
    }
    got = filter_urls(pages(spark, list(want))).select("page_id", "rule", "verdict").collect()
    assert {list(want)[r["page_id"]]: (r["rule"], r["verdict"]) for r in got} == want

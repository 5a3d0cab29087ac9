"""URL filters against plain matching and plain components, with odd urls, ties and hubs."""

import re

from lodestar.llm import urlfilter
from lodestar.llm.queries import URL_RULES


def parts(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    if not m:
        return "", ""
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]


def plain_rule(host, path, rules):
    fits = [
        (-len(h + p), v != "allow", h + p, v)
        for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return min(fits)[2:] if fits else None


RULES = [*URL_RULES, ("bad.tld", "", "block"), ("ok.tld", "", "allow"), ("ab.cd", "/e", "block"), ("cd", "/e/fg", "allow")]
URLS = [
    "https://a.com/en/7", "http://example.com/en/71?x=1", "https://WWW.Example.COM/en/8#t", "https://x.example.net/de/8",
    "https://x.net/de/8", "net/de/", None, "", "https://", "https://com/en/", "https://notcom/en/", "ftp://a.org/es/?q",
    "https://a.org/es", "https://a.com?/en/", "https://ab.cd/e/fg", "https://u.com:80/en/1", "https://x.ab.cd/e/f",
    "a://b://com/en/", "https://bad.tld", "https://..com/en/",
]


def rules(spark):
    return spark.createDataFrame(RULES, "host string, path string, verdict string")


def test_rules_match_plain_matching(spark):
    rows = [(i, u, "<p>x</p>") for i, u in enumerate(URLS)] + [(0, URLS[0], None), (None, URLS[3], "")]
    pages = spark.createDataFrame([(*r, 5, "h") for r in rows], "page_id long, url string, html string, rule int, host string")
    out = sorted(map(tuple, urlfilter.judge(pages, rules(spark)).collect()), key=str)
    expected = []
    for i, u, _ in rows:
        host, path = parts(u)
        best = plain_rule(host, path, RULES)
        expected.append((i, host, path, best[0] if best else None, best[1] if best else "allow", False))
    assert out == sorted(expected, key=str)


def test_aliases_take_over_blocks_and_allows_go_first(spark):
    def canonical(to):
        return f"<head><LINK href='{to}' rel=canonical></head>"

    pages = [
        (1, "https://one.xy/a", canonical("https://bad.tld/x")),
        (2, "http://two.xy/b#f", canonical("//one.xy/a")),
        (3, "https://three.xy/c?x=1&y=2", '<meta http-equiv="refresh" content="0; URL=\'http://two.xy/b\'">'),
        (4, "https://four.xy/q/r", canonical("../z")),
        (5, "https://five.xy/", canonical("https://bad.tld/y")),
        (6, "https://six.xy/", canonical("https://five.xy/")),
        (7, "https://ok.tld/", canonical("https://six.xy/")),
        (8, "https://eight.xy/", "<a href='https://bad.tld/'>no alias</a> canonical"),
        (9, "https://bad.tld/z", canonical("https://ok.tld/k")),
        (10, "https://ten.xy/", canonical("https://TEN.xy/")),
        *((100 + i, f"https://hub{i}.xy/", canonical("https://one.xy/a")) for i in range(300)),
    ]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    redirects = spark.createDataFrame([("https://eleven.xy/", "https://hub7.xy/")], "src_url string, dst_url string")
    more = frame.union(spark.createDataFrame([(11, "https://eleven.xy/", "")], frame.schema))
    out = {r.page_id: r.verdict for r in urlfilter.judge(more, rules(spark), redirects).collect()}
    blocked = {1, 2, 3, 9, 11, *range(100, 400)}
    assert {i for i, v in out.items() if v == "block"} == blocked


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert urlfilter.judge(pages, rules(spark)).collect() == []
    some = spark.createDataFrame([(1, "https://a.com/en/", "")], "page_id long, url string, html string")
    assert urlfilter.judge(some, rules(spark).limit(0)).first().verdict == "allow"

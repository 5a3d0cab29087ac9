"""URL filters: rules by host and path, and redirect equivalence for urls that no rule names.

A rule fits its host, every subdomain, and paths that start with its own; the longest rule
that fits decides. Redirects and canonical links make urls aliases of one another: within a
connected component of those links, urls without a rule share a verdict, which is block if a
rule blocks a member and no rule allows one. An allow is explicit and goes before a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK_TAGS = r"(?is)<(?:link|meta)\b[^>]*>"
CANONICAL = r"(?is)\brel\s*=\s*[\"']?\s*canonical\b"
REFRESH = r"(?is)\bhttp-equiv\s*=\s*[\"']?\s*refresh\b"
HREF = r"(?is)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
TARGET = r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s>;]+)"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; empty without."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(url: Column) -> Column:
    """A url without scheme and fragment, its host lower-cased; null without ``://``."""
    rest = F.regexp_extract(url, "://[^/?#]*([^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(F.lit("://"), host_of(url), rest))


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, path, rule, verdict`` of the distinct hosts and paths that a rule fits.

    ``rules`` has ``host, path, verdict``. Each host's last labels, as many as any rule has,
    meet each prefix of the path as long as some rule's path: plain equality, so a host
    with many rules or many pages makes no pairs beyond the rules that fit. Equal lengths go
    to allow, then to the rule first in order.
    """
    known = rules.where("host is not null and path is not null").select(
        F.col("host").alias("r_host"),
        F.col("path").alias("r_path"),
        (F.length("host") + F.length("path")).alias("size"),
        (F.col("verdict") == "allow").alias("allowed"),
        F.concat("host", "path").alias("rule"),
    )
    shape = known.agg(
        F.max(F.size(F.split("r_host", "[.]"))), F.sort_array(F.collect_set(F.length("r_path")))
    ).first()
    labels, lengths = shape[0] or 0, F.array(*(F.lit(n) for n in shape[1])).cast("array<int>")
    held = F.least(F.size(F.split("host", "[.]")), F.lit(labels))
    tries = (
        urls.select("host", "path")
        .distinct()
        .withColumn("labels", F.explode(F.when(held > 0, F.sequence(F.lit(1), held))))
        .withColumn("cut", F.explode(F.filter(lengths, lambda n: n <= F.length("path"))))
        .select(
            "host",
            "path",
            F.expr("substring_index(host, '.', -labels)").alias("r_host"),
            F.expr("substring(path, 1, cut)").alias("r_path"),
        )
    )
    # The least of (-size, not allowed, rule) is the longest, allow before block.
    best = F.min(F.struct((-F.col("size")).alias("size"), (~F.col("allowed")).alias("blocked"), "rule")).alias("best")
    return (
        tries.join(known, ["r_host", "r_path"])
        .groupBy("host", "path")
        .agg(best)
        .select(
            "host", "path", "best.rule", F.when(F.col("best.blocked"), "block").otherwise("allow").alias("verdict")
        )
    )


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``src, dst`` keys: canonical links and refresh redirects in the whole html of each page.

    Relative targets are resolved against the page's url.
    """
    url, html = F.col(url_col), F.col(html_col)
    some = pages.where(F.contains(url, F.lit("://")) & html.rlike("(?i)canonical|http-equiv"))
    tags = some.select(
        F.col(url_col).alias("url"), F.explode(F.regexp_extract_all(html, F.lit(LINK_TAGS), F.lit(0))).alias("tag")
    )
    href = F.concat(*(F.regexp_extract("tag", HREF, g) for g in (1, 2, 3)))
    target = F.when(F.col("tag").rlike(CANONICAL), href).when(
        F.col("tag").rlike(REFRESH), F.regexp_extract("tag", TARGET, 1)
    )
    raw = tags.withColumn("to", F.replace(F.trim(target), F.lit("&amp;"), F.lit("&"))).where("to != ''")
    site = F.concat(F.lit("://"), host_of(F.col("url")))
    folder = F.regexp_extract(path_of(F.col("url")), "^(.*/)", 1)
    whole = (
        F.when(F.contains("to", F.lit("://")), F.col("to"))
        .when(F.startswith("to", F.lit("//")), F.concat(F.lit(":"), "to"))
        .when(F.startswith("to", F.lit("/")), F.concat(site, "to"))
        .otherwise(F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), "to"))
    )
    return raw.select(key_of(F.col("url")).alias("src"), key_of(whole).alias("dst")).distinct()


def alias_verdicts(links: DataFrame, rules: DataFrame) -> DataFrame:
    """``key`` of every url in a component of ``links`` that is blocked, and ``blocked`` (true)."""
    found = settle(components(links, "src", "dst"), "aliases")
    named = found.select("node", "component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path"))
    ruled = named.join(matched(named, rules), ["host", "path"])
    state = ruled.groupBy("component").agg(F.bool_or(F.col("verdict") == "allow").alias("allowed"))
    bad = settle(state.where("not allowed").select("component", F.lit(True).alias("blocked")), "blocked")
    return found.join(bad, "component").select(F.col("node").alias("key"), "blocked")


def judge(
    pages: DataFrame,
    rules: DataFrame,
    redirects: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """``<id_col>, host, path, rule, verdict, alias`` of every page.

    ``verdict`` is the longest fitting rule's; without one it is block for an alias of a
    blocked url, else allow. ``redirects`` (``src_url, dst_url``) adds known redirects to the
    links in the html. A null url, or one without ``://``, has an empty host and path and is
    allowed. Repeated rows stay; an empty table gives an empty result.
    """
    own = pages.select(
        F.col(id_col).alias(id_col),
        host_of(F.col(url_col)).alias("host"),
        path_of(F.col(url_col)).alias("path"),
        key_of(F.col(url_col)).alias("key"),
    )
    links = page_links(pages, url_col, html_col)
    if redirects is not None:
        links = links.union(redirects.select(key_of(F.col("src_url")), key_of(F.col("dst_url"))))
    links = settle(links, "links")
    best = settle(matched(own, rules), "matched")
    judged = own.join(best, ["host", "path"], "left")
    if links.isEmpty():
        judged = judged.withColumn("blocked", F.lit(False))
    else:
        judged = judged.join(settle(alias_verdicts(links, rules), "alias-verdicts"), "key", "left")
    alias = F.coalesce("blocked", F.lit(False)) & F.col("rule").isNull()
    verdict = F.coalesce("verdict", F.when(alias, "block").otherwise("allow"))
    return judged.select(id_col, "host", "path", "rule", verdict.alias("verdict"), alias.alias("alias"))

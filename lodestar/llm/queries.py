"""The registered queries of the training-data operators, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, centroids, decontamination, divergence, htmltext, langid, minhash, packing, secrets, sharding, simhash, toxicity, urlfilter
from .shared import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontamination.verdicts(found)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


#: host, path, verdict
URL_RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def op6_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ", ".join(map(str, URL_RULES))
    rules = spark.sql(f"SELECT * FROM VALUES {rows} AS rules(host, path, verdict)")
    return urlfilter.judge(table(spark, sf_dir, "pages"), rules)


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), secrets.train(secrets.labelled_findings(spark)))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


_HOST = "translate(regexp_extract({0}, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract({0}, '://[^/?#]*([^?#]*)', 1)"
_KEY = "CASE WHEN contains({0}, '://') THEN '://' || " + _HOST + " || regexp_extract({0}, '://[^/?#]*([^#]*)', 1) END"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def urlfilter_sql() -> str:
    """The longest rule, and blocks passed on through the closure of links, as DuckDB SQL."""
    rules = ", ".join(map(str, URL_RULES))
    href = " || ".join(f"regexp_extract(tag, {_quoted(urlfilter.HREF)}, {g})" for g in (1, 2, 3))
    return f"""
WITH RECURSIVE rules(h, t, v) AS (VALUES {rules}),
p AS (SELECT page_id, coalesce({_HOST.format('url')}, '') AS host, coalesce({_PATH.format('url')}, '') AS path,
  {_KEY.format('url')} AS key, url, html FROM pages),
tags AS (SELECT url, unnest(regexp_extract_all(html, {_quoted(urlfilter.LINK_TAGS)})) AS tag FROM p WHERE contains(url, '://')),
raw AS (SELECT url, replace(trim(CASE WHEN regexp_matches(tag, {_quoted(urlfilter.CANONICAL)}) THEN {href}
    WHEN regexp_matches(tag, {_quoted(urlfilter.REFRESH)}) THEN regexp_extract(tag, {_quoted(urlfilter.TARGET)}, 1) END), '&amp;', '&') AS target
  FROM tags),
links AS (SELECT {_KEY.format('url')} AS a, {_KEY.format('target')} AS b FROM (SELECT url, CASE
    WHEN contains(target, '://') THEN target WHEN starts_with(target, '//') THEN ':' || target
    WHEN starts_with(target, '/') THEN '://' || {_HOST.format('url')} || target
    ELSE '://' || {_HOST.format('url')} || CASE WHEN regexp_extract({_PATH.format('url')}, '^(.*/)', 1) = '' THEN '/'
      ELSE regexp_extract({_PATH.format('url')}, '^(.*/)', 1) END || target END AS target FROM raw WHERE target <> '')),
near AS (SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b),
reach AS (SELECT a, b FROM near UNION SELECT reach.a, near.b FROM reach JOIN near ON reach.b = near.a),
named AS (SELECT host, path FROM p UNION SELECT {_HOST.format('a')}, {_PATH.format('a')} FROM near),
fits AS (SELECT host, path, h || t AS rule, v, row_number() OVER (
    PARTITION BY host, path ORDER BY length(h || t) DESC, v <> 'allow', h || t) AS n
  FROM named JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, t)),
best AS (SELECT host, path, rule, v FROM fits WHERE n = 1),
node AS (SELECT DISTINCT a AS key, v FROM near LEFT JOIN best ON host = {_HOST.format('a')} AND path = {_PATH.format('a')}),
bad AS (SELECT reach.a AS key FROM reach JOIN node ON reach.b = node.key GROUP BY reach.a
  HAVING bool_or(coalesce(v = 'block', false)) AND NOT bool_or(coalesce(v = 'allow', false)))
SELECT page_id, p.host, p.path, rule, coalesce(v, CASE WHEN bad.key IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
  bad.key IS NOT NULL AND rule IS NULL AS alias
FROM p LEFT JOIN best ON p.host = best.host AND p.path = best.path LEFT JOIN bad ON p.key = bad.key
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_ann": op2_ann,
        "op3_packing": op3_packing,
        "op4_toxicity": op4_toxicity,
        "op5_sharding": op5_sharding,
        "op6_urlfilter": op6_urlfilter,
        "op7_decontamination": op7_decontamination,
        "op8_langid": op8_langid,
        "op9_html": op9_html,
        "op10_secrets": op10_secrets,
        "op11_divergence": op11_divergence,
        "op12_centroids": op12_centroids,
        "op13_minhash": op13_minhash,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_urlfilter": urlfilter_sql(),
        "op7_decontamination": decontamination.ORACLE,
        "op11_divergence": divergence.ORACLE,
        "op12_centroids": centroids.ORACLE,
        "op13_minhash": minhash.ORACLE,
    }

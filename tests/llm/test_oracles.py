"""Queries with SQL equal it; the URL filter also on pages with links."""

import pytest

from lodestar.llm import queries
from tests.compare import connect, same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(spark, connect(SF), SF, queries.queries()[name], queries.oracle_sql()[name])


def test_url_filter_equals_sql_on_linked_pages(spark, tmp_path):
    def canonical(to):
        return f"<head><LINK href='{to}' rel=canonical></head>"

    pages = [
        (1, "https://one.xy/a", canonical("https://Any.com/en/x")),
        (2, "http://two.xy/b#f", canonical("//one.xy/a")),
        (3, "https://three.xy/c?x=1&y=2", '<meta http-equiv="refresh" content="0; URL=\'http://two.xy/b\'">'),
        (4, "https://four.xy/q/r", canonical("../z")),
        (5, "https://five.xy/", canonical("https://any.org/es/y?a=1&amp;b=2")),
        (6, "https://six.xy/", canonical("/other")),
        (7, "https://example.com/en/7", canonical("https://five.xy/")),
        (8, None, canonical("https://any.com/en/")),
        (9, "https://six.xy/other", None),
        (10, "https://a.com/en/1", ""),
    ]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    frame.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    same(spark, con, str(tmp_path), queries.op6_urlfilter, queries.oracle_sql()["op6_urlfilter"])
    blocked = {r.page_id for r in queries.op6_urlfilter(spark, str(tmp_path)).collect() if r.verdict == "block"}
    assert blocked == {1, 2, 3, 10}

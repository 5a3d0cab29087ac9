"""Run a registered query and its SQL over the same tables, and compare the rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES.split():
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=str)


def same(spark, con, sf_dir, query, sql):
    mine = query(spark, sf_dir)
    theirs = con.sql(sql)
    assert sorted(mine.columns) == sorted(theirs.columns)
    found, expected = rows_of(mine.columns, map(tuple, mine.collect())), rows_of(theirs.columns, theirs.fetchall())
    assert len(found) == len(expected), f"{len(found)} rows, {len(expected)} expected"
    assert found == expected
    return len(found)

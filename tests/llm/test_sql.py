"""The queries that SQL can express against it, on the small tables and on pages that link to each other."""

import glob
import os
from collections import Counter

import duckdb
import pandas as pd
import pytest

from treequarry.llm import queries, urls

SF = "/root/testdata/sf0.001"


def rows(columns, found):
    return Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in found), columns


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    out = queries.QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    got = Counter(map(tuple, out.select(*columns).collect()))
    assert got == Counter(con.sql(queries.ORACLE_SQL[name]).select(*columns).fetchall())


def test_spreads_in_sql(spark):
    link = lambda *hosts: " ".join(f'<a href="http://{h}/">' for h in hosts)
    table = [(1, "http://spam.net/", link("a.example")), (2, "http://lone.example/", link("spam.net")), (3, "http://far.example/", link("lone.example", "x.org")), (4, "http://x.org/fr/", link("far.example")), (5, "http://far.example/b", None), (6, None, None)]
    pages = spark.createDataFrame(table, "page_id long, url string, html string")
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(table, columns=["page_id", "url", "html"]))
    want = con.sql(queries.url_sql()).select("page_id", "host", "path", "rule", "verdict").fetchall()
    got = [tuple(r) for r in urls.verdicts(pages).collect()]
    assert sorted(got) == sorted(want) and ("block" in {r[4] for r in got if not r[3]})

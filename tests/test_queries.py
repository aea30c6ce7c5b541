"""Every registered query outside of the training-data subpackage against its SQL, on the small tables."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from treequarry.plans import file_queries, graph_queries, parse_queries, patch_queries, project_queries, render_queries, rich_parse_queries, state_queries, store_queries, timeline_queries  # noqa: F401
from treequarry.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    out = QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    got = Counter(tuple(plain(v) for v in r) for r in out.select(*columns).collect())
    found = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = Counter(tuple(plain(r[i]) for i in order) for r in found.fetchall())
    assert got == want

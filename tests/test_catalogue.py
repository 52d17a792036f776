"""Registered queries against their SQL twins on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from edgeloom import catalogue

TABLES = "/root/testdata/sf0.001"
SLOW = {"slashburn_check", "spectral_norm", "op2norm", "rcm_check", "reverse_rcm_check", "pagerank_reordered_valid"}
NAMES = [n for n in catalogue.ORACLE_SQL if n not in SLOW]


def norm(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(float(v)) if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    df = catalogue.QUERIES[name](spark, TABLES)
    con = duckdb.connect()
    for f in glob.glob(f"{TABLES}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.sql(catalogue.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    a = sorted(tuple(map(norm, r)) for r in df.select(*cols).collect())
    b = sorted(tuple(norm(r[i]) for i in at) for r in want.fetchall())
    assert a == b


def test_every_query_names_its_operators():
    assert set(catalogue.INVENTORY) == set(catalogue.QUERIES)

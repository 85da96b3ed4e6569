import glob
import os

import duckdb
import pytest

from loomline.plans import catalogue, fold, intake  # noqa: F401


#: Folds of histories take tens of rounds of small jobs each: they are compared on the smallest tables.
SMALL = "/root/testdata/sf0.001"


def views(folder):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.fixture(scope="module")
def oracles(sf_dir):
    return {sf_dir: views(sf_dir), SMALL: views(SMALL)}


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, oracles, name):
    folder = SMALL if catalogue.QUERIES[name].__module__ == fold.__name__ else sf_dir
    df = catalogue.QUERIES[name](spark, folder)
    names = sorted(df.columns)
    want = oracles[folder].sql(catalogue.ORACLE_SQL[name])
    assert sorted(want.columns) == names
    at = [list(want.columns).index(c) for c in names]
    rounded = lambda row: tuple(round(v, 6) if isinstance(v, float) else v for v in row)
    got = sorted((rounded(r[c] for c in names) for r in df.collect()), key=repr)
    assert got == sorted((rounded(r[i] for i in at) for r in want.fetchall()), key=repr)

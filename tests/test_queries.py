"""Every registered query of the library against its SQL, at the smallest scale."""

import os

import duckdb
import pandas as pd
import pytest

from treespark.plans import queries as Q

DATA = "/root/testdata/sf0.001"
TABLES = "documents events pages".split()


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    plain = lambda v: None if pd.isna(v) else int(v) if isinstance(v, bool) or hasattr(v, "is_integer") and float(v).is_integer() else str(v)[:26]
    return sorted((tuple(map(plain, r)) for r in pdf.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not here")
@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, duck, name):
    got = Q.queries()[name](spark, DATA).toPandas()
    if name in Q.oracle_sql():
        want = duck.execute(Q.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)

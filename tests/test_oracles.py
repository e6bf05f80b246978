"""Every registered query against its DuckDB statement on the small tables."""

import math
from datetime import date, datetime
from decimal import Decimal

import duckdb
import pytest

from attestry import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (datetime, date)):
        return str(v)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, db, name):
    df = registry.queries()[name](spark, SF)
    got = rows(df.columns, df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    res = db.execute(sql)
    names = [d[0] for d in res.description]
    want = rows(names, res.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want)
    assert got == want
    kinds = {c: k for c, k in df.dtypes}
    for d in res.description:
        assert (str(d[1]) in ("BIGINT", "INTEGER")) == (kinds[d[0]] in ("bigint", "int")), (d[0], str(d[1]), kinds[d[0]])

"""The queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from attestry.llm import oracles, queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_same_rows(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    res = db.execute(oracles.SQL[name])
    names = [d[0] for d in res.description]
    want = sorted(res.fetchall(), key=repr)
    df = queries.queries()[name](spark, SF).select(*names)
    kinds = {"BIGINT": "bigint", "VARCHAR": "string", "BOOLEAN": "boolean"}
    assert [k for _, k in df.dtypes] == [kinds[str(d[1])] for d in res.description]
    assert sorted(map(tuple, df.collect()), key=repr) == want

"""Every registered query of the engine's own operators against its SQL, over the smallest tables."""

import decimal
from pathlib import Path

import duckdb
import pytest

from skylark.plans import page_queries, payload_queries, queries  # noqa: F401

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in sorted(Path(SF_DIR).glob("*.parquet")):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    return con


def plain(value):
    return f"{float(value):.9g}" if isinstance(value, (float, decimal.Decimal)) else str(value)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got
    if name in queries.ORACLE:
        answer = duck.execute(queries.ORACLE[name])
        names = [d[0] for d in answer.description]
        assert sorted(names) == columns
        assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in answer.fetchall())

"""Every query runs, has unique columns, and agrees with its SQL in DuckDB."""

from pathlib import Path

import duckdb
import pytest

from strandframe.plans import catalog

SF = Path("/root/testdata/sf0.001")
NAMES = sorted(catalog.QUERIES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set enable_progress_bar=false")
    for p in SF.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def rows(table, columns):
    return sorted(repr(tuple(float(r[c]) if isinstance(r[c], float) else r[c] for c in columns)) for r in table)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(SF))
    columns = sorted(df.columns)
    assert len(set(columns)) == len(columns)
    got = [r.asDict() for r in df.collect()]
    if name not in catalog.ORACLES:
        return
    found = duck.sql(catalog.ORACLES[name])
    assert sorted(found.columns) == columns
    want = [dict(zip(found.columns, r, strict=True)) for r in found.fetchall()]
    assert rows(got, columns) == rows(want, columns)

"""The registered queries of the core against their SQL on the small tables, where these are there."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from lociframe.plans import core_problems, reference_queries

SF = Path("/root/testdata/sf0.001")
NAMES = sorted(core_problems.oracle() | reference_queries.oracle())


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    import duckdb

    from verify import rows_of

    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    df = entry.queries()[name](spark, str(SF))
    found = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, found.fetchall())


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())

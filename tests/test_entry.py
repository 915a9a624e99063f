import os

import duckdb
import pytest

import __spark_entry__ as entry
from bitloom.plans import queries as plans

SF = "/root/testdata/sf0.001"
QUICK = sorted(set(plans.ORACLES) - {"character_contexts", "codec_roundtrip"})  # those take long


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(round(r[i], 6) if isinstance(r[i], float) else r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "events", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    frame = entry.queries()[name](spark, SF)
    expected = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == sorted(frame.columns)
    assert rows_of(frame.columns, frame.collect()) == rows_of(names, expected.fetchall())


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(plans.QUERIES) <= set(entry.queries())

"""Registered queries: names, oracles at sf0.001."""

import pytest

import __spark_entry__ as entry
from piisift.llm import catalog as llm_catalog

SF = "/root/testdata/sf0.001"


def test_all_operators_are_registered():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names


@pytest.mark.parametrize("name", sorted(llm_catalog.ORACLES))
def test_oracle(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    expected = sorted(map(repr, want.fetchall()))
    got = entry.queries()[name](spark, SF).select(*names).collect()
    assert sorted(repr(tuple(r)) for r in got) == expected and expected

"""Every registered query over the whole small tables, against its SQL where there is some."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from corpusloom.llm import queries

from ..test_catalog import TABLES, rows


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, small, name):
    got = queries.QUERIES[name](spark, small).toPandas()
    assert len(got)
    if name in queries.ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{os.path.join(small, t)}.parquet'")
        want = con.execute(queries.ORACLES[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_all_ten_and_the_pipeline_are_registered():
    names = entry.queries()
    assert all(any(x.startswith(f"op{n}_") for x in names) for n in range(1, 11)) and "pipeline" in names

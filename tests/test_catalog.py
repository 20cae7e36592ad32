import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from corpusloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or isinstance(v, float) and v != v or v is pd.NA:
            return None
        # whole numbers beside nulls are floats in pandas
        return str(int(v)) if isinstance(v, float) and v.is_integer() else repr(round(float(v), 6)) if isinstance(v, float) else str(v)

    df = df[sorted(df.columns)]
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{os.path.join(small, t)}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, duck, small, name):
    got, want = entry.queries()[name](spark, small).toPandas(), duck.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 5


def test_ingested_files_share_folders(spark, small, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "place", lambda spark, name: str(tmp_path / name))
    n = catalog._ingested(spark, small).files.rows().count()
    files = list((tmp_path / "files").glob("*/*.json"))
    assert len(files) == n == spark.read.parquet(f"{small}/documents.parquet").where("text is not null").selectExpr("count(distinct doc_id div 50) n").first().n
    assert len({f.parent for f in files}) == 1 and all(f.read_text().count("\n") == 1 for f in files)

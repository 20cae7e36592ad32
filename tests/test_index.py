"""Commits, incremental ingestion, and filters and counts that reach the scan."""

import contextlib
import io
import json
import os
import re
from itertools import count

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import metadata
from corpusloom.plans import catalog, index
from corpusloom.plans.engine import Engine
from corpusloom.sources import files


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def put(folder, name, i):
    (folder / name).write_text(json.dumps({"title": f"the old bridge number {i} over the river", "text": f"A long story about bridge {i}. " * 120}), encoding="utf-8")


def asked(spark):
    return spark.createDataFrame([(0, "bridge number 2 river")], "query_id long, question string")


names = (f"t_index_{i}" for i in count())


@pytest.fixture
def corpus(tmp_path):
    for i in range(3):
        put(tmp_path, f"d{i}.json", i)
    (tmp_path / "bad.json").write_text("[1]")
    return tmp_path


def test_filters_reach_the_scan(spark, corpus):
    engine = Engine(spark, next(names))
    engine.ingest_corpus(str(corpus), force=True)
    text = plan(engine.chunks.matching({"domain": "tourisme", "source_file": "d1.json", "chunk_index": {"$gte": 1}}))
    assert re.search(r"PartitionFilters: .*domain.* = tourisme", text) and "batch" in re.search(r"PartitionFilters: .*", text)[0]
    pushed = re.search(r"PushedFilters: .*", text)[0]
    assert "EqualTo(source_file,d1.json)" in pushed and "GreaterThanOrEqual(chunk_index,1)" in pushed
    assert {r.source_file for r in engine.search(asked(spark), 9, {"source_file": "d1.json"}).collect()} == {"d1.json"}
    assert engine.search(asked(spark), 9, {"domain": "legal"}).count() == 0
    total = engine.chunks.rows().count()
    assert engine.chunks.matching({"chunk_index": {"$gt": 0}}).count() == total - 3 and engine.chunks.matching({"chunk_index": "0"}).count() == 3
    assert engine.chunks.matching({"source_type": "json", "chunk_index": {"$in": [0, 1]}}).count() == 6
    where = plan(catalog.QUERIES["metadata_where"](spark, "/root/testdata/sf0.001"))
    assert "StringContains(source,1)" in where


def test_numbers_compare_as_numbers(spark):
    df = spark.createDataFrame([({"n": str(n)},) for n in (2, 9, 10, 110, "x")] + [({},)], "m map<string,string>")
    found = lambda rule: [r.m.get("n") for r in df.where(metadata.where(F.col("m"), rule)).collect()]
    assert found({"n": {"$gt": 9}}) == ["10", "110"] and found({"n": {"$lte": 9.5}}) == ["2", "9"]
    assert found({"n": {"$gt": "9"}}) == ["x"] and found({"n": {"$in": [10, "x"]}}) == ["10", "x"]
    assert found({"n": {"$nin": ["x", "9"]}}) == ["2", "10", "110"] and found({"n": {"$ne": 2}}) == ["9", "10", "110"]
    assert found({"n": {"$in": []}}) == []


def test_a_failed_ingestion_leaves_nothing(spark, corpus, monkeypatch):
    engine = Engine(spark, next(names), mode="parent-child")
    engine.reset()
    add = index.Collection.add

    def failing(self, rows, batch=None):
        if self.name.endswith("_children"):
            raise RuntimeError("the driver is lost")
        add(self, rows, batch)

    monkeypatch.setattr(index.Collection, "add", failing)
    with pytest.raises(RuntimeError):
        engine.ingest_corpus(str(corpus))
    monkeypatch.undo()
    assert spark.table(engine.parents.name).count() > 0  # written, but not committed
    assert engine.parents.rows().count() == 0 and engine.errors.rows().count() == 0 and not engine.active.populated()
    assert not [t.name for t in spark.catalog.listTables() if re.fullmatch(engine.chunks.name + "_[0-9a-f]{12}", t.name)]
    assert engine.ingest_corpus(str(corpus)).count() == 1
    parents = [r.id for r in engine.parents.rows().collect()]
    assert len(parents) == len(set(parents)) == 6
    assert {r.parent_id for r in engine.children.rows().collect()} == set(parents)
    before = engine.children.rows().count()
    assert engine.vacuum() > 0 and engine.vacuum() == 0
    assert engine.children.rows().count() == before and spark.table(engine.parents.name).count() == 6


def test_only_new_files_are_read(spark, corpus, tmp_path_factory):
    log = tmp_path_factory.mktemp("calls")

    class Parser:  # travels to the tasks by value
        def blocks(self, content):
            with open(log / "calls", "a") as f:
                f.write(content.decode() + "\n")
            return [(1, 100.0, 100.0, 0, 0.0, 0.0, 50.0, 9.0, "A page of a paper on bridges, with a good length of text.", 0)]

    parsed = lambda: sorted((log / "calls").read_text().split()) if (log / "calls").exists() else []
    (corpus / "x.pdf").write_bytes(b"one")
    engine = Engine(spark, next(names), parser=Parser())
    assert [r.path.rsplit("/", 1)[1] for r in engine.ingest_corpus(str(corpus), update=True).collect()] == ["bad.json"]
    n = engine.chunks.rows().count()
    assert parsed() == ["one"]
    assert engine.ingest_corpus(str(corpus), update=True).count() == 1 and parsed() == ["one"] and len(engine.manifest.batches()) == 1
    put(corpus, "d7.json", 7)
    (corpus / "y.pdf").write_bytes(b"two")
    engine.ingest_corpus(str(corpus))  # has rows
    assert engine.chunks.rows().count() == n
    engine.ingest_corpus(str(corpus), update=True)
    assert parsed() == ["one", "two"] and engine.chunks.rows().count() > n
    assert engine.chunks.by_source("d7.json").count() and len(engine.manifest.batches()) == 2
    # an old file that comes late lies in the range of times of the others
    (corpus / "z.pdf").write_bytes(b"three")
    (corpus / "w.pdf").write_bytes(b"four")
    os.utime(corpus / "z.pdf", (1, 1))
    engine.ingest_corpus(str(corpus), update=True)
    assert parsed() == ["four", "one", "three", "two"]
    n = engine.chunks.rows().count()
    (corpus / "y.pdf").write_bytes(b"five!")
    engine.ingest_corpus(str(corpus), update=True)
    assert parsed() == ["five!", "four", "one", "three", "two"] and engine.chunks.rows().count() == n + 1


def test_a_listing_reads_no_content(spark, corpus):
    text = plan(files.listing(spark, str(corpus)))
    assert "content" not in re.search(r"ReadSchema: .*", text)[0]
    found = files.listing(spark, str(corpus)).where("path like '%d1.json'").toPandas()
    wanted = spark.createDataFrame(found)
    assert [r.path.rsplit("/", 1)[1] for r in files.contents(spark, str(corpus), wanted).collect()] == ["d1.json"]
    assert files.contents(spark, str(corpus), wanted.limit(0)).count() == 0
    assert "GreaterThanOrEqual(modificationTime" in plan(files.contents(spark, str(corpus), wanted))


def test_counts_come_from_footers(spark, corpus, small):
    engine = Engine(spark, next(names))
    engine.ingest_corpus(str(corpus), force=True)
    counted = index.footer_counts(spark, f"{small}/documents.parquet")
    assert "PushedAggregation: [COUNT(*)]" in plan(counted) and counted.first().n == spark.read.parquet(f"{small}/documents.parquet").count()
    place = spark.sql(f"DESCRIBE TABLE EXTENDED {engine.chunks.name}").where("col_name = 'Location'").first().data_type
    by_batch = index.footer_counts(spark, place, spark.table(engine.chunks.name).schema, ("domain", "batch"))
    assert "PushedAggregation: [COUNT(*)]" in plan(by_batch)
    engine.chunks.add(engine.chunks.rows(), index.new_batch())  # not committed
    found = {r.name: r.n for r in index.collections(spark).collect()}
    assert found[engine.chunks.name] == engine.chunks.rows().count() > 0
    assert found[engine.parents.name] == 0
    assert spark.conf.get("spark.sql.sources.useV1SourceList") != ""

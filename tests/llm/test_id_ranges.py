"""Ranges of ids with gaps hold about as many rows as wanted."""

import random

from pyspark.sql import functions as F

from corpusloom.llm import iblt


def test_gaps_between_ids(spark, monkeypatch):
    monkeypatch.setattr(iblt, "RANGES", 8)
    ids = [*range(2000), *(10**9 + i for i in range(2000)), 10**15]
    random.Random(1).shuffle(ids)
    text = "x" * 100
    monkeypatch.setattr(iblt, "RANGE_BYTES", 36 * len(text))
    docs = spark.createDataFrame([(i, text) for i in ids], "doc_id long, text string").repartition(4)
    buckets = iblt.ranged(docs).groupBy("bucket").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).orderBy("bucket").collect()
    assert sum(r.n for r in buckets) == len(ids) and max(r.n for r in buckets) <= 3 * 36
    # ranges follow the ids
    assert all(a.high < b.low for a, b in zip(buckets, buckets[1:]))


def test_ids_that_many_rows_share_are_still_cut(spark, monkeypatch):
    monkeypatch.setattr(iblt, "RANGES", 8)
    monkeypatch.setattr(iblt, "RANGE_BYTES", 2000)
    rows = [(7, f"text {i}") for i in range(600)] + [(i, f"t{i}") for i in range(300)] + [(None, f"n{i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    buckets = [r["count"] for r in iblt.ranged(docs).groupBy("bucket").count().collect()]
    assert sum(buckets) == len(rows) and max(buckets) <= 330

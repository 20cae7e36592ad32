"""Blocked exact search against plain Python, and the approximate index against it."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import ann, search
from corpusloom.plans import catalog

from .test_index import plan

VECTORS = "id string, embedding array<float>, distance_of int, extra map<string,string>"


def data(n, seed, copies=0):
    rng = np.random.default_rng(seed)
    rows = [(f"v{i:04d}", rng.normal(size=6).astype(np.float32).tolist(), i, {"i": str(i)}) for i in range(n)]
    rows += [(f"c{i:04d}", rows[0][1], i, {}) for i in range(copies)]
    rows += [("null", None, 0, {}), ("hole", [1.0, None, 1.0, 1.0, 1.0, 1.0], 0, {}), ("short", [1.0, 2.0], 0, {}), ("none", [], 0, {}), ("zero", [0.0] * 6, 0, None)]
    random.Random(seed).shuffle(rows)
    return rows


def brute(rows, asked, k, metric, digits):
    out = []
    for q, x in asked:
        found = []
        for i, v, *_ in rows:
            if v is None or len(v) != len(x) or None in v or metric == "cosine" and not any(v):
                continue
            d = dot = a = b = 0.0
            for s, t in zip(v, x):
                d, dot, a, b = d + (s - t) * (s - t), dot + s * t, a + s * s, b + t * t
            d = {"l2_sq": d, "l2": d**0.5}[metric] if metric != "cosine" else 1 - dot / (a * b) ** 0.5
            found.append((round(d, digits) if digits else d, i))
        out += [(q, r, i, d) for r, (d, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("metric", ["l2_sq", "l2", "cosine"])
@pytest.mark.parametrize("digits", [None, 3])
def test_top_k_is_exact(spark, metric, digits, monkeypatch):
    monkeypatch.setattr("corpusloom.operators.nearest.ROWS", 40)
    rows = data(300, 1, copies=60)
    asked = [(q, rows_[1]) for q, rows_ in enumerate(r for r in rows if r[0][0] == "v" and r[2] % 30 == 0)] + [(90, [1.0, 2.0])]
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    questions = spark.createDataFrame(asked, "query_id int, query array<float>")
    for block in (1024, 4):
        monkeypatch.setattr(search, "QUESTION_BLOCK", block)
        got = search.top_k(df, questions, 7, metric, digits)
        assert got.columns == ["query_id", "rank", "id", "distance_of", "extra", "distance"]
        assert sorted((r.query_id, r["rank"], r.id, r.distance) for r in got.collect()) == brute(rows, asked, 7, metric, digits)
    assert search.top_k(df.limit(0), questions, 3).count() == 0 and search.top_k(df, questions.limit(0), 3).count() == 0


def test_ties_go_to_smaller_ids_over_tasks(spark):
    df = spark.range(5000).select(F.col("id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding")).repartition(7)
    got = search.top_k(df, spark.createDataFrame([(0, [1.0, 2.0])], "query_id long, query array<double>"), 4)
    assert [(r.id, r.distance) for r in got.orderBy("rank").collect()] == [(i, 0.0) for i in range(4)]


def test_an_index_with_all_probes_is_exact_and_reads_only_its_cells(spark):
    rows = data(400, 2)
    df = spark.createDataFrame(rows, VECTORS)
    asked = [(q, r[1]) for q, r in enumerate(rows[:12]) if r[1] and len(r[1]) == 6 and None not in r[1]]
    questions = spark.createDataFrame(asked, "query_id int, query array<float>")
    index = ann.IvfIndex.build(df, cells=9)
    assert index.table.count() == 401 and len(index.centres) == 9
    got = index.search(questions, 5, probes=9)
    assert sorted((r.query_id, r["rank"], r.id, r.distance) for r in got.collect()) == brute(rows, asked, 5, "l2_sq", None)
    text = plan(index.search(questions.limit(1), 5, probes=2))
    assert "PartitionFilters: [cell" in text and index.search(questions.limit(1), 500, probes=2).count() < 300
    empty = ann.IvfIndex.build(df.limit(0))
    assert empty.search(questions, 3).count() == 0 and empty.tuned(3).probes == 1


def test_recall_of_groups_needs_few_probes(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16)) * 4
    rows = [(i, (centres[i % 30] + rng.normal(size=16)).tolist()) for i in range(3000)]
    index = ann.IvfIndex.build(spark.createDataFrame(rows, "id long, embedding array<double>"), cells=30).tuned(10)
    assert index.probes <= 8


def test_recall_of_the_query(spark):
    sf = "/root/testdata/sf0.01"
    found = catalog.vector_ann(spark, sf).select("query_id", "id")
    exact = search.top_k(catalog._vectors(spark, sf), catalog._questions(spark, sf, 25), 10).select("query_id", "id")
    n = exact.count()
    assert n == found.count() == 200 and found.join(exact, ["query_id", "id"]).count() >= 0.9 * n

"""Metadata from VARIANT values against the flattener that walks a document."""

import json
import random

from pyspark.sql import functions as F

from corpusloom.plans import catalog
from corpusloom.sources import markup, variants

from .test_index import plan


def value(rng, depth=0):
    pick = rng.randint(0, 11 if depth < 4 else 9)
    texts = ["", "word", "two words", "2024-03-15", "2024-03-15T10:11:12Z", "x" * 60, "a text " * 20, "é 1", "20240315"]
    if pick > 9:
        return {rng.choice(["a", "b_c", "Ref no", "num", "title", "x.y"]) + str(i): value(rng, depth + 1) for i in range(rng.randint(0, 4))}
    return [None, True, False, rng.randint(-5, 10**12), rng.randint(0, 99) / 4, [], [1, "x", {"y": 2}], rng.choice(texts), rng.choice(texts), rng.choice(texts)][pick]


def test_metadata_equals_the_flattener(spark):
    rng = random.Random(2)
    docs = [{f"k{i}": value(rng) for i in range(rng.randint(0, 6))} for _ in range(200)]
    rows = [(i, json.dumps(d, ensure_ascii=i % 2 == 0)) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    for r in df.select("id", variants.json_metadata(F.col("text")).alias("f")).collect():
        want, _ = markup.json_document(json.loads(rows[r.id][1]))
        assert r.f.error is None and r.f.metadata == {k: v if isinstance(v, str) else str(v) for k, v in want.items()}, rows[r.id]


def test_what_is_no_object(spark):
    deep = json.dumps({"a": {"b": {"c": {"d": 1}}}})
    rows = [(1, "[1]"), (2, "{"), (3, None), (4, "null"), (5, '"x"'), (6, '{"a": 1, "a": 2}'), (7, "{}"), (8, deep), (9, '{"a.b": 1, "a": {"b": 2}}')]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: r.f for r in df.select("id", variants.json_metadata(F.col("text"), 4).alias("f")).collect()}
    assert [i for i in got if got[i].error] == [1, 2, 4, 5, 6] and got[3].metadata is None
    assert got[7].metadata == {} and got[8].metadata == {"a.b.c.d": "1"} and list(got[9].metadata) == ["a.b"]
    cut = df.where("id = 8").select(variants.json_metadata(F.col("text"), 3).alias("f")).first().f
    assert cut.metadata is None and "deeper" in cut.error


def test_no_python_worker(spark, small):
    assert "Python" not in plan(catalog.QUERIES["json_variant_metadata"](spark, small))

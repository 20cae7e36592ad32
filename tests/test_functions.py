import hashlib
import re
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import chunking, metadata, text, vectors
from corpusloom.functions.vectors import HashedEmbedder, distance
from corpusloom.operators import chunks
from corpusloom.sources import markup


def values(spark, rows, column, name="x"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i long, {name} string")
    return [r[1] for r in df.select("i", column.alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize("source, size, overlap, expected", [("abcdefghij", 4, 1, ["abcd", "defg", "ghij", "j"]), ("abcdefghij", 4, 0, ["abcd", "efgh", "ij"]), ("abcd", 4, 1, ["abcd"]), ("", 4, 1, []), (None, 4, 1, [])])
def test_windows(spark, source, size, overlap, expected):
    assert values(spark, [source], chunking.sliding_windows(F.col("x"), size, overlap)) == [expected]


def test_windows_need_a_step():
    with pytest.raises(ValueError):
        chunking.sliding_windows(None, 4, 4)


@pytest.mark.parametrize(
    "source, expected",
    [
        ("short", ["short"]),
        ("aaaa aaaa.\n\nbbbb bbbb.\n\ncccc.", ["aaaa aaaa.", "aaaa.\nbbbb bbbb.", "bbbb.\ncccc."]),
        ("head.\n\none two. three four five.\n\ntail.", ["one two.", "two. three four five.", "head.\ntail."]),
        ("a" * 24 + ". b.", ["", "a" * 24 + ".", "aaaa. b."]),
        ("x" * 20, ["x" * 20]),
        (" \n \n" * 8, []),
    ],
)
def test_structural_chunks(spark, source, expected):
    assert values(spark, [source], chunking.structural_chunks(F.col("x"), 20, 5)) == [expected]


def test_valid_chunks_have_dense_ids(spark):
    rows = [("d", 0, "a" * 60), ("d", 1, " " * 90 + "b" * 10), ("d", 2, "c" * 70)]
    got = chunks.indexable(spark.createDataFrame(rows, "document_id string, chunk_index int, chunk string"), "document_id").orderBy("chunk_index").collect()
    assert [(r.id, r.chunk_index, r.chunk_total) for r in got] == [("d_chunk_0", 0, 2), ("d_chunk_1", 2, 2)]


DATES = ["2024-03-15", "20240315", "2024-W11-5", "2024-03-15T10", "2024-03-15T10:20:30Z", "2024-03-15 10:20", "2024-03-15T25:00", "2024-13-01", "2024-02-30", "2024-03", "2024", "2024-3-5", "x", "", "2024-03-15T10:61", "2020-W53-1", "2021-W53-1", "2024-03-15T10:20:30.5+02:00"]


def test_iso_dates_as_the_standard_library(spark):
    def want(x):
        try:
            return datetime.fromisoformat(x.replace("Z", "+00:00"))
        except ValueError:
            return None

    assert values(spark, DATES, text.is_iso_date(F.col("x"))) == [want(x) is not None for x in DATES]
    assert values(spark, DATES, text.iso_date(F.col("x"))) == [want(x) and want(x).date() for x in DATES]


def test_labels_and_dates(spark):
    keys = ["title", "l'art2x", "L'Île De X2Y", "a_b c", ""]
    assert values(spark, keys, text.label(F.col("x"))) == [k.replace("_", " ").title() for k in keys]
    assert values(spark, ["2025-11-04", "no"], text.french_date(F.col("x"))) == ["4 novembre 2025", "no"]
    assert values(spark, ["a b", "ab", "a " * 40], text.is_structured(F.lit("guide"), F.col("x"))) == [True, True, True]
    assert values(spark, ["a b", "ab", "a" * 60], text.is_structured(F.lit("text"), F.col("x"))) == [False, True, False]


def test_normalised_metadata(spark):
    assert values(spark, ["REJET", "irrecevabilite", "Autre", None], metadata.outcome(F.col("x"))) == ["Rejet", "Irrecevabilité", "Autre", None]
    assert values(spark, ["ADOPTE", "Unanimite"], metadata.vote(F.col("x"))) == ["Adopté", "Unanimité"]
    assert values(spark, ["2024-13-01", "2024-03-15"], metadata.valid_date(F.col("x"))) == [None, "2024-03-15"]
    assert values(spark, ["2024-03-15"], metadata.year(F.lit(""), F.col("x"))) == ["2024"]


def test_enriched(spark):
    meta = {"juridiction": F.lit("Cour"), "numero_pourvoi": F.lit("1"), "dispositif": F.lit("null")}
    assert values(spark, ["t"], metadata.enriched(F.col("x"), meta, F.lit("motifs"), "legal")) == ["[Cour, n° 1 | Section: motifs]\n\nt"]
    assert values(spark, ["t"], metadata.enriched(F.col("x"), meta, F.lit("general"), "rh")) == ["t"]


def test_json_and_xml():
    data = {"title": "Pont du Vechju", "date": "2024-03-15", "ville": "Corte", "president": "Jean Paul Dupont", "n": 3, "ok": True, "tags": ["a", "b"], "empty": [], "x": None, "geo": {"lat": 1.5, "desc": "un long texte ici"}}
    meta, content = markup.json_document(data)
    assert content == "Title: Pont du Vechju\nDate: 15 mars 2024\nTags: a, b\n\nGeo:\nDesc: un long texte ici"
    assert meta == {"title_short": "Pont du Vechju", "date": "2024-03-15", "ville": "Corte", "president": "Jean Paul Dupont", "n": 3, "ok": True, "tags_count": 2, "geo.lat": 1.5, "geo.desc_short": "un long texte ici"}
    assert markup.xml_document('<doc date="a"><meta><date>1</date><Date>2</Date></meta><p>hello <b>bold</b> tail</p></doc>') == ({"date": "2", "attr_date": "a"}, "hello\n[b]: bold")
    assert markup.xml_document('<doc xmlns="u"><date>1</date></doc>') == ({}, "")
    assert markup.xml_document('<doc xmlns="u"><date>1</date></doc>', ns_aware=True) == ({"date": "1"}, "")


def test_bad_documents_are_errors(spark):
    rows = values(spark, ['{"a": 1}', "[1]", "{", None], markup.flatten_json(F.col("x")))
    assert [r.error is None for r in rows] == [True, False, False, True] and rows[0].metadata == {"a": "1"}


def test_where(spark):
    df = spark.createDataFrame([({"a": "1", "b": "x"},), ({"a": "2"},)], "m map<string,string>")
    count = lambda rule: df.where(metadata.where(F.col("m"), rule)).count()
    assert count({"a": 1}) == 1 and count({"$or": [{"a": {"$eq": "2"}}, {"b": "x"}]}) == 2 and count({"b": {"$contains": "x"}, "a": {"$ne": "1"}}) == 0
    with pytest.raises(ValueError):
        metadata.where(F.col("m"), {"a": {"$like": 1}})


def test_embedding_has_length_one():
    v = HashedEmbedder(8).embed(["one two two", ""])
    assert abs((v[0] ** 2).sum() - 1) < 1e-12 and not v[1].any()
    with pytest.raises(ValueError):
        distance(None, None, "unknown")


def test_folds_in_steps_are_one_fold(spark, monkeypatch):
    from corpusloom.functions import chunking

    texts = [(i, ("\n\n" if i % 2 else " ").join(f"Sentence {k} of text {i}." + " word" * (k % 17) for k in range(5 * i))) for i in range(40)]
    df = spark.createDataFrame(texts, "id int, text string")
    found = []
    for steps in (1, 3, 100_000):
        monkeypatch.setattr(chunking, "STEPS", steps)
        found.append({r.id: r.c for r in df.select("id", chunking.structural_chunks(F.col("text"), 300, 80).alias("c")).collect()})
    assert found[0] == found[1] == found[2] and len(found[0][39]) > 10


def test_hashed_embedder_remembers_few_words():
    words = [f"w{i}" for i in range(3 * vectors.REMEMBERED)]
    texts = [" ".join(words), "w1 " + "x" * 1000, None]
    got = vectors.HashedEmbedder(8).embed(texts)
    assert len(vectors._numbers) <= vectors.REMEMBERED and max(map(len, vectors._numbers)) <= 64
    counts = np.bincount([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 8 for w in words], minlength=8)
    assert np.allclose(got[0], counts / np.sqrt((counts * counts).sum())) and not got[2].any()


def test_words_hashed_together_have_their_md5():
    words = [b"", b"a", b"a\0", "mot\u00e9".encode(), b"x" * 55] + [b"w%d" % i for i in range(500)]
    assert vectors.md5_numbers(words).tolist() == [int(hashlib.md5(w).hexdigest()[:8], 16) for w in words]
    texts = ["One, two!  TWO|three\u2003four\x1cfive \u0130", "y" * 56 + " z"]
    counts = [np.bincount([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 8 for w in re.findall(r"[^\s.,;:!?|]+", t.lower())], minlength=8) for t in texts]
    assert np.allclose(HashedEmbedder(8).embed(texts), [c / np.sqrt((c * c).sum()) for c in counts])


def test_chunks_part_at_unicode_white_space_alone(spark):
    source = "one two three.\u2003four five six.\x1cseven eight.\u00a0nine ten."
    expected = ["one two three.", "one two three. four five six.\x1cseven eight.", "ve six.\x1cseven eight. nine ten."]
    assert values(spark, [source, None], chunking.structural_chunks(F.col("x"), 20, 20)) == [expected, None]


def test_chunks_are_cut_in_one_pass_of_a_worker(spark):
    plan = spark.createDataFrame([(1, "a")], "document_id int, text string").transform(lambda d: chunks.indexed(d, "document_id"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1

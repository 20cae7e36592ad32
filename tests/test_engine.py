import json

import pytest

from corpusloom.plans.engine import Engine
from corpusloom.plans.index import collections
from corpusloom.sources import files
from corpusloom.streaming.ingest import ingest_stream


@pytest.fixture
def corpus(tmp_path):
    for i in range(4):
        (tmp_path / f"d{i}.json").write_text(json.dumps({"title": f"the old bridge number {i} over the river", "text": f"A long story about bridge {i}. " * 120, "date": "2024-03-15"}), encoding="utf-8")
    (tmp_path / "o.xml").write_text("<doc><reference>R 1</reference><p>" + "An order of the court. " * 10 + "</p></doc>")
    (tmp_path / "bad.json").write_text("[1, 2]")
    (tmp_path / "skip.txt").write_text("not read")
    (tmp_path / "x.pdf").write_bytes(b"%PDF")
    return str(tmp_path)


def pdf_parser():
    class Pdf:  # a local class travels to the tasks by value
        def blocks(self, content):
            return [(1, 100.0, 100.0, 0, 0.0, 0.0, 50.0, 9.0, "A page of a paper on bridges, with a good length of text.", 0)]

    return Pdf()


def questions(spark):
    return spark.createDataFrame([(0, "bridge number 2 river"), (1, "order of the court")], "query_id long, question string")


def test_recursive(spark, corpus):
    engine = Engine(spark, "t_rec", parser=pdf_parser())
    engine.reset()
    errors = engine.ingest_corpus(corpus, now="n").collect()
    assert [r.path.rsplit("/", 1)[1] for r in errors] == ["bad.json"]
    n = engine.chunks.rows().count()
    assert n > 6
    engine.ingest_corpus(corpus)  # already populated
    assert engine.chunks.rows().count() == n
    found = engine.search(questions(spark), 3).collect()
    assert len(found) == 6 and {r.source_file for r in found if r.query_id == 1 and r["rank"] == 1} == {"o.xml"}
    only = engine.search(questions(spark), 3, filters={"source_type": "xml"}).collect()
    assert {r.source_file for r in only} == {"o.xml"}
    assert engine.answer(questions(spark), most=2.1).where("answer <> ''").count() == 2
    row = engine.chunks.by_source("O.XML").first()
    assert row.metadata["reference_complete"] == "R 1" and row.metadata["parties"] == "[]" and row.metadata["chunk_total"] == "1"
    assert {r.name: r.n for r in collections(spark).collect()}["t_rec"] == n


def test_parents_and_children(spark, corpus):
    engine = Engine(spark, "t_par", mode="parent-child")
    engine.ingest_corpus(corpus, force=True)
    assert engine.parents.rows().count() == 4 * 2 + 1
    found = engine.search(questions(spark), 6, most=2.0).collect()
    assert found and all(r.id.startswith("parent_") and r.document for r in found)
    n = engine.children.rows().count()
    engine.ingest_corpus(corpus, force=True)
    assert engine.children.rows().count() == n


def test_stream(spark, corpus, tmp_path_factory):
    engine = Engine(spark, "t_str")
    engine.reset()
    place = str(tmp_path_factory.mktemp("checkpoint"))
    ingest_stream(engine, corpus, place).awaitTermination()
    n = engine.chunks.rows().count()
    assert n > 4
    ingest_stream(engine, corpus, str(tmp_path_factory.mktemp("again"))).awaitTermination()
    assert engine.chunks.rows().count() == n


def test_each_file_is_parsed_once(spark, corpus, tmp_path_factory):
    log = tmp_path_factory.mktemp("calls")

    class Counting:  # travels to the tasks by value
        def blocks(self, content):
            with open(log / "calls", "a") as f:
                f.write("x")
            return [(1, 100.0, 100.0, 0, 0.0, 0.0, 50.0, 9.0, "A page of a paper on bridges, with a good length of text.", 0)]

    engine = Engine(spark, "t_once", parser=Counting())
    assert engine.ingest_corpus(corpus, force=True).count() == 1
    assert (log / "calls").read_text() == "x"
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("t_once_") and t.name not in ("t_once_parents", "t_once_children", "t_once_errors")]
    shown = engine.chunks.show_all(3, 10).collect()
    assert len(shown) == 3 and all(len(r.document) <= 13 for r in shown) and [r.id for r in shown] == sorted(r.id for r in shown)


def test_command_line(spark, corpus, capsys):
    from corpusloom import cli

    cli.main(["--corpus", corpus, "--reset", "bridge number 2"])
    out = capsys.readouterr().out
    assert "bad.json" in out and "N/A" in out and "bridge number 2" in out


def test_files_are_read_and_parsed_in_one_pass(spark, tmp_path):
    for name, content in (("a.json", '{"a": "some text"}'), ("b.xml", "<r><t>more</t></r>"), ("c.pdf", "%PDF"), ("d.json", "[1]")):
        (tmp_path / name).write_text(content)
    loaded = files.load(files.scan(spark, str(tmp_path)))
    plan = loaded._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("binaryFile") == 1 and plan.count("ArrowEvalPython") == 1
    found = {r.source_file: (r.source_type, r.raw_text, r.metadata, r.error) for r in loaded.collect()}
    own = lambda name, kind: {"source_file": name, "source_type": kind}
    assert found["a.json"] == ("json", "A: some text", {"a_short": "some text"} | own("a.json", "json"), None)
    assert found["b.xml"] == ("xml", "[t]: more", own("b.xml", "xml"), None)
    assert found["c.pdf"] == ("pdf", None, own("c.pdf", "pdf"), "no PDF parser is given")
    assert found["d.json"][1] is None and "not an object" in found["d.json"][3]

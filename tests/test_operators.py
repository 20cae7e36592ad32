from corpusloom.operators import chunks, context, pdf, search

BLOCK = "doc string, page int, width double, block_seq int, x0 double, y0 double, x1 double, text string, block_type int"


def pages(spark, texts):
    return spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "doc string, page int, text string")


def repeated(spark, texts):
    p = pages(spark, texts)
    return sorted(r.line for r in pdf.repeated_lines(pdf.page_lines(p), p).collect())


def test_repeated_lines(spark):
    assert repeated(spark, ["same\na1", "same\nb1"]) == []
    assert repeated(spark, ["same\nsame", "same", "same\nno"]) == ["same"]
    assert repeated(spark, ["same"] * 6 + ["x"] * 0 + [f"own{i}" for i in range(14)]) == ["same"]
    assert repeated(spark, ["same"] * 5 + [f"own{i}" for i in range(15)]) == []
    assert repeated(spark, ["same\nsame\nsame", "a", "b"]) == []


def test_page_numbers_go(spark):
    p = pages(spark, ["42\n12345\n ٣ \ntext"])
    lines = pdf.page_lines(p)
    assert sorted(r.line for r in pdf.cleaned(lines, pdf.repeated_lines(lines, p)).collect()) == ["12345", "text"]


def test_layout_and_order(spark):
    rows = [("d", 1, 100.0, 0, 60.0, 0.0, 90.0, "R1", 0), ("d", 1, 100.0, 1, 5.0, 0.0, 40.0, "L1", 0), ("d", 1, 100.0, 2, 60.0, 9.0, 90.0, "R2", 0), ("d", 1, 100.0, 3, 5.0, 9.0, 40.0, "L2", 0), ("d", 1, 100.0, 4, 5.0, 1.0, 40.0, "image", 1)]
    assert [(r.layout) for r in pdf.layouts(spark.createDataFrame(rows, BLOCK)).collect()] == ["multi"]
    assert pdf.documents(spark.createDataFrame(rows, BLOCK)).first().raw_text == "L1\nL2\nR1\nR2"
    three = spark.createDataFrame(rows[:3], BLOCK)
    assert pdf.layouts(three).first().layout == "single" and pdf.documents(three).first().raw_text == "L1\nR1\nR2"


def results(spark):
    rows = [(0, 1, "c1", "p1", 0.1), (0, 2, "c2", "p1", 0.2), (0, 3, "c3", "p2", 0.9), (0, 4, "c4", "p4", 1.2), (0, 5, "c5", "p3", 1.3)]
    return spark.createDataFrame(rows, "query_id long, rank int, id string, parent_id string, distance double")


def rolled(spark, parents, compat):
    table = spark.createDataFrame([(p, p.upper()) for p in parents], "parent_id string, document string")
    got = search.parents(search.within(results(spark)), table, compat).orderBy("rank").collect()
    return [(r.parent_id, r.distance) for r in got]


def test_roll_up(spark):
    assert rolled(spark, ["p1", "p2", "p3", "p4"], False) == [("p1", 0.1), ("p2", 0.9), ("p4", 1.2)]
    assert rolled(spark, ["p1", "p2", "p3", "p4"], True) == [("p1", 0.1), ("p2", 0.2), ("p4", 0.9)]
    assert rolled(spark, ["p1", "p3", "p4"], True) == [("p1", 0.1), ("p4", 0.2)]


def test_results_without_parents_stay(spark):
    table = spark.createDataFrame([("p", "P")], "parent_id string, document string")
    alone = results(spark).selectExpr("query_id", "rank", "id", "cast(null as string) as parent_id", "distance")
    assert search.parents(alone, table).count() == 5


def test_top_k_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "QUESTION_BLOCK", 2)
    vectors = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(20)], "id long, embedding array<double>")
    asked = spark.createDataFrame([(q, [float(q), 1.0]) for q in range(5)], "query_id long, query array<double>")
    got = search.top_k(vectors, asked, 4).collect()
    assert len(got) == 20 and all(r.distance == 0 and r.id == r.query_id + 5 * (r["rank"] - 1) for r in got)


def test_top_k_cuts_before_the_shuffle(spark):
    vectors = spark.createDataFrame([(1, [1.0])], "id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0])], "query_id long, query array<double>")
    plan = search.top_k(vectors, asked, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Cartesian" not in plan and "BatchEvalPython" not in plan


def test_context_and_answers(spark):
    rows = [(0, 1, "a.pdf", "A", 0.5), (0, 2, "b.pdf", "B", 1.3), (0, 3, "c.pdf", "C", 1.2), (1, 1, "d.pdf", "D", 2.0), (2, 1, None, "E", None)]
    found = context.contexts(spark.createDataFrame(rows, "query_id long, rank int, source_file string, document string, distance double"))
    got = {r.query_id: r.context for r in found.collect()}
    assert got == {0: "[Source : a.pdf]\nA\n\n---\n\n[Source : c.pdf]\nC", 1: "", 2: "[Source : source inconnue]\nE"}
    asked = found.selectExpr("query_id", "context", "'q' as question")
    assert {r.query_id: r.answer for r in context.answers(asked, "legal").collect()} == {0: "A", 1: context.NOTHING_FOUND, 2: "E"}

    class Broken:
        def answer(self, prompts):
            raise RuntimeError("down")

    assert "error: down" in {r.answer for r in context.answers(asked, "legal", Broken()).collect()}


def test_questions_go_in_blocks(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "id long, embedding array<double>")
    asked = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(0, 30, 3)], "query_id long, query array<double>")
    want = sorted(map(tuple, search.top_k(vectors, asked, 4).collect()))
    monkeypatch.setattr(search, "QUESTION_BLOCK", 3)
    assert sorted(map(tuple, search.top_k(vectors, asked, 4).collect())) == want and len(want) == 40


def test_chunks_are_numbered_with_and_without_a_shuffle(spark, small):
    from corpusloom.operators import chunks

    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang", "text")
    docs = docs.unionByName(spark.createDataFrame([(9001, "en", ""), (9002, "en", None), (9003, "en", "short"), (9004, "en", "x. " * 2000)], docs.schema))
    columns = ["doc_id", "lang", "id", "chunk_type", "chunk_index", "chunk_total", "chunk"]
    want = sorted(map(tuple, chunks.indexable(chunks.structural(docs), "doc_id").select(columns).collect()))
    got = chunks.indexed(docs, "doc_id").select(columns)
    assert sorted(map(tuple, got.collect())) == want and "Exchange" not in got._jdf.queryExecution().toString()


def test_texts_are_cut_once_and_left_behind(spark, tmp_path):
    spark.createDataFrame([(1, "a. " * 2000), (2, ""), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    for cut, counted in ((chunks.structural(docs), {1: 5, 2: 1}), (chunks.indexed(docs, "doc_id"), {1: 4})):
        plan = cut._jdf.queryExecution().optimizedPlan().toString()
        # nothing above the rows of chunks needs the text, and no filter below makes the chunks once more
        assert "text#" not in plan.partition("Generate")[0]
        assert not [x for x in plan.splitlines() if "Filter" in x and "text#" in x]
        assert {r.doc_id: r["count"] for r in cut.groupBy("doc_id").count().collect()} == counted

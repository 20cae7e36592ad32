"""Element rows against the flattener that walks a document, and as tables in SQL."""

import random

from pyspark.sql import functions as F

from corpusloom.sources import elements, markup


def xml_text(rng, depth=0):
    tag = rng.choice(["p", "div", "Note", "reference", "Reference", "date", "Date", "DATE", "b", "a:x", "numero", "juridiction", "President"])
    body = rng.choice(["", " ", " some words ", "x\n y", "&amp;é"])
    for _ in range(rng.randint(0, 3) if depth < 4 else 0):
        body += rng.choice([xml_text(rng, depth + 1), "<!-- no -->", " tail "])
    return f"<{tag}>{body}</{tag}>"


def test_element_rows_flatten_like_the_document(spark):
    rng = random.Random(1)
    rows = [(i, f'<doc xmlns:a="urn:a" lang="{i}" n="2">{xml_text(rng)}{xml_text(rng)}</doc>') for i in range(150)]
    rows += [(200, "<open>"), (201, None), (202, '<d xmlns="urn:d">t<date>1</date></d>'), (203, "<d/>")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    table = elements.elements(docs, F.col("text"))
    got = {r.doc_id: (r.metadata, r.content) for r in elements.flattened(table, "doc_id").collect()}
    want = {i: markup.xml_document(t) for i, t in rows if t and t != "<open>"}
    assert got == want
    assert [r.error for r in table.where("error is not null").collect()] == ["ParseError: no element found: line 1, column 6"]
    assert table.where("doc_id = 201").count() == 0


def test_rows_of_a_document(spark):
    elements.register(spark)
    spark.createDataFrame([("<a k='v'>one<b>two<c/></b>lost<d>three</d></a>",)], "text string").createOrReplaceTempView("some_xml")
    got = spark.sql("select e.seq, e.parent, e.depth, e.tag, e.own from some_xml s, lateral xml_elements(s.text) e order by seq").collect()
    assert [tuple(r) for r in got] == [(0, None, 0, "a", "one"), (1, 0, 1, "b", "two"), (2, 1, 2, "c", None), (3, 0, 1, "d", "three")]
    page = spark.createDataFrame([("<div class=x>a&amp;b<br>c<p>d</div><p>e",)], "text string")
    got = elements.elements(page, F.col("text"), html=True).orderBy("seq").collect()
    assert [(r.seq, r.parent, r.tag, r.own, r.attributes) for r in got] == [(0, None, "div", "a&b", {"class": "x"}), (1, 0, "br", "c", {}), (2, 0, "p", "d", {}), (3, None, "p", "e", {})]
    assert elements.elements(page.limit(0), F.col("text")).count() == 0


#: A reference that isn't closed stays in texts; scripts and attributes are as before.
UNCLOSED = '<title>a&amp;b &amp</title><p title="x &amp y &copy;">&#233;&#xe9; &ampx; &quot a&b &nosuch; &amp;lt;<script>a && b &amp; c</script><b>&copy;&copy'


def test_flattened_references_without_semicolon_stay():
    assert markup.html_document(UNCLOSED)[1].split("\n") == ["[title]: a&b &amp", "éé &ampx; &quot a&b &nosuch; &lt;", "[b]: ©&copy"]


def test_references_of_rows_without_semicolon_stay(spark):
    got = elements.elements(spark.createDataFrame([(UNCLOSED,)], "text string"), F.col("text"), html=True).orderBy("seq").collect()
    texts = [("title", "a&b &amp"), ("p", "éé &ampx; &quot a&b &nosuch; &lt;"), ("script", "a && b &amp; c"), ("b", "©&copy")]
    assert [(r.tag, r.own) for r in got] == texts
    assert got[1].attributes == {"title": "x & y ©"}

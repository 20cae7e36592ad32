"""Pages whose parts have no telling names: the template removal alone has to find the text."""

import re

from pyspark.sql import functions as F

from corpusloom.llm import pages


def renamed(html):
    """No article, no menu, no footer, no advert: only divisions."""
    html = re.sub(r"<(/?)(article|main|nav|footer)\b", r"<\1div", html)
    return re.sub(r'<div class="?ad"?>', "<div>", html)


def test_renamed_pages_have_the_same_text(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url", "html")
    marked = {r.page_id: r.text for r in pages.main_text(rows).collect()}
    plain = spark.createDataFrame([(r.page_id, r.url, renamed(r.html)) for r in rows.collect()], rows.schema).repartition(4)
    got = pages.main_text(plain).collect()
    assert len(got) == len(marked) and all(r.text == marked[r.page_id] for r in got) and sum(r.n_removed for r in got) >= 3 * len(got)
    # without the counts nothing goes
    some = plain.where("page_id < 50").collect()
    assert all(pages.extract(r.html, set()) != marked[r.page_id] for r in some)


def page(i, body):
    return (i, f"http://h.example/a{i}", f"<html><body>{body}</body></html>")


def texts(spark, rows):
    out = pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    return [r.text for r in out.orderBy("page_id").collect()]


def test_text_in_divisions_without_paragraphs(spark):
    story = lambda i: f"The story number {i} is told here" + " in a few more words than its menu" * 4 + "."
    rows = [page(i, f"<div><a href=x{i}>Home {i}</a><a href=y>All {i}</a></div><div id=c>{story(i)}</div><div>Seen {i} times</div>") for i in range(8)]
    assert texts(spark, rows) == [story(i) for i in range(8)]


def test_prose_beside_the_main_part_stays(spark):
    long = " ".join(f"word{k}" for k in range(30))
    rows = [page(i, f"<div><p>{'Main text of the page, number %d. ' % i * 9}</p></div><div class=x>{i} {long}</div><div class=y>tag {i}</div>") for i in range(8)]
    got = texts(spark, rows)
    assert all(long in t and f"tag {i}" not in t and "Main text" in t for i, t in enumerate(got))


def test_pages_of_one_text_keep_it(spark):
    rows = [page(i, f"<div>only {i}</div>") for i in range(8)] + [page(9, "")]
    assert texts(spark, rows) == [f"only {i}" for i in range(8)] + [""]


def test_shapes_count_with_their_place(spark):
    menu = lambda i: f"<ul><li>m{i}</li><li>n{i}</li></ul>"
    rows = [page(i, f"<div>{menu(i)}</div><div><p>{'The main text goes on. ' * 20}{i}</p><ul><li>point {i}</li></ul></div>") for i in range(8)]
    got = texts(spark, rows)
    assert all(f"point {i}" in t and f"m{i}" not in t for i, t in enumerate(got))

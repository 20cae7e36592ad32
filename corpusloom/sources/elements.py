"""XML and HTML texts as rows of elements, so that the rest is plain SQL: skipping, labels, counts, joins.

``xml_elements(text)`` and ``html_elements(text)`` are table functions. One row per element in document order: seq
(from 0), parent (its seq; null for the root), depth, name_space, tag (as written, without name space), own (the text
between its start tag and whatever comes next; null where there is none) and attributes. A text that can't be parsed gives one row
with nothing but error; a null text gives none.
"""

from __future__ import annotations

import xml.etree.ElementTree as ElementTree
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from .markup import UNLABELLED, XML_METADATA, XML_SKIPPED, ClosedReferences

ELEMENT = "seq int, parent int, depth int, name_space string, tag string, own string, attributes map<string,string>, error string"
#: Elements of HTML that have no end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
FAILED = (None,) * 7


def _xml(text: str) -> Iterator[tuple]:
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError as error:
        yield (*FAILED, f"ParseError: {error}")
        return
    waiting: list[tuple] = [(root, None, 0)]
    seq = 0
    while waiting:
        element, parent, depth = waiting.pop()
        if isinstance(element.tag, str):  # no comments or instructions
            space, _, tag = element.tag.rpartition("}")
            yield seq, parent, depth, space[1:] or None, tag, element.text, dict(element.attrib), None
            waiting += [(e, seq, depth + 1) for e in reversed(element)]
            seq += 1


class _Rows(ClosedReferences):
    def __init__(self):
        super().__init__()
        self.rows: list[list] = []
        self.open: list[int] = []
        self.fresh = False

    def handle_starttag(self, tag, attrs):
        self.rows.append([len(self.rows), self.open[-1] if self.open else None, len(self.open), None, tag, None, {k: self.written(v or "") for k, v in attrs}, None])
        self.fresh = True
        if tag not in VOID:
            self.open.append(len(self.rows) - 1)

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[at]][4] == tag:
                del self.open[at:]
                break
        self.fresh = False

    def handle_data(self, data):
        if self.fresh and self.rows:
            self.rows[-1][5] = self.written(data)
        self.fresh = False


class _XmlElements:
    def eval(self, text):
        if text is not None:
            yield from _xml(text)


class _HtmlElements:
    def eval(self, text):
        if text is not None:
            rows = _Rows()
            rows.read(text)
            yield from map(tuple, rows.rows)


xml_elements = F.udtf(_XmlElements, returnType=ELEMENT)
html_elements = F.udtf(_HtmlElements, returnType=ELEMENT)


def register(spark: SparkSession) -> None:
    """Make both known to SQL: ``select d.*, e.* from docs d, lateral xml_elements(d.text) e``."""
    spark.udtf.register("xml_elements", xml_elements)
    spark.udtf.register("html_elements", html_elements)


def elements(docs: DataFrame, text: Column, html: bool = False) -> DataFrame:
    """The columns of ``docs`` with those of ELEMENT, a row for each element of ``text``."""
    return docs.withColumn("_text", text).lateralJoin((html_elements if html else xml_elements)(F.col("_text").outer())).drop("_text")


def flattened(rows: DataFrame, key: str) -> DataFrame:
    """``key``, metadata and content of XML element rows: metadata from known elements (each in several spellings, the last
    found wins, the first element of a spelling counts) and the root's attributes; content is every other element's own text,
    in order, with its tag as label. Elements in a name space are content only. Keys of equal values are one
    document."""
    own, name = strip(F.coalesce("own", F.lit(""))), F.lower("tag")
    spelling = F.array_position(F.array(*map(F.lit, XML_METADATA)), F.col("tag"))
    known = (spelling > 0) & F.col("parent").isNotNull() & F.col("name_space").isNull()
    # the first element of each spelling; an empty one hides later ones
    firsts = rows.where(known).groupBy(key, "tag").agg(F.min_by(F.struct("own"), "seq")["own"].alias("own")).where("own <> ''")
    meta = firsts.groupBy(key, name.alias("name")).agg(F.max_by(strip(F.col("own")), spelling).alias("value"))
    meta = meta.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("known"))
    line = F.when(name.isin(*UNLABELLED), own).otherwise(F.concat(F.lit("["), name, F.lit("]: "), own))
    shown = F.when((own != "") & ~name.isin(*XML_SKIPPED), F.struct("seq", line.alias("line")))
    roots = F.transform_keys(F.first(F.when(F.col("parent").isNull(), F.col("attributes")), ignorenulls=True), lambda k, _: F.concat(F.lit("attr_"), k))
    whole = rows.where("error is null").groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["line"]), "\n").alias("content"), roots.alias("roots"))
    none = F.create_map().cast("map<string,string>")
    return whole.join(meta, key, "left").select(key, F.map_concat(F.coalesce("known", none), F.coalesce("roots", none)).alias("metadata"), "content")


def root_namespaces(rows: DataFrame, key: str) -> DataFrame:
    """``key`` and root_namespace (null without one) of the documents of XML element rows."""
    return rows.where("parent is null and error is null").select(key, F.col("name_space").alias("root_namespace"))


def own_text(own: Column) -> Column:
    """White space as one space, none at the ends."""
    return F.regexp_replace(strip(own), r"(?U)\s+", " ")

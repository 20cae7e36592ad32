"""Corpus folders and files as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pdf
from . import markup

KINDS = ("pdf", "xml", "json")
LOADED = "path string, source_file string, source_type string, content_hash string, raw_text string, metadata map<string,string>, error string"
BLOCKS = "doc string, page int, width double, height double, block_seq int, x0 double, y0 double, x1 double, y1 double, text string, block_type int"


class PdfParser(Protocol):
    """Anything that can be pickled and turns a file's bytes into block rows: page, width, height, block_seq,
    x0, y0, x1, y1, text, block_type, with a row of null text for a page without blocks. No parser is built in."""

    def blocks(self, content: bytes) -> list[tuple]: ...


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{pdf,xml,json}").load(folder)


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """path, content and kind of all files below ``folder`` whose suffix is, in lower case, .pdf, .xml or .json.
    Names that begin with a dot or underscore are not read."""
    return with_kind(_files(spark, folder))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path, modified (microseconds) and size of the files that ``scan`` reads, without reading any."""
    return _files(spark, folder).select("path", F.unix_micros("modificationTime").alias("modified"), F.col("length").alias("size"))


def contents(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """Like ``scan``, of the (stored) ``wanted`` rows of a listing alone. The range of their times is pushed into the scan,
    which opens no other files; what it holds beside them goes before anything is parsed."""
    span = wanted.agg(F.min("modified").alias("low"), F.max("modified").alias("high"), F.count("*").alias("n")).first()
    if not span.n:
        return scan(spark, folder).where("false")
    time = F.col("modificationTime")
    within = lambda f: f.where((time >= F.timestamp_micros(F.lit(span.low))) & (time <= F.timestamp_micros(F.lit(span.high))))
    found = within(_files(spark, folder))
    if found.select("path").count() > span.n:
        keys = wanted.select("path", F.timestamp_micros("modified").alias("modificationTime"), F.col("size").alias("length"))
        found = found.join(keys, ["path", "modificationTime", "length"], "left_semi")
    return with_kind(found)


def with_kind(files: DataFrame) -> DataFrame:
    return files.select("path", "content", F.regexp_extract("path", r"\.(pdf|xml|json)$", 1).alias("kind"))


def name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def load_markup(files: DataFrame, ns_aware: bool = False) -> DataFrame:
    """XML and JSON files flattened; a file that can't be read has an error and no text, so has one of another kind."""
    text = F.when(F.col("kind").isin("xml", "json"), F.decode("content", "UTF-8"))
    flattened = files.withColumn("f", markup.flatten(F.col("kind"), text, ns_aware))
    return _loaded(flattened, F.col("f.content"), F.col("f.metadata"), F.when(F.col("kind") == "pdf", "no PDF parser is given").otherwise(F.col("f.error")))


def _loaded(files: DataFrame, text: Column, metadata: Column, error: Column) -> DataFrame:
    own = F.create_map(F.lit("source_file"), name(F.col("path")), F.lit("source_type"), F.col("kind"))
    # a file's own fields win over fields of the same name in it
    others = F.map_filter(F.coalesce(metadata, F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("source_file", "source_type"))
    return files.select("path", name(F.col("path")).alias("source_file"), F.col("kind").alias("source_type"), F.sha2("content", 256).alias("content_hash"), text.alias("raw_text"), F.map_concat(others, own).alias("metadata"), error.alias("error"))


def pdf_blocks(files: DataFrame, parser: PdfParser) -> DataFrame:
    """The block table of all PDF files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in BLOCKS.split(", ")]
        for files in batches:
            for path, content in zip(files["path"], files["content"]):
                try:
                    rows = [(path, *b) for b in parser.blocks(bytes(content))]
                except Exception:  # a file without blocks is reported as an error by load_pdf
                    rows = []
                yield pd.DataFrame(rows, columns=columns)

    return files.where("kind = 'pdf'").select("path", "content").mapInPandas(run, BLOCKS)


def load_pdf(files: DataFrame, blocks: DataFrame) -> DataFrame:
    """PDF files from their block table, which is read several times."""
    texts = pdf.documents(blocks)
    joined = files.where("kind = 'pdf'").join(texts.withColumnRenamed("doc", "_doc"), F.col("path") == F.col("_doc"), "left")
    pages = F.create_map(F.lit("num_pages"), F.col("num_pages").cast("string"))
    return _loaded(joined, F.col("raw_text"), F.when(F.col("num_pages").isNotNull(), pages), F.when(F.col("num_pages").isNull(), F.lit("no page could be read")))


def load(files: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """All files; PDF files need a (stored) block table, else they are errors."""
    if blocks is not None:
        return load_markup(files.where("kind <> 'pdf'")).unionByName(load_pdf(files, blocks))
    # a part of its own would read all files once more, as their kind doesn't reach the scan
    return load_markup(files)

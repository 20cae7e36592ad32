"""Ingestion and questions end to end, in one plan for all documents or all questions."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metadata
from ..functions.vectors import Embedder, HashedEmbedder, embed
from ..operators import chunks, context, search
from ..sources import files
from .index import CHILDREN, CHUNKS, PARENTS, Collection, Manifest, new_batch

MODES = ("recursive", "parent-child")
ERRORS = "path string, error string"
#: Files that were read, or failed, as they were then.
FILES = "path string, modified long, size long"


def with_metadata(loaded: DataFrame, domain: str, now: str) -> DataFrame:
    """document_id, text, source_file, domain and the map of the document's metadata, from loaded files."""
    get = lambda key: F.col("metadata")[key]
    kind = F.col("source_type")
    known = F.when(kind.isin("xml", "json"), get("date"))
    xml = lambda key: F.when(kind == "xml", get(key))
    docs = loaded.where("error is null and raw_text <> ''").withColumn("document_id", chunks.document_id(kind, F.col("path"), F.col("content_hash")))
    own = {
        "document_id": F.col("document_id"),
        "source_file": F.col("source_file"),
        "source_type": kind,
        "domain": F.lit(domain),
        "date_decision": known,
        "type_document": F.when(kind == "xml", "ordonnance").when(kind == "json", "document_json"),
        "juridiction": xml("juridiction"),
        "numero_pourvoi": xml("numero"),
        "reference_complete": xml("reference"),
        "date_ingestion": F.lit(now),
        "parties": F.lit(None).cast("array<string>"),
    }
    none = F.lit(None).cast("string")
    stored = metadata.stringified({k: (own.get(k, none), "array<string>" if k == "parties" else "string") for k in metadata.FIELDS})
    return docs.select("document_id", "source_file", F.lit(domain).alias("domain"), F.col("raw_text").alias("text"), stored.alias("metadata"))


class Engine:
    """``mode`` 'parent-child' searches small chunks and returns large ones; any other searches structural chunks. What an
    ingestion writes to the tables is seen when all of it is written: its batch is committed last."""

    def __init__(self, spark: SparkSession, collection: str = "corpus", mode: str = "recursive", domain: str = "tourisme", embedder: Embedder | None = None, parser: files.PdfParser | None = None):
        self.spark, self.mode, self.domain, self.parser = spark, mode, domain, parser
        self.embedder = embedder or HashedEmbedder()
        self.manifest = Manifest(spark, f"commits_of_{collection}")
        names = ((collection, CHUNKS), (f"{collection}_parents", PARENTS), (f"{collection}_children", CHILDREN), (f"{collection}_errors", ERRORS), (f"files_of_{collection}", FILES))
        self.chunks, self.parents, self.children, self.errors, self.files = (Collection(spark, name, schema, self.manifest) for name, schema in names)

    @property
    def active(self) -> Collection:
        return self.children if self.mode == "parent-child" else self.chunks

    @property
    def tables(self) -> tuple[Collection, ...]:
        return self.chunks, self.parents, self.children, self.errors, self.files

    def reset(self) -> None:
        self.manifest.drop()  # from here on nothing is seen
        self.manifest.create()
        for c in self.tables:
            c.reset()

    def vacuum(self) -> int:
        """Delete what failed ingestions left behind; the number of deleted partitions. Not while another one runs."""
        return sum(c.vacuum() for c in self.tables)

    def _stored(self, rows: DataFrame, schema: str) -> Collection:
        table = Collection(self.spark, f"{self.chunks.name}_{uuid.uuid4().hex[:12]}", schema)
        table.add(rows)
        return table

    @contextmanager
    def loaded(self, found: DataFrame) -> Iterator[DataFrame]:
        """The files of a scan, read and parsed once, in a table that is dropped in the end."""
        used = []
        try:
            if self.parser is not None:
                used.append(self._stored(files.pdf_blocks(found, self.parser), files.BLOCKS))
            used.append(self._stored(files.load(found, *[t.rows() for t in used]), files.LOADED))
            yield used[-1].rows()
        finally:
            for table in used:
                table.drop()

    def ingest_corpus(self, folder: str, force: bool = False, now: str = "", update: bool = False) -> DataFrame:
        """Load and index a folder unless the collection has rows; ``force`` empties it first. With ``update`` files are
        indexed that the collection hasn't seen with this path, time and size, whether it has rows or not: the others are
        listed, not read. A file that changed is a new document beside the old one. Returns the files that could not be
        read (path, error)."""
        if force:
            self.reset()
        if update or not self.active.populated():
            keys = ["path", "modified", "size"]
            seen = self.files.rows().select(*keys)
            new = self._stored(files.listing(self.spark, folder).join(seen, keys, "left_anti"), FILES)
            try:
                if new.populated():
                    batch, domain = new_batch(), F.lit(self.domain)
                    with self.loaded(files.contents(self.spark, folder, new.rows())) as loaded:
                        self._write(with_metadata(loaded, self.domain, now), batch)
                        self.errors.add(loaded.where("error is not null").withColumn("domain", domain), batch)
                        self.files.add(new.rows().withColumn("domain", domain), batch)
                    self.manifest.commit(batch)
            finally:
                new.drop()
        return self.errors.rows().select("path", "error")

    def ingest(self, docs: DataFrame, enrich: bool = False) -> None:
        """Index documents (document_id, source_file, domain, text, metadata) that the collection doesn't have, all or
        none."""
        batch = new_batch()
        self._write(docs, batch, enrich)
        self.manifest.commit(batch)

    def _write(self, docs: DataFrame, batch: str, enrich: bool = False) -> None:
        new = self.active.missing(docs)
        if self.mode == "parent-child":
            parent_id = F.concat_ws("_", F.lit("parent"), "document_id", F.col("parent_index").cast("string"))
            cut = chunks.parents_and_children(new).withColumn("parent_id", parent_id)
            small = cut.select(F.concat_ws("_", F.lit("child"), "document_id", F.col("child_index").cast("string")).alias("id"), "parent_id", "document_id", "source_file", "domain", F.col("child").alias("document"), F.map_concat("metadata", F.create_map(F.lit("parent_id"), F.col("parent_id"), F.lit("chunk_type"), F.lit("child"))).alias("metadata"), embed(F.col("child"), self.embedder).alias("embedding"))
            self.parents.add(chunks.parents(new).select(parent_id.alias("id"), "document_id", "source_file", "domain", F.col("parent").alias("document"), "metadata"), batch)
            self.children.add(small, batch)
            return
        if enrich:
            meta = {k: F.col("metadata")[k] for k in ("reference_complete", "juridiction", "date_decision", "numero_pourvoi", "dispositif")}
            cut = chunks.structural(new)
            kept = chunks.indexable(cut.withColumn("chunk", metadata.enriched(F.col("chunk"), meta, F.col("chunk_type"), self.domain)), "document_id")
        else:
            kept = chunks.indexed(new, "document_id")
        more = F.create_map(F.lit("chunk_index"), F.col("chunk_index").cast("string"), F.lit("chunk_type"), F.col("chunk_type"), F.lit("chunk_total"), F.col("chunk_total").cast("string"))
        self.chunks.add(kept.select("id", "document_id", "source_file", "chunk_type", "domain", "chunk_index", "chunk_total", F.col("chunk").alias("document"), F.map_concat("metadata", more).alias("metadata"), embed(F.col("chunk"), self.embedder).alias("embedding")), batch)

    def search(self, questions: DataFrame, n_results: int = 5, filters: dict | None = None, most: float = context.MOST_DISTANCE, compat: bool = False) -> DataFrame:
        """query_id, rank, id, document, source_file, metadata, distance for ``questions`` (query_id, question)."""
        asked = questions.select("query_id", embed(F.col("question"), self.embedder).alias("query"))
        rows = self.active.matching(filters) if filters else self.active.rows()
        columns = ["id", "document", "source_file", "metadata", "embedding"]
        if self.mode != "parent-child":
            return search.top_k(rows.select(*columns), asked, n_results)
        found = search.within(search.top_k(rows.select("parent_id", *columns), asked, n_results), most)
        whole = self.parents.rows().where("document <> ''").select(F.col("id").alias("parent_id"), "document", "source_file", "metadata")
        return search.parents(found.select("query_id", "rank", "id", "parent_id", "distance"), whole, compat).withColumnRenamed("parent_id", "id")

    def answer(self, questions: DataFrame, n_results: int = 5, filters: dict | None = None, model: context.Model | None = None, most: float = context.MOST_DISTANCE) -> DataFrame:
        """``questions`` with context and answer."""
        found = context.contexts(self.search(questions, n_results, filters, most), most)
        asked = questions.join(found, "query_id", "left").na.fill("", ["context"])
        return context.answers(asked, self.domain, model)

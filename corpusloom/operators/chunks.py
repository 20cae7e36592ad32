"""Chunk tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chunking import section, sliding_windows, structural_chunks
from ..functions.text import bound, strip

#: Chunks whose stripped text is shorter are not indexed.
LEAST_CHARS = 50


def windows(docs: DataFrame, size: int, overlap: int, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, with chunk_index and chunk."""
    keep = [c for c in docs.columns if c != text]
    return docs.select(*keep, F.posexplode(sliding_windows(F.col(text), size, overlap)).alias("chunk_index", "chunk"))


def structural(docs: DataFrame, size: int = 1500, overlap: int = 400, text: str = "text") -> DataFrame:
    keep = [c for c in docs.columns if c != text]
    kind = F.when(F.length(text) < size, "full_document").otherwise("general").alias("chunk_type")
    # what needs the whole text is done before there are rows, else every chunk takes the text along; the outer form isn't
    # preceded by a filter that makes all chunks once more
    cut = docs.select(*keep, kind, structural_chunks(F.col(text), size, overlap).alias("_made"))
    return cut.select(*keep, "chunk_type", F.posexplode_outer("_made").alias("chunk_index", "chunk")).where("chunk_index is not null")


def with_sections(chunks: DataFrame, domain: str, chunk: str = "chunk") -> DataFrame:
    """``chunks`` with their chunk_type changed to the section that they have a sign of, if any."""
    return chunks.withColumn("chunk_type", F.coalesce(section(F.col(chunk), domain), "chunk_type"))


PARENT_CHARS, CHILD_CHARS, CHILD_OVERLAP = 2500, 800, 200


def parents(docs: DataFrame, parent_size: int = PARENT_CHARS, text: str = "text") -> DataFrame:
    """One row per parent: parent_index, parent."""
    keep = [c for c in docs.columns if c != text]
    return docs.select(*keep, F.posexplode(sliding_windows(F.col(text), parent_size, 0)).alias("parent_index", "parent"))


def parents_and_children(docs: DataFrame, parent_size: int = PARENT_CHARS, child_size: int = CHILD_CHARS, child_overlap: int = CHILD_OVERLAP, text: str = "text") -> DataFrame:
    """One row per child: parent_index, parent, child_index (over all children of the document), child."""
    keep = [c for c in docs.columns if c != text]
    # earlier parents are full, so the number of their children is known
    step = child_size - child_overlap
    each = 1 if parent_size <= child_size else -(-parent_size // step)
    children = parents(docs, parent_size, text).select(*keep, "parent_index", "parent", F.posexplode(sliding_windows(F.col("parent"), child_size, child_overlap)).alias("at", "child"))
    return children.withColumn("child_index", F.col("parent_index") * each + F.col("at")).drop("at")


def indexable(chunks: DataFrame, document: str, chunk: str = "chunk") -> DataFrame:
    """Chunks that are long enough, with id (dense position) and chunk_total (of those kept)."""
    kept = chunks.where(F.length(strip(F.col(chunk))) >= LEAST_CHARS)
    of_document = Window.partitionBy(document)
    position = F.row_number().over(of_document.orderBy("chunk_index")) - 1
    return kept.withColumn("id", F.concat(F.col(document).cast("string"), F.lit("_chunk_"), position.cast("string"))).withColumn("chunk_total", F.count("*").over(of_document))


def indexed(docs: DataFrame, document: str, size: int = 1500, overlap: int = 400, text: str = "text") -> DataFrame:
    """What ``indexable(structural(docs))`` gives where a document is one row: its chunks are numbered and counted before
    they become rows, without a shuffle."""
    keep = [c for c in docs.columns if c != text]
    kind = F.when(F.length(text) < size, "full_document").otherwise("general").alias("chunk_type")
    pieces = F.transform(structural_chunks(F.col(text), size, overlap), lambda c, i: F.struct(i.alias("chunk_index"), c.alias("chunk")))
    long = F.filter(pieces, lambda p: F.length(strip(p["chunk"])) >= LEAST_CHARS)
    # bound to one name, so that the chunks are not made again for their number
    made = F.flatten(bound(long, lambda p: F.array(F.transform(p, lambda x: F.struct(F.size(p).cast("long").alias("chunk_total"), x.alias("piece"))))))
    # as in structural, no chunk takes the text along
    rows = docs.select(*keep, kind, made.alias("_all")).select(*keep, "chunk_type", F.posexplode_outer("_all").alias("_position", "_made")).where("_position is not null")
    number = F.concat(F.col(document).cast("string"), F.lit("_chunk_"), F.col("_position").cast("string"))
    return rows.select(*keep, "chunk_type", number.alias("id"), F.col("_made.chunk_total"), F.col("_made.piece.chunk_index"), F.col("_made.piece.chunk"))


def document_id(kind: Column, path: Column, content_hash: Column) -> Column:
    """'{type}_{stem}_{8 hex}', the same for the same file."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.concat_ws("_", kind, stem, F.left(F.sha2(F.concat_ws(":", path, content_hash), 256), F.lit(8)))

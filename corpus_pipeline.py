"""A corpus for instruction data: toxic documents go, repeated lines go, near copies go, sources are mixed, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm import lines, mixing, ordinal, packing, setjoin
from corpusloom.llm.common import stored, table

#: SQL can't express the fitted model, the balanced mix or the tokeniser; tests check each stage by brute force.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the model rejects. Rows with null or empty texts, or null ids, are scored like others
    and stay; repeated rows share their fate; without toxic labels all rows stay."""
    return ordinal.accepted(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later occurrences of three-line windows; n_chars follows the text. Null texts and texts of one or two
    lines stay; null ids come last; rows that repeat with id and text are one occurrence, treated alike."""
    out = lines.dedup_lines(docs).select(docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id in each group of similar ones. Rows that share an id are one document: it
    stays or goes with all its texts, and of rows that share the text too one stays. Rows without an id, and texts
    without words, are similar to nothing and stay."""
    joined = setjoin.join(docs)
    kept = joined.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"))
    first = F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy("doc_id"))
    found = rows.where("doc_id is not null").join(kept, "doc_id", "left_semi").withColumn("nth", first)
    return found.where("nth = 1").select("row.*").unionByName(docs.where("doc_id is null"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: not at all, once or twice. A null source is a source; null and empty texts
    count nothing and stay once; repeated rows are documents of their own."""
    return mixing.copied(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces, with their token ids, in sequences. Null texts are empty and still have their end token; repeated rows
    are packed each; no rows give no pieces."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each over the stored result of the one before."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

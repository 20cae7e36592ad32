"""Queries of the operators in this folder: (spark, sf_dir) -> DataFrame, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import iblt, licenses, lines, mixing, negatives, ordinal, packing, pages, pivots, rans, runs, setjoin, transducer
from .common import scratch, table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "rans")
    rans.write_tokens(table(spark, sf_dir, "documents"), path, _tokenizer("byte_bpe_50k.json"), end_id=2)
    return rans.read_tokens(spark, path, with_ids=False)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op3_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.join(table(spark, sf_dir, "documents"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=1, with_ids=False)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprints(table(spark, sf_dir, "documents"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return pivots.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lines.dedup_lines(docs).select("doc_id", "text", "lines_before", "lines_removed")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.count_tokens(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), limit=2048)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(runs.with_periodic_ends(table(spark, sf_dir, "documents")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), "embedding")
    return negatives.hard_negatives(vectors, vectors.where(F.col("vec_id") % 50 == 0))


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_mixing": op2_mixing,
    "op3_shingle_join": op3_shingle_join,
    "op4_main_text": op4_main_text,
    "op5_toxicity": op5_toxicity,
    "op6_packing": op6_packing,
    "op7_fingerprints": op7_fingerprints,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_license_scan": op9_license_scan,
    "op10_line_dedup": op10_line_dedup,
    "op11_token_counts": op11_token_counts,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLES: dict[str, str] = {
    "op3_shingle_join": setjoin.ORACLE,
    "op8_exact_top_k": pivots.ORACLE,
    "op9_license_scan": licenses.oracle(),
    "op10_line_dedup": lines.oracle(),
    "op13_hard_negatives": negatives.ORACLE,
}

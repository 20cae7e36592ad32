"""Collections: persistent tables of chunks with embeddings, written in batches that a manifest makes visible.

Every table is partitioned by domain and batch. An ingestion writes its rows to all its tables under a batch of its own
and then adds the batch to the manifest; rows of batches that are not in it are never read. So parents and children
appear together or not at all, and what a failed ingestion left behind is ignored until ``vacuum`` deletes it.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.metadata import where
from ..functions.text import preview

#: source_file, chunk_type, domain and the like stand beside the metadata map so that filters reach the scan.
CHUNKS = "id string, document_id string, source_file string, chunk_type string, chunk_index int, chunk_total bigint, document string, metadata map<string,string>, embedding array<double>"
PARENTS = "id string, document_id string, source_file string, document string, metadata map<string,string>"
CHILDREN = "id string, parent_id string, document_id string, source_file string, document string, metadata map<string,string>, embedding array<double>"
PARTITIONS = "domain string, batch string"


def _checked(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z_]\w*", name):
        raise ValueError(f"not a table name: {name!r}")
    return name


def new_batch() -> str:
    return f"b{uuid.uuid4().hex[:16]}"


class Manifest:
    """The batches that are committed: one small table for all collections of an engine."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, _checked(name)
        self.create()

    def create(self) -> None:
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (batch string) USING parquet")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def batches(self) -> list[str]:
        """One for each ingestion."""
        self.spark.catalog.refreshTable(self.name)
        return sorted(r.batch for r in self.spark.table(self.name).distinct().collect())

    def commit(self, batch: str) -> None:
        self.spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("append").insertInto(self.name)


class Collection:
    """A table of the session's catalog. With a manifest its rows are those of committed batches; without one, all."""

    def __init__(self, spark: SparkSession, name: str, schema: str, manifest: Manifest | None = None):
        self.spark, self.name, self.schema, self.manifest = spark, _checked(name), schema, manifest
        self.create()

    def create(self) -> None:
        parts = f"PARTITIONED BY (domain, batch) TBLPROPERTIES ('manifest' = '{self.manifest.name}')" if self.manifest else ""
        columns = f"{self.schema}, {PARTITIONS}" if self.manifest else self.schema
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}) USING parquet OPTIONS (compression 'zstd') {parts}")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def reset(self) -> None:
        self.drop()
        self.create()

    def rows(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)  # a streaming batch adds rows in a session of its own
        table = self.spark.table(self.name)
        return table if self.manifest is None else table.where(F.col("batch").isin(self.manifest.batches())).drop("batch")

    def populated(self) -> bool:
        return not self.rows().isEmpty()

    def add(self, rows: DataFrame, batch: str | None = None) -> None:
        """Append ``rows``; those of a collection with a manifest are seen once ``batch`` is committed."""
        if (batch is None) != (self.manifest is None):
            raise ValueError("a batch is needed with a manifest, and only there")
        columns = [f.name for f in self.spark.table(self.name).schema]
        rows = rows if batch is None else rows.withColumn("batch", F.lit(batch))
        rows.select(*columns).write.mode("append").insertInto(self.name)

    def vacuum(self) -> int:
        """Delete the rows of batches that aren't committed. Not while another ingestion runs."""
        kept, gone = set(self.manifest.batches()), 0
        for (partition,) in self.spark.sql(f"SHOW PARTITIONS {self.name}").collect():
            values = dict(x.split("=", 1) for x in partition.split("/"))
            if values["batch"] not in kept:
                domain = values["domain"].replace("'", "\\'")
                self.spark.sql(f"ALTER TABLE {self.name} DROP PARTITION (domain = '{domain}', batch = '{values['batch']}')")
                gone += 1
        return gone

    def matching(self, filters: dict) -> DataFrame:
        """The rows that a filter dictionary selects. Keys that are columns of the table are compared there, so that
        partitions and Parquet statistics leave out what can't match; others in the metadata map."""
        rows = self.rows()
        plain = {f.name: f.dataType.typeName() for f in rows.schema if f.dataType.typeName() in ("string", "integer", "long")}
        numbers = tuple(n for n, kind in plain.items() if kind != "string")
        return rows.where(where(F.col("metadata"), filters, {n: F.col(n) for n in plain if n != "document"}, numbers))

    def missing(self, documents: DataFrame) -> DataFrame:
        """The rows of ``documents`` (document_id, ...) that the collection doesn't have yet."""
        return documents.join(self.rows().select("document_id").distinct(), "document_id", "left_anti")

    def get(self, ids: list[str]) -> DataFrame:
        return self.rows().where(F.col("id").isin(ids))

    def by_source(self, part: str, n: int = 5) -> DataFrame:
        return self.rows().where(F.contains(F.lower("source_file"), F.lower(F.lit(part)))).orderBy("id").limit(n)

    def preview(self, n: int = 3) -> DataFrame:
        return self.rows().orderBy("id").limit(n)

    def show_all(self, most: int = 100, chars: int = 200) -> DataFrame:
        """id, source_file, document (cut to ``chars``) of the first ``most`` rows by id."""
        return self.preview(most).select("id", "source_file", preview(F.col("document"), chars).alias("document"))


def footer_counts(spark: SparkSession, folder: str, schema: StructType | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """n, the number of rows of a folder of Parquet files, by its partition columns if these are given. Counts come from the
    files' footers: the aggregate is pushed into the scan. The session is a new one, whose settings the caller's lacks."""
    session = spark.newSession()
    session.conf.set("spark.sql.sources.useV1SourceList", "")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    session.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    reader = session.read.format("parquet")
    rows = (reader.schema(schema) if schema is not None else reader).load(folder)
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def _count(spark: SparkSession, name: str) -> int:
    about = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
    found = spark.sql(f"SHOW TBLPROPERTIES {name}").where("key = 'manifest'").first()
    schema = spark.table(name).schema
    if found is None:
        return footer_counts(spark, about["Location"], schema).first().n
    kept = set(Manifest(spark, found.value).batches())
    return sum(r.n for r in footer_counts(spark, about["Location"], schema, ("domain", "batch")).collect() if r.batch in kept)


def collections(spark: SparkSession) -> DataFrame:
    """name, n of all collections: tables with the columns of one. No row is read for it."""
    tables = [t.name for t in spark.catalog.listTables() if not t.isTemporary]
    names = [n for n in tables if {"id", "document_id", "document", "metadata"} <= set(spark.table(n).columns)]
    return spark.createDataFrame([(n, _count(spark, n)) for n in names], "name string, n long")

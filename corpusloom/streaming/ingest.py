"""Ingestion of files as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Engine, with_metadata
from ..sources import files


def ingest_stream(engine: Engine, folder: str, checkpoint: str, now: str = "", available_now: bool = True) -> StreamingQuery:
    """Index new files of ``folder``. Documents that the collection already has are left out, so a batch that
    is run again after a failure adds nothing twice."""

    def batch(arrived: DataFrame, _: int) -> None:
        with engine.loaded(arrived) as loaded:
            engine.ingest(with_metadata(loaded, engine.domain, now))

    schema = "path string, modificationTime timestamp, length long, content binary"
    arriving = engine.spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.{pdf,xml,json}").option("recursiveFileLookup", True).load(folder)
    writer = files.with_kind(arriving).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()

"""Nearest-neighbour search for batches of questions, exact or in the cells of an index, thresholds and parent roll-up."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .nearest import Nearest, matrices
from .scratch import kept

#: Questions that are sent to all tasks together; more go block by block.
QUESTION_BLOCK = 1024
#: Tables of vectors up to this size are dealt out to all cores first; larger ones have enough parts.
SPREAD_BYTES = 256 << 20


def _spread(vectors: DataFrame) -> DataFrame:
    size = int(str(vectors._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return vectors.repartition(vectors.sparkSession.sparkContext.defaultParallelism) if size <= SPREAD_BYTES else vectors


def blocks(questions: DataFrame) -> Iterator[pa.Table]:
    """``questions`` in blocks of about QUESTION_BLOCK rows, computed once."""
    first = questions.limit(QUESTION_BLOCK + 1).toArrow()
    if first.num_rows <= QUESTION_BLOCK:
        yield first
        return
    questions = kept(questions, "questions")
    n = math.ceil(questions.count() / QUESTION_BLOCK)
    for b in range(n):
        yield questions.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b).toArrow()


def _nearest(vectors: DataFrame, asked: pa.Table, query_type: StructField, k: int, metric: str, digits: int | None, probes: dict[int, np.ndarray] | None) -> DataFrame:
    """query_id, the columns of ``vectors`` but embedding and cell, distance: each task's best for a block of questions.
    With ``probes`` (cell -> question numbers) only rows of these cells are compared, with these questions."""
    shown = [c for c in vectors.columns if c not in ("embedding", "cell")]
    schema = StructType([query_type, *[vectors.schema[c] for c in shown], StructField("distance", DoubleType())])
    own = (asked.column("query_id").combine_chunks(), list(matrices(asked.column("query").combine_chunks())), probes)
    shared = vectors.sparkSession.sparkContext.broadcast(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, questions, probes = shared.value
        held = {m.shape[1]: (numbers, Nearest(m, k, metric, digits)) for numbers, m in questions}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            cells = None if probes is None else batch.column("cell").to_numpy(zero_copy_only=False)
            for rows, matrix in matrices(batch.column("embedding")):
                if matrix.shape[1] not in held:
                    continue
                numbers, best = held[matrix.shape[1]]
                if cells is None:
                    best.look(table.select(shown).take(pa.array(rows)), matrix)
                    continue
                for cell in np.unique(cells[rows]):
                    some = np.flatnonzero(cells[rows] == cell)
                    wanted = np.flatnonzero(np.isin(numbers, probes.get(int(cell), ())))
                    if len(wanted):
                        best.look(table.select(shown).take(pa.array(rows[some])), matrix[some], wanted)
        for numbers, best in held.values():
            if (found := best.found()) is not None:
                slots, table, distance = found
                columns = [query_ids.take(pa.array(numbers[slots])), *[c.combine_chunks() for c in table.columns], pa.array(distance, pa.float64())]
                yield from pa.Table.from_arrays(columns, names=schema.names).to_batches()

    return vectors.mapInArrow(run, schema)


def ranked(found: DataFrame, k: int, digits: int | None) -> DataFrame:
    """The ``k`` nearest of all tasks, with rank."""
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    shown = found if digits is None else found.withColumn("distance", F.round("distance", digits))
    cut = shown.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return cut.select("query_id", "rank", *[c for c in found.columns if c not in ("query_id", "distance")], "distance")


def top_k(vectors: DataFrame, questions: DataFrame, k: int, metric: str = "l2_sq", digits: int | None = None) -> DataFrame:
    """query_id, rank, the columns of ``vectors`` but the embedding, distance: the ``k`` nearest rows of
    ``vectors`` (id, embedding, ...) for each of ``questions`` (query_id, query); ties go to the smaller id.

    Block by block, about QUESTION_BLOCK questions are sent to the vectors, which stay where they are (small tables are
    dealt out to all cores first); a task multiplies them with its vectors and keeps the ``k`` nearest of each. Distances
    decide as they are rounded to ``digits``. Vectors that are null, hold nulls or have another length than the question
    are at no distance and take no part, nor do zero vectors by cosine.
    """
    if metric not in ("l2_sq", "l2", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    wide, query_type = _spread(vectors), questions.schema["query_id"]
    return reduce(DataFrame.unionByName, [ranked(_nearest(wide, asked, query_type, k, metric, digits, None), k, digits) for asked in blocks(questions)])


def within(results: DataFrame, most: float = 1.2) -> DataFrame:
    """Results up to the distance; ranks stay. A missing distance counts as 0."""
    return results.where(F.coalesce("distance", F.lit(0.0)) <= most)


def parents(results: DataFrame, parent_table: DataFrame, compat: bool = False) -> DataFrame:
    """Roll child results (with parent_id) up to parents in the order of their best child. The distance is the
    best child's; ``compat`` gives the n-th parent the n-th child's instead. A question none of whose results
    has a parent keeps its results."""
    child = Window.partitionBy("query_id")
    marked = results.withColumn("_any", F.max(F.col("parent_id").isNotNull()).over(child)).withColumn("_nth", F.row_number().over(child.orderBy("rank")))
    with_parent = marked.where("_any and parent_id is not null")
    best = with_parent.groupBy("query_id", "parent_id").agg(F.min("rank").alias("_first"), F.min("distance").alias("distance"))
    found = best.join(parent_table, "parent_id").withColumn("rank", F.row_number().over(child.orderBy("_first")))
    if compat:
        places = marked.select(F.col("query_id").alias("_q"), "_nth", F.col("distance").alias("_d"))
        found = found.join(places, (F.col("query_id") == F.col("_q")) & (F.col("rank") == F.col("_nth"))).withColumn("distance", F.col("_d")).drop("_q", "_nth", "_d")
    alone = marked.where("not _any").select("query_id", "rank", F.col("id").alias("parent_id"), "distance")
    return found.drop("_first").unionByName(alone, allowMissingColumns=True)

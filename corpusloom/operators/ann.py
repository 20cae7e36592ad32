"""Approximate nearest-neighbour search: an inverted file, one partition of the table for each cell."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .nearest import matrices
from .scratch import place
from .search import _nearest, blocks, ranked, top_k

#: Vectors that the cells are fitted on (all vectors are indexed), most cells, and rounds of fitting.
SAMPLE, MOST_CELLS, ROUNDS = 16_384, 4096, 12
#: Questions that the number of probes is tuned with.
TUNED_WITH = 128


def _squares(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (centres * centres).sum(1)[None] - 2 * vectors @ centres.T


def fitted(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres of ``cells`` groups of the sample (k-means; an empty group gets the vector that is farthest from its own)."""
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(ROUNDS):
        gaps = _squares(sample, centres)
        own = gaps.argmin(1)
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=cells)
        np.add.at(sums, own, sample)
        centres = sums / np.maximum(n, 1)[:, None]
        if (n == 0).any():
            far = np.argsort(-(gaps[np.arange(len(sample)), own] + (sample * sample).sum(1)))
            centres[n == 0] = sample[far[: (n == 0).sum()]]
    return centres


class IvfIndex:
    """Vectors (id, embedding, ...) of one length by the cell of the nearest centre, in a table partitioned by cell.
    Searches read the cells whose centres are nearest to a question, and compare exactly there."""

    def __init__(self, table: DataFrame, centres: np.ndarray, probes: int = 1):
        self.table, self.centres, self.probes = table, centres, probes

    @classmethod
    def build(cls, vectors: DataFrame, path: str | None = None, cells: int | None = None, sample: int = SAMPLE) -> IvfIndex:
        """Every row with a vector is indexed; the cells (by default about the root of the number of rows) are fitted on the
        ``sample`` rows of the least hashes. The most frequent length of these is the index's; rows of other lengths, or
        with null or non-finite components, are left out, as they are at no distance from its questions. Cells of many
        rows are written by several tasks."""
        spark = vectors.sparkSession
        path = path or place(spark, "ivf")
        good = vectors.where(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
        chosen = good.select("embedding", F.xxhash64("id").alias("h")).orderBy("h").limit(sample).select("embedding").toArrow()
        groups = list(matrices(chosen.column(0).combine_chunks())) if chosen.num_rows else []
        points = max((m for _, m in groups), key=len, default=np.zeros((1, 1)))
        width = points.shape[1]
        good = good.where(F.size("embedding") == width)
        cells = cells or max(1, min(MOST_CELLS, round(good.count() ** 0.5)))
        centres = fitted(points, min(cells, len(points)))
        shared = spark.sparkContext.broadcast(centres)
        schema = StructType([*good.schema.fields, StructField("cell", IntegerType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = np.zeros(batch.num_rows, np.int32)
                for rows, matrix in matrices(batch.column("embedding")):
                    cell[rows] = _squares(matrix, shared.value).argmin(1)
                yield batch.append_column("cell", pa.array(cell))

        # rows of a cell come together, in parts of bounded size
        good.mapInArrow(run, schema).hint("rebalance", "cell").write.partitionBy("cell").parquet(path)
        return cls(spark.read.schema(schema).parquet(path), centres)

    def _order(self, asked: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Question numbers, and the cells from the nearest on for each."""
        for rows, matrix in matrices(asked.column("query").combine_chunks()):
            if matrix.shape[1] == self.centres.shape[1]:
                return rows, np.argsort(_squares(matrix, self.centres), axis=1, kind="stable")
        return np.zeros(0, int), np.zeros((0, len(self.centres)), int)

    def cells(self, asked: pa.Table, probes: int) -> dict[int, np.ndarray]:
        """cell -> numbers of the questions that probe it."""
        rows, order = self._order(asked)
        near = order[:, :probes]
        numbers, cells = np.repeat(rows, near.shape[1]), near.ravel()
        return {int(c): numbers[cells == c] for c in np.unique(cells)}

    def search(self, questions: DataFrame, k: int, probes: int | None = None, metric: str = "l2_sq", digits: int | None = None) -> DataFrame:
        """Like the exact ``search.top_k``, over the ``probes`` nearest cells of each question; other partitions aren't
        read. With as many probes as cells it is exact."""
        parts = []
        for asked in blocks(questions):
            probed = self.cells(asked, probes or self.probes)
            rows = self.table.where(F.col("cell").isin(sorted(probed)))
            parts.append(ranked(_nearest(rows, asked, questions.schema["query_id"], k, metric, digits, probed), k, digits))
        return reduce(DataFrame.unionByName, parts)

    def tuned(self, k: int, recall: float = 0.95, questions: DataFrame | None = None) -> IvfIndex:
        """This index with the fewest probes by which ``recall`` of the true nearest are found, for ``questions`` (by
        default vectors of the table itself, those of the least hashes). One exact search tells in which cells these are."""
        if questions is None:
            questions = self.table.orderBy(F.xxhash64("id", F.lit(1))).limit(TUNED_WITH).select(F.monotonically_increasing_id().alias("query_id"), F.col("embedding").alias("query"))
        asked = questions.limit(TUNED_WITH).toArrow()
        again = self.table.sparkSession.createDataFrame(asked)
        exact = top_k(self.table.withColumnRenamed("cell", "own_cell").select("id", "own_cell", "embedding"), again, k).select("query_id", "own_cell").toArrow()
        rows, order = self._order(asked)
        place_of = {q: np.argsort(order[i]) for i, q in enumerate(asked.column("query_id").take(pa.array(rows)).to_pylist())}
        needed = np.sort([place_of[q][c] for q, c in zip(*(exact.column(c).to_pylist() for c in ("query_id", "own_cell")))])
        if not len(needed):
            return self
        return IvfIndex(self.table, self.centres, int(needed[max(0, int(np.ceil(recall * len(needed))) - 1)]) + 1)

"""Exact top-k by inner product with pivot-table elimination.

Distances of every vector to ``PIVOTS`` pivots are computed once and stored. For a query q and a candidate x the
triangle inequality gives, over all pivots p, the lower bound ``max |d(q,p) - d(x,p)|`` of d(q,x), hence
an upper bound of the inner product, ``(|q|^2 + |x|^2 - d(q,x)^2) / 2``, widened by what rounding can change in it
(see ``margins``), so that elimination is exact for vectors of any length. Queries go in blocks of a fixed size to
all candidates, which stay where they are: a task takes its candidates in the order of their bounds, in slices, and
stops where no bound left reaches the k-th best score that it has for the query, from earlier slices and earlier
batches too. The tasks' best are merged by a ranking window.

Defined results: components are floor(64 * x); rows without an id, and vectors that are null or hold null
or non-finite components, take no part; vectors of different lengths have no score; a query never finds
rows of its own id; of rows that repeat a query's id the smallest vector asks; repeated candidates all
count; ties go to the smaller id. Scores are exact; one beyond a long raises an error. No rows give no rows. Extra
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

PIVOTS = 64
#: Queries that are sent to all tasks together.
QUERY_BLOCK = 4096
#: Candidates of the first slice; each slice is twice as long as the one before.
FIRST = 64
#: Rounding of one operation in double and in single precision.
EPS, EPS_SINGLE = 2.0**-53, 2.0**-24
LEAST_SCORE = np.iinfo(np.int64).min


def quantised(embedding: Column) -> Column:
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * 64).cast("long"))


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, v of the rows that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v"))


def _by_width(vectors: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The numbers of the rows of each length, and their matrix."""
    widths = np.diff(vectors.offsets.to_numpy())
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        yield rows, np.asarray(vectors.take(pa.array(rows)).flatten(), np.int64).reshape(len(rows), width)


def distances(matrix: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    matrix = matrix.astype(np.float64)
    squares = (matrix * matrix).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * matrix @ pivots.T
    return np.sqrt(np.maximum(squares, 0)).astype(np.float32)


def with_distances(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """vec_id, v, to_pivots. Lengths that have no pivot keep one distance of 0, which eliminates nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty(batch.num_rows, object)
            for rows, matrix in _by_width(batch.column(1)):
                p = pivots.get(matrix.shape[1])
                for i, d in zip(rows, np.zeros((len(rows), 1), np.float32) if p is None else distances(matrix, p)):
                    out[i] = d
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out.tolist(), pa.list_(pa.float32()))], ["vec_id", "v", "to_pivots"])

    return vectors.mapInArrow(run, "vec_id long, v array<long>, to_pivots array<float>")


def margins(squares: np.ndarray, to_pivots: np.ndarray, root: float) -> np.ndarray:
    """How far the stored distances of vectors of these squared lengths can be from the true ones. Stored in single
    precision, a distance is off by EPS_SINGLE of it; four times that of the sum of both lengths (a pivot is at most as long
    as a vector and its distance together) covers the later subtraction. Sums of whole numbers below 2^53 are exact in
    double precision; beyond, a squared distance is off by (width + 3) EPS of the squared sum of the lengths, and
    its root by ``root`` of that sum."""
    both = 2 * np.sqrt(squares) + to_pivots.max(1, initial=0).astype(np.float64)
    return both * (4 * EPS_SINGLE + np.where(both * both >= 2.0**52, root, 0))


def scores(vectors: np.ndarray, query: np.ndarray, most: float) -> np.ndarray:
    """Inner products of whole numbers, none beyond ``most``, as 64-bit integers."""
    if most < 2.0**62:
        return vectors @ query
    return (vectors.astype(object) @ query.astype(object)).astype(np.int64)  # an error if one is no long


class Best:
    """The best ``k`` of the candidates so far, for each query of one length."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, to_pivots: np.ndarray, k: int):
        self.ids, self.queries, self.to_pivots, self.k = ids, queries, to_pivots, k
        self.squares = (queries.astype(np.float64) ** 2).sum(1)
        self.scores = [np.zeros(0, np.int64)] * len(ids)
        self.found = [np.zeros(0, np.int64)] * len(ids)
        self.scored = np.zeros(len(ids), np.int64)

    def look(self, ids: np.ndarray, vectors: np.ndarray, to_pivots: np.ndarray) -> None:
        squares, columns = (vectors.astype(np.float64) ** 2).sum(1), to_pivots.T.copy()
        width = vectors.shape[1]
        # sums of whole numbers up to 2^24 are exact in single precision, up to 2^53 in double
        most = math.sqrt(float(self.squares.max() * squares.max())) * (1 + (width + 2) * EPS)
        exact = np.float32 if most < 2.0**23 else np.float64 if most < 2.0**51 else None
        fast, queries = (vectors.astype(exact), self.queries.astype(exact)) if exact else (vectors, self.queries)
        root = math.sqrt((width + 3) * EPS)
        own, other = margins(self.squares, self.to_pivots, root), margins(squares, to_pivots, root)
        apart = np.empty_like(columns)
        for i in range(len(self.ids)):
            np.abs(np.subtract(columns, self.to_pivots[i][:, None], out=apart), out=apart)
            far = np.maximum(apart.max(0).astype(np.float64) - own[i] - other, 0)
            bound = (self.squares[i] + squares - far * far) / 2 + 0.5
            bound += (width + 8) * EPS * (self.squares[i] + squares)
            live = np.flatnonzero((ids != self.ids[i]) & (bound >= self.least(i)))
            live = live[np.argsort(-bound[live])]
            at, step = 0, FIRST
            while at < len(live) and bound[live[at]] >= self.least(i):
                some = live[at : at + step]
                new = (fast[some] @ queries[i]).astype(np.int64) if exact else scores(vectors[some], self.queries[i], most)
                good = np.flatnonzero(new >= self.least(i))
                if len(good):
                    values, found = np.concatenate([self.scores[i], new[good]]), np.concatenate([self.found[i], ids[some[good]]])
                    best = np.lexsort((found, ~values))[: self.k]
                    self.scores[i], self.found[i] = values[best], found[best]
                self.scored[i] += len(some)
                at, step = at + step, 2 * step

    def least(self, i: int) -> int:
        return int(self.scores[i][-1]) if len(self.scores[i]) == self.k else LEAST_SCORE


def search(table: DataFrame, asked: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, vec_id, score: the tasks' best of the candidates in ``table``; and scored, with the first row of a
    query in a task how many candidates the task scored. Both tables are from ``with_distances``."""
    spark = table.sparkSession
    blocks = max(1, math.ceil(asked.count() / block))
    numbered = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    out = None
    for b in range(blocks):
        # about ``block`` rows
        shared = spark.sparkContext.broadcast(numbered.where(F.col("block") == b).drop("block").toArrow().combine_chunks())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, Best] = {}
            own = shared.value
            if own.num_rows:
                ids, vectors, pivots = (own.column(c).combine_chunks() for c in ("vec_id", "v", "to_pivots"))
                for rows, matrix in _by_width(vectors):
                    held[matrix.shape[1]] = Best(np.asarray(ids)[rows], matrix, np.stack(pivots.take(pa.array(rows)).to_numpy(zero_copy_only=False)), k)
            for batch in batches:
                for rows, matrix in _by_width(batch.column(1)):
                    if best := held.get(matrix.shape[1]):
                        best.look(np.asarray(batch.column(0))[rows], matrix, np.stack(batch.column(2).take(pa.array(rows)).to_numpy(zero_copy_only=False)))
            for best in held.values():
                n = np.array([len(x) for x in best.found])
                firsts = (np.cumsum(n) - n)[n > 0]
                scored = np.zeros(n.sum(), np.int64)
                scored[firsts] = best.scored[n > 0]
                columns = [np.repeat(best.ids, n), np.concatenate(best.found), np.concatenate(best.scores), scored]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["query_id", "vec_id", "score", "scored"])

        part = table.mapInArrow(run, "query_id long, vec_id long, score long, scored long")
        part = stored(part, "found") if blocks > 1 else part
        out = part if out is None else out.unionByName(part)
    return out


def pivot_tables(vectors: DataFrame, queries: DataFrame, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """The stored tables of the candidates and of the queries (both vec_id, embedding)."""
    rows = valid(vectors)
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(pivots).collect()  # as many rows as there are pivots
    by_width: dict[int, list[list[int]]] = {}
    for r in chosen:
        by_width.setdefault(len(r.v), []).append(list(r.v))
    points = {w: np.array(p, np.float64) for w, p in by_width.items()}
    asked = valid(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    return stored(with_distances(rows, points), "pivot-table"), stored(with_distances(asked, points), "queries")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest scores of each row of ``queries`` among ``vectors``
    (both vec_id, embedding)."""
    found = search(*pivot_tables(vectors, queries, pivots), k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.v, c.v)::bigint as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0)
select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 20
"""

"""Hard negatives by exact integer products, several candidates at once (Kronecker packing).

The components of a candidate are whole numbers. A constant makes them non-negative, then several candidates are packed
into one wide integer per dimension, each in a field of its own. One product of an anchor's component with
such an integer is the product with every candidate in it, and the sum over the dimensions holds all their scores; a second
constant keeps every field from going below 0, so that shifts and masks take them apart. The width of a field follows
from the greatest component and the anchors' sums, so no field can reach the next. Integers of up to 53 bits are kept as
doubles, where every sum below that is exact, so that one matrix product multiplies them; fields that need more go into
Python integers of any width.

Anchors go in blocks of a fixed size to all candidates, which stay where they are. A first pass takes each anchor's best
rows of its own label, a second one for each anchor and positive the best rows of other labels in the positive's range of
scores; a task keeps only the best of each, and a ranking window merges the tasks. No label is gathered anywhere.

Defined results: components are floor(256 * x); rows without an id or a label, and vectors that are null or hold null or
non-finite components, take no part; vectors of different lengths have no score; an anchor never finds rows of its own
id; of rows that repeat an anchor's id the smallest (label, vector) is the anchor; repeated candidates all count;
ties go to the smaller id. Scores beyond a long raise an error. An anchor without positives, or a positive without
negatives in its range, has no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, stored

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: Negatives have at least and at most so many hundredths of the positive's score.
LEAST, MOST = 50, 95
#: Anchors that are sent to all tasks together, and candidates that they are multiplied with at a time.
ANCHOR_BLOCK, SLICE = 4096, 2048
#: Bits of a double that hold whole numbers, and fields of an integer that is wider.
EXACT_BITS, WIDE_FIELDS = 53, 8


def valid(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, v of the rows that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))


def _ints(matrix: np.ndarray) -> np.ndarray:
    return matrix.astype(object)


def products(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """All inner products (anchors x candidates) of integer matrices, exactly, by packed multiplication."""
    n, width = candidates.shape
    if not n or not len(anchors) or not width:
        return np.zeros((len(anchors), n), np.int64)
    bias = max(0, -int(candidates.min()))
    top = int(candidates.max()) + bias
    # python integers: sums of absolute components may pass 63 bits
    sums = np.abs(anchors.astype(np.float64)).sum(1).max()
    reach = int(_ints(np.abs(_ints(anchors))).sum(1).max()) if sums > 2.0**52 else int(np.abs(anchors).sum(1).max())
    most = max(1, reach * top)  # no field is farther from 0
    bits = (2 * most).bit_length()
    fields = EXACT_BITS // bits
    exact = fields > 0
    fields = min(n, fields or WIDE_FIELDS)
    groups = -(-n // fields)
    padded = np.zeros((groups * fields, width), np.int64 if exact else object)
    padded[:n] = candidates if exact else _ints(candidates)
    padded[:n] += bias
    by_field = padded.reshape(groups, fields, width)
    packed = reduce(lambda high, j: (high << bits) + by_field[:, j], range(fields - 2, -1, -1), by_field[:, fields - 1])
    if exact:
        wide = (anchors.astype(np.float64) @ packed.T.astype(np.float64)).astype(np.int64)
    else:
        wide = _ints(anchors) @ packed.T
    # the constants: fields are not below 0, and scores are without the bias
    wide = wide + sum(most << bits * j for j in range(fields))
    back = (most + bias * (anchors if exact else _ints(anchors)).sum(1))[:, None]
    out = np.empty((len(anchors), groups, fields), np.int64)
    for j in range(fields):
        field = (wide >> bits * j) & ((1 << bits) - 1)
        out[:, :, j] = (field - back).astype(np.int64)  # an error if a score is no long
    return out.reshape(len(anchors), groups * fields)[:, :n]


class Best:
    """The best ``k`` (score, id) of each slot: higher scores first, then smaller ids."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        #: Less is of no use to the slot.
        self.least = np.full(slots, np.iinfo(np.int64).min)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, ids = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, ~score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        firsts = np.flatnonzero(np.diff(slot, prepend=-1))
        rank = np.arange(len(slot)) - np.repeat(firsts, np.diff(firsts, append=len(slot)))
        kept = rank < self.k
        self.slot, self.score, self.id = slot[kept], score[kept], ids[kept]
        full = rank == self.k - 1
        self.least[slot[full]] = score[full]


def _by_width(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and matrix (vec_id, label, v) of the rows of each length, in slices."""
    ids, labels, vectors = (batch.column(i) for i in range(3))
    widths = np.diff(vectors.offsets.to_numpy())
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        for at in range(0, len(rows), SLICE):
            some = rows[at : at + SLICE]
            matrix = np.asarray(vectors.take(pa.array(some)).flatten(), np.int64).reshape(len(some), width)
            yield np.asarray(ids)[some], np.asarray(labels)[some], matrix


def _matrices(rows: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """width -> (row numbers, matrix) of the anchors' vectors (column v)."""
    vectors = rows.column("v").combine_chunks()
    widths = np.diff(vectors.offsets.to_numpy())
    out = {}
    for width in np.unique(widths):
        some = np.flatnonzero(widths == width)
        out[int(width)] = some, np.asarray(vectors.take(pa.array(some)).flatten(), np.int64).reshape(len(some), width)
    return out


PAIRS = "slot long, score long, vec_id long"


def _pairs(best: Best) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (best.slot, best.score, best.id)], ["slot", "score", "vec_id"])


def _merged(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _positives(rows: DataFrame, shared, k: int) -> DataFrame:
    """slot (row number of the anchor), rank, score, vec_id of the best rows of the anchors' labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, _ = shared.value
        own, own_label = (np.asarray(anchors.column(c).combine_chunks()) for c in ("vec_id", "label"))
        matrices, best = _matrices(anchors), Best(len(own), k)
        for batch in batches:
            for ids, labels, matrix in _by_width(batch):
                if matrix.shape[1] not in matrices:
                    continue
                numbers, queries = matrices[matrix.shape[1]]
                for label in np.unique(labels):
                    # only rows of one label are multiplied
                    asked, some = np.flatnonzero(own_label[numbers] == label), np.flatnonzero(labels == label)
                    scores = products(queries[asked], matrix[some])
                    slots = numbers[asked]
                    good = (scores >= best.least[slots][:, None]) & (ids[some][None] != own[slots][:, None])
                    i, j = np.nonzero(good)
                    best.add(slots[i], scores[i, j], ids[some][j])
        yield _pairs(best)

    return _merged(rows.mapInArrow(run, PAIRS), k)


def _negatives(rows: DataFrame, shared, each: int, k: int) -> DataFrame:
    """slot (``each`` times the anchor's row number plus the positive's rank from 0), rank, score, vec_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, ranges = shared.value
        own, own_label = (np.asarray(anchors.column(c).combine_chunks()) for c in ("vec_id", "label"))
        matrices, best = _matrices(anchors), Best(len(own) * each, k)
        for batch in batches:
            for ids, labels, matrix in _by_width(batch):
                if matrix.shape[1] not in matrices:
                    continue
                numbers, queries = matrices[matrix.shape[1]]
                scores = products(queries, matrix)
                other = (labels[None] != own_label[numbers][:, None]) & (ids[None] != own[numbers][:, None])
                for nth in range(each):
                    slots = numbers * each + nth
                    low = np.maximum(ranges[0, slots], best.least[slots])
                    i, j = np.nonzero((scores >= low[:, None]) & (scores <= ranges[1, slots][:, None]) & other)
                    best.add(slots[i], scores[i, j], ids[j])
        yield _pairs(best)

    return _merged(rows.mapInArrow(run, PAIRS), k)


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, block: int = ANCHOR_BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row of ``anchors`` and each of
    its best ``positives`` rows of the same label, the first ``negatives`` rows of other labels whose score is between
    ``least`` and ``most`` hundredths of the positive's (all tables: vec_id, label, embedding)."""
    spark = vectors.sparkSession
    # all the work is done where the rows are, so they are dealt out evenly
    rows = stored(valid(vectors).repartition(shuffle_partitions(spark)), "candidates")
    asked = stored(valid(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.*"), "anchors")
    blocks = max(1, math.ceil(asked.count() / block))
    out = None
    for b in range(blocks):
        # about ``block`` rows, and as many times ``positives``
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow().combine_chunks()
        of_block = stored(_positives(rows, spark.sparkContext.broadcast((own, None)), positives), "positives")
        found = of_block.select("slot", "rank", "score").toArrow()
        ranges = np.zeros((2, own.num_rows * positives), np.int64)
        ranges[0] = 1  # nothing lies in 1 .. 0
        for slot, rank, score in zip(*(found.column(c).to_pylist() for c in ("slot", "rank", "score"))):
            low, high = -(-least * score // 100), most * score // 100
            ranges[:, slot * positives + rank - 1] = (low, high) if low <= high else (1, 0)
        second = _negatives(rows, spark.sparkContext.broadcast((own, ranges)), positives, negatives)
        names = spark.createDataFrame(pa.table({"anchor": pa.array(np.arange(own.num_rows)), "anchor_id": own.column("vec_id")}), "anchor long, anchor_id long")
        first = of_block.join(F.broadcast(names), F.col("slot") == F.col("anchor"))
        first = first.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("slot") * positives + F.col("rank") - 1).alias("slot"))
        part = second.select("slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(F.broadcast(first), "slot")
        part = part.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        part = stored(part, "negatives") if blocks > 1 else part
        out = part if out is None else out.unionByName(part)
    return out


ORACLE = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, c.vec_id as other_id, a.label = c.label as same, list_inner_product(a.v, c.v)::bigint as score from v a join v c on a.vec_id <> c.vec_id where a.vec_id % 50 = 0),
p as (select anchor_id, other_id as positive_id, score as positive_score from (select *, row_number() over (partition by anchor_id order by score desc, other_id) as r from s where same) where r <= 5),
n as (select p.*, s.other_id as negative_id, s.score as negative_score, row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.other_id) as r
  from p join s on p.anchor_id = s.anchor_id and not s.same and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score)
select anchor_id, positive_id, r::int as rank, negative_id, positive_score, negative_score from n where r <= 3
"""

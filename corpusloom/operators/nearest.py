"""The nearest rows of a task for a block of questions: matrix products choose, exact distances decide."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows that are multiplied at a time, and pairs whose exact distance is taken at a time.
ROWS, PAIRS = 2048, 1 << 17
EPS = 2.0**-53


def matrices(vectors: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length, without those that are null or hold nulls."""
    bad = pc.is_null(vectors.flatten()).to_numpy(zero_copy_only=False)
    widths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    if bad.any():
        owner = pc.list_parent_indices(vectors).to_numpy(zero_copy_only=False)
        widths[np.unique(owner[bad])] = -1
    for width in np.unique(widths[widths > 0]):
        rows = np.flatnonzero(widths == width)
        yield rows, np.asarray(vectors.take(pa.array(rows)).flatten(), np.float64).reshape(len(rows), width)


def rounded(values: np.ndarray, digits: int | None) -> np.ndarray:
    """Half up, as decimals are written; each different value once."""
    if digits is None or not len(values):
        return values
    distinct, where = np.unique(values, return_inverse=True)
    unit = Decimal(1).scaleb(-digits)
    return np.array([float(Decimal(repr(x)).quantize(unit, ROUND_HALF_UP)) if np.isfinite(x) else x for x in distinct.tolist()])[where]


def _sums(products: np.ndarray) -> np.ndarray:
    """Sums over the second axis from the left, which are the same wherever they are taken."""
    out = np.zeros(len(products))
    for column in products.T:
        out += column
    return out


class Nearest:
    """The ``k`` nearest rows so far for questions of one length, by (distance, id)."""

    def __init__(self, questions: np.ndarray, k: int, metric: str, digits: int | None):
        self.questions, self.k, self.metric, self.digits = questions, k, metric, digits
        self.squares = (questions * questions).sum(1)
        self.farthest = np.full(len(questions), np.inf)  # of the k nearest, rounded
        self.slot, self.distance, self.row = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.rows: pa.Table | None = None

    def _exact(self, slots: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        q = self.questions[slots]
        if self.metric == "cosine":
            with np.errstate(divide="ignore", invalid="ignore"):
                return 1 - _sums(vectors * q) / np.sqrt(_sums(vectors * vectors) * _sums(q * q))
        squares = _sums((vectors - q) * (vectors - q))
        return np.sqrt(squares) if self.metric == "l2" else squares

    def _about(self, vectors: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances by one matrix product, and how far each question's may be from the exact ones."""
        products = self.questions[asked] @ vectors.T
        squares = (vectors * vectors).sum(1)
        slack = 8 * (vectors.shape[1] + 4) * EPS
        if self.metric == "cosine":
            with np.errstate(divide="ignore", invalid="ignore"):
                return 1 - products / np.sqrt(self.squares[asked][:, None] * squares[None]), np.full(len(asked), slack)
        about = self.squares[asked][:, None] + squares[None] - 2 * products
        off = slack * (self.squares[asked] + squares.max())
        if self.metric == "l2":
            return np.sqrt(np.maximum(about, 0)), np.sqrt(off)
        return about, off

    def look(self, rows: pa.Table, vectors: np.ndarray, asked: np.ndarray | None = None) -> None:
        """Compare ``rows`` (with a column id) with all questions, or with the questions ``asked``."""
        asked = np.arange(len(self.questions)) if asked is None else asked
        for at in range(0, len(vectors), ROWS):
            some = vectors[at : at + ROWS]
            about, off = self._about(some, asked)
            about = np.where(np.isnan(about), np.inf, about)
            unit = 0 if self.digits is None else 10.0**-self.digits
            limit = self.farthest[asked] + off + unit
            if len(some) > self.k:
                limit = np.minimum(limit, np.partition(about, self.k - 1, axis=1)[:, self.k - 1] + 2 * off + unit)
            i, j = np.nonzero((about <= limit[:, None]) & np.isfinite(about))
            for begin in range(0, len(i), PAIRS):
                self._add(rows, at, asked[i[begin : begin + PAIRS]], some, j[begin : begin + PAIRS])

    def _add(self, rows: pa.Table, at: int, slots: np.ndarray, vectors: np.ndarray, j: np.ndarray) -> None:
        distance = self._exact(slots, vectors[j])
        old = len(self.row)
        n_rows = 0 if self.rows is None else self.rows.num_rows
        some = rows.slice(at, len(vectors))
        table = some if self.rows is None else pa.concat_tables([self.rows, some])
        slot, distance = np.concatenate([self.slot, slots]), np.concatenate([self.distance, distance])
        row = np.concatenate([self.row, j + n_rows])
        shown = rounded(distance, self.digits)
        used, number = np.unique(row, return_inverse=True)
        ids = pc.rank(table.column("id").take(pa.array(used)).combine_chunks(), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        order = np.lexsort((ids[number], shown, slot))
        slot, distance, shown, row = slot[order], distance[order], shown[order], row[order]
        firsts = np.flatnonzero(np.diff(slot, prepend=-1))
        rank = np.arange(len(slot)) - np.repeat(firsts, np.diff(firsts, append=len(slot)))
        best = rank < self.k
        last = rank == self.k - 1
        self.farthest[slot[last]] = shown[last]
        if old and not (row[best] >= n_rows).any():
            return  # nothing of the new rows is among the nearest
        self.slot, self.distance = slot[best], distance[best]
        used, self.row = np.unique(row[best], return_inverse=True)
        self.rows = table.take(pa.array(used)).combine_chunks()

    def found(self) -> tuple[np.ndarray, pa.Table, np.ndarray] | None:
        """Question numbers, rows and distances."""
        return None if self.rows is None else (self.slot, self.rows.take(pa.array(self.row)), self.distance)

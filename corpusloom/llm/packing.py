"""Packing by vector bin packing with the dot-product heuristic.

A sequence has three limits: tokens, segments and loss-bearing tokens. While one is open, the item with
the largest dot product of its (tokens, 1, loss) and the sequence's free room, both as shares of the
limits, goes in. When no whole item fits, an item is cut to fill the room. Each task packs its own rows in
windows, so nothing is shuffled; the last open sequence of a window stays open in the next one, and the
last of a task is split into lengths that are powers of two, which need no padding.

Defined results: null texts and prompts are empty (the end token remains); rows with equal ids are packed
each on its own; no rows give no pieces. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import chunk_ids, parts

MAX_TOKENS, MAX_SEGMENTS = 2048, 256
#: Items, or tokens, that are packed together in a task.
WINDOW_ITEMS, WINDOW_TOKENS = 4096, 8_000_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long, sequence_tokens long, ids binary"


class Packer:
    """Packs windows of items; ``done`` gets the closed sequences as lists of (item, start, length)."""

    def __init__(self, tokens: int, segments: int, loss: int):
        self.limits, self.done = (tokens, segments, loss), []
        self.open: list[tuple[int, int, int]] = []
        self.room = list(self.limits)
        self.number = 0
        self.before: dict[int, int] = {}  # of items that are not used up: tokens before the first loss-bearing one

    def _put(self, item: int, start: int, length: int, loss: int) -> None:
        self.open.append((item, start, length))
        self.room = [self.room[0] - length, self.room[1] - 1, self.room[2] - loss]

    def _close(self) -> None:
        if self.open:
            self.done.append(self.open)
        self.open, self.room = [], list(self.limits)

    def window(self, items: list[tuple[int, int]]) -> None:
        """items: (tokens, tokens without loss at the start); their numbers go on from earlier windows."""
        first, most = self.number, self.limits
        self.number += len(items)
        self.before |= {first + i: p for i, (_, p) in enumerate(items)}
        left = np.array([n for n, _ in items], np.int64)
        free = np.array([min(n, p) for n, p in items], np.int64)  # of what is left, the start without loss
        start = np.zeros(len(items), np.int64)
        alive = int((left > 0).sum())
        while alive:
            tokens, segments, loss = self.room
            if tokens == 0 or segments == 0:
                self._close()
                continue
            part = np.minimum(np.minimum(left, tokens), free + loss)  # what could go in of each
            whole = (part == left) & (left > 0)
            exact = part == tokens
            if segments == 1 and exact.any():
                i = int(np.argmax(np.where(exact, left, 0)))
            elif whole.any():
                weight = left * (tokens / most[0] ** 2) + (left - free) * (loss / most[2] ** 2)
                i = int(np.argmax(np.where(whole, weight, -1.0)))
            else:
                i = int(np.argmax(part))
                if part[i] == 0:
                    self._close()
                    continue
            n = int(part[i])
            self._put(first + i, int(start[i]), n, max(0, n - int(free[i])))
            start[i] += n
            left[i] -= n
            free[i] = max(0, free[i] - n)
            alive -= left[i] == 0
        if self.room[0] == 0:
            self._close()

    def finish(self) -> None:
        """Split the open sequence into powers of two."""
        pieces, self.open = self.open, []
        total = sum(n for *_, n in pieces)
        while total:
            room = 1 << (total.bit_length() - 1)
            total -= room
            sequence = []
            while room:
                item, start, n = pieces.pop(0)
                take = min(n, room)
                sequence.append((item, start, take))
                room -= take
                if take < n:
                    pieces.insert(0, (item, start + take, n - take))
            self.done.append(sequence)


def pack(docs: DataFrame, tokenizer: str, end_id: int, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, prompt: str | None = None, with_ids: bool = True) -> DataFrame:
    """Pieces of all rows of ``docs`` (doc_id, text) in sequences. The tokens of the column ``prompt``, if
    given, come before those of the text and bear no loss; the other tokens and the end token do."""
    loss_limit = max_tokens if max_loss is None else max_loss

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, first, held = chunk_ids(tokenizer), 0, 0
        packer, ids, names = Packer(max_tokens, max_segments, loss_limit), {}, {}
        used: dict[int, int] = {}
        serial = TaskContext.get().partitionId() << 33
        waiting: list[tuple[int, int]] = []

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal serial
            out: list[list] = [[] for _ in range(10)]
            for sequence in packer.done:
                offset, total = 0, sum(n for *_, n in sequence)
                for item, start, n in sequence:
                    own = ids[item][4 * start : 4 * (start + n)]
                    before = packer.before[item]
                    row = (names[item], start, n, zlib.crc32(own), len(ids[item]) // 4, serial, offset, max(0, start + n - max(before, start)), total, own if with_ids else None)
                    for column, v in zip(out, row):
                        column.append(v)
                    offset += n
                    used[item] = used.get(item, 0) + n
                    if used[item] * 4 == len(ids[item]):
                        del ids[item], names[item], used[item], packer.before[item]
                serial += 1
            packer.done = []
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k == 9 else pa.int64()) for k, v in enumerate(out)], [c.split()[0] for c in PIECES.split(", ")])

        for batch in batches:
            for part in parts(batch, 1):
                texts, prompts = ([x or "" for x in part.column(k).to_pylist()] for k in (1, 2))
                heads = words.encode_all(prompts)
                bodies = words.encode_all(texts, end_id)
                for i, doc_id in enumerate(part.column(0).to_pylist()):
                    head, body = (own[bounds[i] : bounds[i + 1]].astype("<u4").tobytes() for own, bounds in (heads, bodies))
                    item = first + len(waiting)
                    ids[item], names[item] = head + body, doc_id
                    waiting.append((len(ids[item]) // 4, len(head) // 4))
                    held += waiting[-1][0]
                    if len(waiting) == WINDOW_ITEMS or held >= WINDOW_TOKENS:
                        packer.window(waiting)
                        first, waiting, held = first + len(waiting), [], 0
                        yield from closed()
        if waiting:
            packer.window(waiting)
        packer.finish()
        yield from closed()

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.col(prompt).cast("string") if prompt else F.lit(None).cast("string")).alias("prompt"))
    pieces = chosen.mapInArrow(run, PIECES)
    return pieces if with_ids else pieces.drop("ids")

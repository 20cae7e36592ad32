"""Token-id output: static range asymmetric numeral system (rANS) over a shared frequency table.

Texts are tokenised once into a scratch table, one frequency table is counted over all tokens, and
documents in ascending id order are cut into blocks that encode and decode on their own. A block
interleaves ``LANES`` coder states, stores all states at every ``CHECKPOINT`` steps, so that decoding can
start at any checkpoint (here: at all of them at once), and carries a crc32 of its words.

A file set is a folder with two Parquet tables, so any store that Spark writes can hold it:
``frequencies`` (token, frequency; the sum is ``2**SCALE_BITS``) and ``blocks``.

Defined results: a null text is an empty one and still has its end token; null ids sort first; rows with
equal ids are all kept, ordered by a hash of their tokens; no rows give empty tables. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, stored
from .tokens import chunk_ids, parts

SCALE_BITS = 20
LANES = 128
#: Steps of all lanes between two checkpoints.
CHECKPOINT = 256
#: A block takes whole documents until it has so many tokens.
BLOCK_TOKENS = 131_072
#: Blocks that one call encodes or decodes together.
TOGETHER = 8
LOWEST = np.uint64(1 << 31)
BLOCKS = "segment int, block int, first_id long, before long, n_tokens long, doc_ids array<long>, lengths array<int>, words binary, states binary, positions binary, crc long"


def tokenize(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian, 2 bytes each if the vocabulary fits, else 4) of every whole text; and a
    last row of each task, without these, with ``counted``: the pairs (token, n) of all its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = chunk_ids(tokenizer)
        total = np.zeros(max(end_id + 1, words.tokenizer.get_vocab_size()), np.int64)
        if end_id > np.iinfo(words.dtype).max:
            raise ValueError("the end id is larger than the vocabulary's ids")
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        for batch in batches:
            for part in parts(batch, 1):
                ids, bounds = words.encode_all([x or "" for x in part.column(1).to_pylist()], end_id)
                total += np.bincount(ids, minlength=len(total))
                raw = pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(bounds * ids.itemsize), pa.py_buffer(ids)]).cast(kinds[2])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(bounds), kinds[1]), raw, pa.nulls(len(part), kinds[3])], ["doc_id", "n_tokens", "ids", "counted"])
        found = np.flatnonzero(total)
        counted = np.stack([found, total[found]], 1).astype("<i8").tobytes()
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds[:3]), pa.array([counted], kinds[3])], ["doc_id", "n_tokens", "ids", "counted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens int, ids binary, counted binary")


def _as_ids(n: int, raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


def count_tokens(tokens: DataFrame) -> DataFrame:
    """token, n over all documents, from the tasks' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                token, n = np.frombuffer(raw, "<i8").reshape(-1, 2).T
                yield pa.RecordBatch.from_arrays([pa.array(token.astype(np.int32)), pa.array(n.copy())], ["token", "n"])

    return tokens.where("counted is not null").select("counted").mapInArrow(run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))


def scaled(counts: list[tuple[int, int]], bits: int = SCALE_BITS) -> list[tuple[int, int]]:
    """(token, frequency) with sum ``2**bits`` and at least 1 each, near the shares of the counts."""
    if not counts:
        return []
    if len(counts) > 1 << bits:
        raise ValueError(f"{len(counts)} distinct tokens need more than {bits} scale bits")
    counts = sorted(counts)
    n = np.array([c for _, c in counts], np.float64)
    f = np.maximum(1, np.floor(n / n.sum() * (1 << bits))).astype(np.int64)
    extra = (1 << bits) - int(f.sum())
    order = np.argsort(-f, kind="stable")
    if extra > 0:
        f[order[0]] += extra
    while extra < 0:  # many rare tokens were raised to 1: take from the most frequent
        take = np.minimum(f[order] - 1, np.maximum(1, -extra // len(order)))
        take = np.where(np.cumsum(take) <= -extra, take, np.maximum(0, -extra - (np.cumsum(take) - take)))
        f[order] -= take
        extra += int(take.sum())
    return [(t, int(x)) for (t, _), x in zip(counts, f)]


class Coder:
    """Encodes and decodes groups of blocks with numpy; all blocks and lanes advance together."""

    def __init__(self, table: list[tuple[int, int]]):
        self.tokens = np.array([t for t, _ in table], np.int64)
        freq = np.array([f for _, f in table], np.int64)
        size = int(self.tokens.max()) + 1 if len(table) else 1
        # one more symbol, of the full range: coding it changes nothing; it fills up short last steps
        self.fill = size
        self.freq, self.low = np.zeros(size + 1, np.uint64), np.zeros(size + 1, np.uint64)
        self.freq[self.tokens], self.freq[size] = freq, 1 << SCALE_BITS
        self.low[self.tokens] = np.cumsum(freq) - freq
        self.slots = np.repeat(self.tokens, freq).astype(np.int32)

    def encode(self, blocks: list[np.ndarray]) -> list[tuple[bytes, bytes, bytes]]:
        """(words, states at the checkpoints, word positions of the checkpoints) of each block."""
        steps = -(-max(len(b) for b in blocks) // LANES)
        steps = max(1, -(-steps // CHECKPOINT)) * CHECKPOINT
        symbols = np.full((len(blocks), steps * LANES), self.fill, np.int32)
        for i, b in enumerate(blocks):
            symbols[i, : len(b)] = b
        symbols = symbols.reshape(len(blocks), steps, LANES).transpose(1, 0, 2)
        words, sent = np.zeros(symbols.shape, np.uint32), np.zeros(symbols.shape, bool)
        states = np.zeros((steps // CHECKPOINT, len(blocks), LANES), np.uint64)
        x = np.full((len(blocks), LANES), LOWEST, np.uint64)
        shift, bits, half = np.uint64(63 - SCALE_BITS), np.uint64(SCALE_BITS), np.uint64(32)
        for t in range(steps - 1, -1, -1):
            f, c = self.freq[symbols[t]], self.low[symbols[t]]
            full = x >= (f << shift)
            words[t], sent[t] = x.astype(np.uint32), full
            x = np.where(full, x >> half, x)
            q = x // f
            x = (q << bits) + (x - q * f) + c
            if t % CHECKPOINT == 0:
                states[t // CHECKPOINT] = x
        out = []
        for i, b in enumerate(blocks):
            used = max(1, -(-len(b) // (LANES * CHECKPOINT)))
            per = sent[:, i, :].reshape(steps // CHECKPOINT, -1).sum(1)
            out.append((words[:, i, :][sent[:, i, :]].astype("<u4").tobytes(), states[:used, i].astype("<u8").tobytes(), (np.cumsum(per) - per)[:used].astype("<u4").tobytes()))
        return out

    def decode(self, blocks: list[tuple[int, bytes, bytes, bytes]]) -> list[np.ndarray]:
        """Token ids of (n_tokens, words, states, positions) blocks, from all checkpoints at once."""
        words, x, at, left, owner, base = [], [], [], [], [], 0
        for i, (n, w, s, p) in enumerate(blocks):
            words.append(np.frombuffer(w, "<u4"))
            x.append(np.frombuffer(s, "<u8").reshape(-1, LANES))
            at.append(np.frombuffer(p, "<u4").astype(np.int64) + base)
            left.append(n - np.arange(len(x[-1])) * LANES * CHECKPOINT)
            owner += [i] * len(x[-1])
            base += len(words[-1])
        words = np.concatenate([*words, np.zeros(1, "<u4")]).astype(np.uint64)
        x, at, left = np.concatenate(x).astype(np.uint64), np.concatenate(at), np.concatenate(left)
        steps = int(min(CHECKPOINT, max(0, -(-int(left.max()) // LANES))))
        out = np.zeros((len(x), steps, LANES), np.int32)
        lane, mask, bits, half = np.arange(LANES), np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS), np.uint64(32)
        for t in range(steps):
            live = lane + t * LANES < left[:, None]
            slot = x & mask
            out[:, t] = symbol = self.slots[slot.astype(np.int64)]
            y = self.freq[symbol] * (x >> bits) + slot - self.low[symbol]
            short = (y < LOWEST) & live
            place = np.minimum(at[:, None] + np.cumsum(short, 1) - 1, len(words) - 1)
            x = np.where(live, np.where(short, (y << half) | words[place], y), x)
            at = at + short.sum(1)
        owner = np.array(owner)
        return [out[owner == i].reshape(-1)[:n] for i, (n, *_) in enumerate(blocks)]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Tokenise every whole text and write it to ``path`` in ascending doc_id order."""
    spark = docs.sparkSession
    tokens = stored(tokenize(docs, tokenizer, end_id), "tokens")
    # at most one row per vocabulary entry
    table = scaled([(r.token, r.n) for r in count_tokens(tokens).collect()])
    spark.createDataFrame(table, "token int, frequency long").coalesce(1).write.parquet(f"{path}/frequencies")
    shared = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, segment = Coder(shared.value), TaskContext.get().partitionId()
        ready, docs_in, ids_in, size, before, number = [], [], [], 0, 0, 0

        def flush(group: list) -> pa.RecordBatch:
            nonlocal before, number
            rows = []
            for (doc_ids, ids), (words, states, positions) in zip(group, coder.encode([np.concatenate(g[1]) for g in group])):
                n = sum(map(len, ids))
                rows.append({"segment": segment, "block": number, "first_id": doc_ids[0], "before": before, "n_tokens": n, "doc_ids": doc_ids, "lengths": [len(x) for x in ids], "words": words, "states": states, "positions": positions, "crc": zlib.crc32(positions, zlib.crc32(states, zlib.crc32(words)))})
                before, number = before + n, number + 1
            return pa.RecordBatch.from_pylist(rows, pa.schema([("segment", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("words", pa.binary()), ("states", pa.binary()), ("positions", pa.binary()), ("crc", pa.int64())]))

        for batch in batches:
            for doc_id, n, raw in zip(*(batch.column(k).to_pylist() for k in range(3))):
                docs_in.append(doc_id)
                ids_in.append(_as_ids(n, raw))
                size += n
                if size >= BLOCK_TOKENS:
                    ready.append((docs_in, ids_in))
                    alone = size > 4 * BLOCK_TOKENS
                    docs_in, ids_in, size = [], [], 0
                    if alone and len(ready) > 1:  # a very long document doesn't stretch its neighbours' arrays
                        yield flush(ready[:-1])
                        ready = ready[-1:]
                    if alone or len(ready) == TOGETHER:
                        yield flush(ready)
                        ready = []
        if docs_in:
            ready.append((docs_in, ids_in))
        if ready:
            yield flush(ready)

    # the hash splits the rows of one id, or without one, into several ranges
    rows = tokens.where("counted is null").select("doc_id", "n_tokens", "ids", F.xxhash64("ids").alias("order"))
    ordered = rows.repartitionByRange(shuffle_partitions(spark), "doc_id", "order").sortWithinPartitions("doc_id", "order", "ids").drop("order")
    ordered.mapInArrow(run, BLOCKS).write.parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids, little-endian uint32) from a written folder."""
    shared = spark.sparkContext.broadcast([(r.token, r.frequency) for r in spark.read.parquet(f"{path}/frequencies").collect()])
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                rows = batch.slice(at, TOGETHER).to_pylist()
                for r in rows:
                    if zlib.crc32(r["positions"], zlib.crc32(r["states"], zlib.crc32(r["words"]))) != r["crc"]:
                        raise ValueError(f"segment {r['segment']}, block {r['block']}: checksum differs")
                out: list[list] = [[], [], [], [], [], []]
                for r, ids in zip(rows, coder.decode([(r["n_tokens"], r["words"], r["states"], r["positions"]) for r in rows])):
                    raw, p = ids.astype("<u4").tobytes(), 0
                    for doc_id, n in zip(r["doc_ids"], r["lengths"]):
                        own = raw[4 * p : 4 * (p + n)]
                        for column, v in zip(out, (r["segment"], doc_id, r["before"] + p, n, zlib.crc32(own), own if with_ids else None)):
                            column.append(v)
                        p += n
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["segment", "doc_id", "before", "n_tokens", "ids_crc32", "ids"])

    # one row per written partition
    bases = blocks.groupBy("segment").agg(F.sum("n_tokens").alias("n")).select("segment", (F.sum("n").over(Window.orderBy("segment")) - F.col("n")).alias("base"))
    decoded = blocks.select("segment", "block", "before", "n_tokens", "doc_ids", "lengths", "words", "states", "positions", "crc").mapInArrow(run, "segment int, doc_id long, before long, n_tokens long, ids_crc32 long, ids binary")
    columns = ["doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"]
    return decoded.join(bases, "segment").select(*columns, *["ids"] * with_ids)

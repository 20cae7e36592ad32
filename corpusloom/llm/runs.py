"""Periodic runs of words: maximal stretches in which words a period apart are identical.

Texts are mapped to numbers of their words and stand one behind the other, with a number of its own between two, so
that no run crosses. Periods up to ``DIRECT`` are found by comparing all words with those a lag behind. For longer
ones there are scales: a scale [low, high), with high at most 1.5 low, looks at all stretches of high - 1 words by
their hashes, and keeps the minima of windows of 2 low - high + 2 such stretches. A run of at least three periods q in
the scale holds a window and the same window q words later, so the first one's minimum repeats q words later. Stretches are
at least as long as the period, so equal ones in a run are q apart or a multiple: neighbouring equal minima a
distance in the scale apart seed every run. Seeds are extended to both sides by comparing words, so hashes decide
nothing; a stretch that several periods fit has the smallest.

Defined results: words are what lies between ASCII white space; null texts, and texts without words, have no
words, no runs and the hashes of the empty text; rows stay as they are, with null or repeated ids. No rows give no rows.
Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

#: A run has at least so many words and periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Longest period that is found by comparing all words a lag apart.
DIRECT = 8
#: Bytes of text that are scanned together.
BATCH_BYTES = 4_000_000
FOUND = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers (xor, shift, multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _scales(longest: int) -> Iterator[tuple[int, int]]:
    """The scales [low, high) that cover the periods over DIRECT up to ``longest``."""
    low = DIRECT + 1
    while low <= longest:
        high = low + max(1, low // 2)
        yield low, high
        low = high


def _slid(values: np.ndarray, width: int, better: np.ufunc) -> np.ndarray:
    """The least or greatest of each ``width`` values in a row, by windows of doubled width."""
    have = 1
    while 2 * have <= width:
        values = better(values[:-have], values[have:])
        have *= 2
    return better(values[: len(values) - (width - have)], values[width - have :]) if width > have else values


class Hashes:
    """Hashes of all stretches of a length, from those of the power of two before it. Lengths are asked for in order."""

    def __init__(self, words: np.ndarray):
        self.have, self.values = 1, _mixed(words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))

    def of(self, length: int) -> np.ndarray:
        while 2 * self.have <= length:
            self.values = _mixed(self.values[: -self.have] * np.uint64(3) + _mixed(self.values[self.have :]))
            self.have *= 2
        rest = length - self.have
        return _mixed(self.values[: len(self.values) - rest] * np.uint64(5) + _mixed(self.values[rest:])) if rest else self.values


class _Numbers(dict):
    """Words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _seeds(hashes: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal neighbouring minima, and their distances, where these lie in the scale."""
    window = 2 * low - high + 2
    least = _slid(hashes, window, np.minimum)
    # a stretch is a minimum if the greatest of the minima of the windows that hold it is its own hash
    edge = np.zeros(window - 1, np.uint64)
    minima = np.flatnonzero(_slid(np.concatenate([edge, least, edge]), window, np.maximum) == hashes)
    order = minima[np.argsort(hashes[minima], kind="stable")]
    near = order[1:] - order[:-1]
    good = (hashes[order[1:]] == hashes[order[:-1]]) & (near >= low) & (near < high)
    return order[:-1][good], near[good]


def _extended(words: np.ndarray, place: int, lag: int, step: int) -> int:
    """How many words from ``place`` on (``step`` 1) or before it (-1) equal those a lag behind them."""
    n, block = 0, 64
    while True:
        if step > 0:
            room = min(block, len(words) - lag - place - n)
            same = words[place + n : place + n + room] == words[place + n + lag : place + n + lag + room]
        else:
            room = min(block, place - n)
            same = (words[place - n - room : place - n] == words[place - n - room + lag : place - n + lag])[::-1]
        if room <= 0:
            return n
        first = int(same.argmin())
        if not same[first]:
            return n + first
        n, block = n + room, 2 * block


def find(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All runs of texts whose words (numbers from 0) stand one behind the other: rows (text, start, length, period),
    by text, start and period."""
    longest_first = np.argsort(-sizes, kind="stable")
    begins = np.cumsum(sizes) - sizes
    lengths = sizes[longest_first]
    ends = np.cumsum(lengths + 1)
    starts = ends - lengths - 1
    line = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    line[np.repeat(starts, lengths) + within] = words[np.repeat(begins[longest_first], lengths) + within]
    line[ends - 1] = np.arange(len(ends)) + (int(words.max()) + 1 if len(words) else 0)  # equal to nothing
    found = []
    for lag in range(1, DIRECT + 1):
        same = np.concatenate([[False], line[:-lag] == line[lag:], [False]])
        turns = np.flatnonzero(same[1:] != same[:-1])
        begin, end = turns[::2], turns[1::2]
        long = end - begin + lag >= max(LEAST_WORDS, LEAST_PERIODS * lag)
        found.append(np.stack([begin[long], end[long] + lag - begin[long], np.full(long.sum(), lag)], axis=1))
    hashes = Hashes(line)
    for low, high in _scales(int(lengths[0]) // LEAST_PERIODS if len(lengths) else 0):
        # texts that are too short for the scale stand at the end
        n = int(ends[np.searchsorted(-lengths, -LEAST_PERIODS * low, "right") - 1])
        whole = hashes.of(high - 1)[: max(0, n - high + 2)]
        if len(whole) < 2 * low - high + 2:
            continue
        places, lags = _seeds(whole, low, high)
        done, lag_done = -1, 0
        for i in np.lexsort((places, lags)).tolist():
            place, lag = int(places[i]), int(lags[i])
            if lag == lag_done and place < done:
                continue  # in the stretch that the seed before it had
            after, before = _extended(line, place, lag, 1), _extended(line, place, lag, -1)
            done, lag_done = place + after, lag
            if after + before + lag >= max(LEAST_WORDS, LEAST_PERIODS * lag):
                found.append(np.array([[place - before, after + before + lag, lag]]))
    runs = np.concatenate(found)
    # of equal stretches the smallest period
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[first]
    text = np.searchsorted(ends, runs[:, 0], "right")
    runs = np.column_stack([longest_first[text], runs[:, 0] - starts[text], runs[:, 1:]])
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def summary(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """The values of FOUND for one text."""
    best = (None, None, None, None)
    if runs:
        start, length, period = runs[0]
        for s, n, p in runs[1:]:
            # exact; ties keep the smaller start, then period
            if n * period > length * p:
                start, length, period = s, n, p
        best = (start, length, period, 1000 * length // period)
        dropped = np.zeros(len(words) + 1, np.int64)
        for s, n, p in runs:
            dropped[s + p] += 1
            dropped[s + n] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(dropped[:-1]) == 0)]
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    return (len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest())


def scan_texts(texts: list[bytes]) -> list[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """The words of each text and its runs (start, length, period)."""
    split = [t.split() for t in texts]  # of bytes: at ASCII white space
    sizes = np.array([len(w) for w in split], np.int64)
    words = np.fromiter(map(_Numbers().__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
    found = find(words, sizes)
    at = np.searchsorted(found[:, 0], np.arange(len(texts) + 1))
    return [(w, [tuple(r) for r in found[at[i] : at[i + 1], 1:].tolist()]) for i, w in enumerate(split)]


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id and the columns of FOUND for each row of ``docs`` (doc_id, text): the number of runs; of the run of the
    greatest length / period (ties: smallest start, then period) its start, length, period and 1000 * length / period
    (null without a run); hashes of all runs as lines ``start,length,period``, and of the words that are in no run after its
    first period, joined by a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in FOUND.split(", ")]
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        for batch in batches:
            for part in slices(batch, 1, BATCH_BYTES):
                rows = [summary(*x) for x in scan_texts(part.column(1).to_pylist())]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", *names])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {FOUND}")


def with_periodic_ends(docs: DataFrame) -> DataFrame:
    """doc_id and text of ``docs``; every tenth text (by a hash h of its id, g = h div 10) repeats, from its word
    g % n on, the next 1 + (n - g % n) div (3 + g % 8) words up to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.floor(h / 10).cast("long").alias("g"), F.when(h % 10 == 0, words).alias("w"))
    n = F.size("w").cast("long")
    rows = rows.withColumn("a", F.when(F.size("w") > 0, F.col("g") % n))
    rows = rows.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    head: Column = F.slice("w", F.lit(1), F.col("a").cast("int"))
    tail = F.transform(F.sequence(F.lit(0).cast("long"), n - F.col("a") - 1), lambda i: F.get("w", (F.col("a") + i % F.col("p")).cast("int")))
    return rows.select("doc_id", F.when(F.col("a").isNull(), F.col("text")).otherwise(F.array_join(F.concat(head, tail), " ")).alias("text"))

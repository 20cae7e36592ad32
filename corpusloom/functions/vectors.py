"""Distances as Columns, and embedding providers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def l2_sq(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, metric: str = "l2_sq") -> Column:
    """``l2_sq`` (default), ``l2`` or ``cosine`` distance."""
    if metric == "l2_sq":
        return l2_sq(a, b)
    if metric == "l2":
        return F.sqrt(l2_sq(a, b))
    if metric == "cosine":
        return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
    raise ValueError(f"unknown metric {metric!r}")


class Embedder(Protocol):
    """Anything that can be pickled and turns texts into vectors."""

    def embed(self, texts: list[str]) -> np.ndarray: ...


REMEMBERED, LONGEST = 1 << 15, 55
#: Texts whose new words are hashed together.
TOGETHER = 256
# of md5: its start, shifts and sines
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
_SHIFTS = np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], np.uint32)
_SINES = (np.abs(np.sin(np.arange(1, 65))) * 2**32).astype(np.uint32)


def md5_numbers(coded: list[bytes]) -> np.ndarray:
    """The first 4 bytes of the md5 of each of ``coded``, none longer than LONGEST, as a number: all at once, which takes a
    third of the time of one call for each."""
    lengths = np.fromiter(map(len, coded), np.int64, len(coded))
    block = np.array(coded, "S64").view(np.uint8).reshape(-1, 64)
    block[np.arange(len(coded)), lengths] = 128
    m = np.ascontiguousarray(block.view("<u4").T, np.uint32)
    m[14] = 8 * lengths
    a, b, c, d = (np.full(len(coded), x) for x in _START)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f, s = f + a + _SINES[i] + m[g], _SHIFTS[i // 16, i % 4]
        a, d, c, b = d, c, b, b + (f << s | f >> np.uint32(32) - s)
    return (a + _START[0]).byteswap()


class _Numbers(dict):
    """md5 numbers of words of up to LONGEST bytes, never more than REMEMBERED; those of others are made when asked for."""

    def learn(self, words: set[str]) -> None:
        new = words.difference(self)
        if len(self) + len(new) > REMEMBERED:
            # what is in use stays
            used = {w: self[w] for w in words.difference(new)}
            self.clear()
            self.update(used)
            new = list(new)[: REMEMBERED - len(used)]
        short = {w: c for w in new if len(c := w.encode()) <= LONGEST}
        if short:
            self.update(zip(short, md5_numbers(list(short.values())).tolist()))

    def __missing__(self, word: str) -> int:
        return int.from_bytes(hashlib.md5(word.encode()).digest()[:4])


#: For all batches of a worker.
_numbers = _Numbers()


def words(text: str) -> list[str]:
    """What lies between white space and punctuation in the lower-cased text."""
    text = text.lower()
    for mark in ".,;:!?|":
        text = text.replace(mark, " ")
    return text.split()


class HashedEmbedder:
    """Offline default: counts of words in md5 buckets, scaled to length 1."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for at in range(0, len(texts), TOGETHER):
            found = [words(text or "") for text in texts[at : at + TOGETHER]]
            _numbers.learn(set().union(*found))
            for i, some in enumerate(found, at):
                if some:
                    numbers = np.fromiter(map(_numbers.__getitem__, some), np.int64, len(some))
                    out[i] = np.bincount(numbers % self.dim, minlength=self.dim)
        length = np.sqrt((out * out).sum(1, keepdims=True))
        return out / np.where(length == 0, 1, length)


def embed(text: Column, embedder: Embedder) -> Column:
    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(embedder.embed(texts.tolist())))

    return run(text)

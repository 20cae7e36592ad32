"""Long inverted lists in blocks by size, and texts with many long comparisons."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import setjoin

from .test_llm_operators import brute_components, frame


def texts(rng, n):
    """Stretches of one long text, of many lengths, some with a word changed: every shingle is in many of them."""
    base = [f"w{i}" for i in range(110)]
    rows = []
    for i in range(n):
        at, size = rng.randrange(90), int(8 * 1.33 ** rng.uniform(0, 9))
        words = base[at : at + size]
        if rng.random() < 0.3:
            words[rng.randrange(len(words))] = f"e{rng.random()}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("block", [4, 7])
def test_blocks_by_size(spark, monkeypatch, block):
    monkeypatch.setattr(setjoin, "LIST_BLOCK", block)
    monkeypatch.setattr(setjoin, "GRID", 8)
    seen = []
    dealt = setjoin.dealt

    def counting(lists, entries, sizes):
        out = dealt(lists, entries, sizes)
        whole = entries.join(sizes, "token").agg(F.sum(F.when(F.col("blocks") > 2, F.col("blocks")).otherwise(1))).first()[0]
        seen.append((out.count(), whole, sizes.where("blocks > 2").count()))
        return out

    monkeypatch.setattr(setjoin, "dealt", counting)
    rows = texts(random.Random(block), 260)
    got = sorted(map(tuple, setjoin.join(frame(spark, rows)).collect()), key=str)
    assert got == brute_components(rows)
    sent, whole, long = seen[0]
    assert long > 0 and sent < 0.8 * whole  # a copy of each entry for each block without the sizes


def test_all_of_one_size(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "LIST_BLOCK", 4)
    rows = [(i, "one two three four five " + " ".join(f"x{i}y{k}" for k in range(3 + i % 2))) for i in range(60)] + [(90 + i, "a b c d e f") for i in range(9)]
    assert sorted(map(tuple, setjoin.join(frame(spark, rows)).collect()), key=str) == brute_components(rows)


def test_many_comparisons_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "SET_BYTES", 20_000)
    monkeypatch.setattr(setjoin, "TASKS", 3)
    rng = random.Random(1)
    base = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join([*base[: 2000 + 20 * i], f"end{i}"])) for i in range(40)]
    rows += [(50 + i, " ".join(rng.choices(base, k=50))) for i in range(5)]
    assert sorted(map(tuple, setjoin.join(frame(spark, rows)).collect()), key=str) == brute_components(rows)

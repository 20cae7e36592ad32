"""Exact top-k for vectors of any length, against whole-number brute force."""

import math

import numpy as np
import pytest

from corpusloom.llm import pivots

ROWS = "vec_id long, embedding array<double>"


def brute(rows, asked, k):
    v = {i: [math.floor(64 * x) for x in e] for i, e in rows}
    out = []
    for q in asked:
        scored = sorted((-sum(a * b for a, b in zip(v[q], x)), i) for i, x in v.items() if i != q and len(x) == len(v[q]))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("length", [1.0, 30.0, 1e3, 1e5, 3e6])
def test_lengths(spark, length):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(8, 24))
    rows = [(i, (centre[i % 8] * length + rng.normal(size=24) * length * 10.0 ** -rng.integers(0, 9)).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    got = pivots.top_k(df, df.where("vec_id % 20 = 0"), 7).collect()
    assert sorted(map(tuple, got)) == brute(rows, range(0, 400, 20), 7)


def test_wide_vectors_with_copies_that_nearly_tie(spark):
    rng = np.random.default_rng(6)
    query = rng.integers(-700, 700, 768)
    low = query.copy()
    low[0] -= 7
    b, a = low, low.copy()
    a[np.flatnonzero(query == (1 if (query == 1).any() else query[1]))[0]] += 1  # a little better, or by more
    rows = [(0, (query / 64).tolist())] + [(1 + i, (b / 64).tolist()) for i in range(199)] + [(200 + i, (a / 64).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, ROWS).repartition(4)
    assert sorted(map(tuple, pivots.top_k(df, df.where("vec_id = 0"), 20).collect())) == brute(rows, [0], 20)


def test_scores_near_and_beyond_a_long(spark):
    # components of 2^29: products near 2^60, whose sums need 64-bit integers
    rows = [(i, [float(2**23 + i % 3), float(2**23), float(i % 5) / 64]) for i in range(60)]
    df = spark.createDataFrame(rows, ROWS)
    assert sorted(map(tuple, pivots.top_k(df, df.where("vec_id % 20 = 0"), 5).collect())) == brute(rows, [0, 20, 40], 5)
    huge = spark.createDataFrame([(0, [2.0**40] * 4), (1, [2.0**40] * 4)], ROWS)
    with pytest.raises(Exception, match="OverflowError|too large"):
        pivots.top_k(huge, huge.where("vec_id = 0"), 5).collect()

"""The pipeline's mixing and packing stages against plain Python."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

public_tokenizers = pytest.importorskip("public_tokenizers")
STAGE = dict(corpus_pipeline.STAGES)


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def filled(sizes):
    """Targets: 150 % of all words by weights 5, 2, 1, at most twice a source, the excess shared again."""
    names = sorted(sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 2 * sizes[s]}
        if not full:
            return target | {s: weight[s] * level for s in open_}
        target |= {s: 2 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return target


def rates(sizes, target):
    """min(2, exp(dual * size)), whose words meet the target."""
    if target >= 2 * sum(sizes) * (1 - 1e-12):
        return {n: 2.0 for n in sizes}
    low, high = -60.0, 60.0
    mean = sum(sizes) / len(sizes)
    of = lambda dual, n: min(2.0, math.exp(min(1.0, dual * n / mean)))
    for _ in range(200):
        dual = (low + high) / 2
        if sum(n * of(dual, n) for n in sizes) < target:
            low = dual
        else:
            high = dual
    return {n: of(low, n) for n in sizes}


def test_mixing_by_plain_rates(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.collect()
    copies = Counter(r.doc_id for r in STAGE["mixing"](spark, docs, "/root/testdata/sf0.01").collect())
    by_source = defaultdict(list)
    for r in rows:
        by_source[r.source].append((r.doc_id, size(r.text)))
    want = filled({s: sum(n for _, n in d) for s, d in by_source.items()})
    assert max(copies.values()) <= 2
    for s, d in by_source.items():
        taken = sum(n * copies[i] for i, n in d)
        assert abs(taken - want[s]) <= 64, s
        rate = rates([n for _, n in d if n], want[s])
        # systematic rounding gives one of the two whole numbers beside the rate; single copies take up the rest
        odd = [i for i, n in d if n and not math.floor(rate[n] - 1e-6) <= copies[i] <= math.ceil(rate[n] + 1e-6)]
        assert len(odd) <= 20, s
        assert abs(sum(copies[i] for i, n in d if n) - sum(rate[n] for _, n in d if n)) <= 0.02 * len(d) + 5


def test_packing_by_the_library(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id % 3 > 0")
    docs = docs.unionByName(docs.where("doc_id % 7 = 0"))  # some rows are copies
    rows = Counter((r.doc_id, r.text) for r in docs.collect())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: (tokenizer.encode(t or "", add_special_tokens=False).ids + [1], n) for (i, t), n in rows.items()}
    pieces = STAGE["packing"](spark, docs, small).collect()
    ids = defaultdict(list)
    sequences = defaultdict(list)
    for p in pieces:
        own = np.frombuffer(bytes(p.ids), "<u4").tolist()
        assert p.length == len(own) > 0
        ids[p.doc_id].append((p.start, own))
        sequences[p.sequence_id].append((p.offset, p.length))
    assert set(ids) == set(want)
    for i, (whole, n) in want.items():
        assert sum(len(x) for _, x in ids[i]) == n * len(whole)
        assert all(whole[start : start + len(x)] == x for start, x in ids[i])
        covered = Counter(k for start, x in ids[i] for k in range(start, start + len(x)))
        assert set(covered.values()) == {n}
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048

"""Token counts against the library, periodic runs and hard negatives by brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm import negatives, queries, runs, transducer

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, n_tokens string, w int, g int, n_bytes string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in rows], DOCS)


# 11: token counts


def library(texts):
    return [len(x.ids) for x in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def odd_texts(n, seed):
    rng = random.Random(seed)
    letters = [*"abcrsvlemdt''''!?  \n\t0123éÀßİŒσΣ漢字日本かな٣४½²™€😀👍", "‍", "́", "̇", "\x85", "\xa0", " ", "\x1c", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "'re", "'ve", "'ll", "'s", "don't", "<|"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("chunk", [1, 2, 7, 64, None])
def test_counts_equal_the_library_wherever_chunks_are_cut(chunk):
    texts = odd_texts(400, 3)
    assert transducer.transducer(PATH).counts(texts, chunk).tolist() == library(texts)


def test_one_piece_over_many_chunks():
    rng = random.Random(4)
    texts = ["!" * 3001, "a" * 2000, "".join(rng.choice("abcdef") for _ in range(3000)), "'" * 999, "9" * 500, ""]
    for chunk in (3, 32, 100):
        assert transducer.transducer(PATH).counts(texts, chunk).tolist() == library(texts)


def test_characters_of_every_block():
    texts = [f"{chr(c) * 2}a{chr(c)}1{chr(c)}!{chr(c)} {chr(c).upper()}" for c in range(0, 0x20000, 37) if not 0xD800 <= c < 0xE000]
    assert transducer.transducer(PATH).counts(texts).tolist() == library(texts)


def test_tables_are_emptied_between_batches(monkeypatch):
    monkeypatch.setattr(transducer, "TABLE_CELLS", 1)
    t, texts = transducer.Transducer(PATH), odd_texts(30, 5)
    for _ in range(2):
        assert t.counts(texts).tolist() == library(texts)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        transducer.Transducer(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_counts(spark):
    rows = [(1, "Don't stop"), (2, None), (3, ""), (None, "the end"), (1, "Don't stop"), (5, "é" * 5000), (6, "word " * 2048), (7, "word " * 2049)]
    got = transducer.count_tokens(frame(spark, rows), PATH)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    n = library([t for _, t in rows])
    want = [(i, len((t or "").encode()), k, k > 2048) for (i, t), k in zip(rows, n)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert transducer.count_tokens(frame(spark, []), PATH).collect() == []


def test_token_counts_of_the_table(spark, small):
    got = {r.doc_id: r for r in queries.op11_token_counts(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d, n in zip(docs, library([d.text for d in docs])):
        assert (got[d.doc_id].n_tokens, got[d.doc_id].n_bytes, got[d.doc_id].over_limit) == (n, len(d.text.encode()), n > 2048)


# 12: periodic runs


def brute_runs(w):
    out = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def brute_summary(w, found):
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if found else None
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    values = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(found), *values, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def periodic_text(rng):
    k = rng.choice([1, 2, 3, 30, 1000])
    words = [str(rng.randrange(k)) for _ in range(rng.randint(0, 50))]
    for _ in range(rng.randint(0, 4)):
        p = rng.choice([1, 2, 3, 5, 8, 9, 10, 13, 14, 20, 21, 33, 50, 80])
        base = [str(rng.randrange(k)) for _ in range(p)]
        words += [base[i % p] for i in range(rng.randint(2 * p, 5 * p))]
        words += [str(rng.randrange(k)) for _ in range(rng.randint(0, 10))]
        if words and rng.random() < 0.3:
            words[rng.randrange(len(words))] = "z"
    return " ".join(words)


def test_runs_equal_brute_force():
    rng = random.Random(6)
    found = 0
    for _ in range(60):
        texts = [periodic_text(rng).encode() for _ in range(rng.randint(1, 5))]
        for text, (words, got) in zip(texts, runs.scan_texts(texts)):
            assert words == text.split() and got == brute_runs(words)
            found += len(got)
    assert found > 100


def test_words_of_nested_repeats():
    a, b = ["x"], ["x", "y"]
    while len(b) < 400:
        a, b = b, b + a
    text = " ".join(b).encode()
    assert runs.scan_texts([text])[0][1] == brute_runs(text.split())
    thue = [bin(i).count("1") % 2 for i in range(512)]
    text = " ".join(map(str, thue * 3)).encode()
    assert runs.scan_texts([text])[0][1] == brute_runs(text.split())


def planted(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else None
    if h is None or h % 10 or not w:
        return w
    n, g = len(w), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_periodic_runs(spark):
    rng = random.Random(7)
    rows = [(i, periodic_text(rng)) for i in range(150)] + [(None, "a " * 30), (4, None), (4, ""), (4, " \t"), (2, "a\x0bb\x1cc " * 9), (2, " a " * 40), (3, "word " * 20_000), (30, "word")]
    got = runs.periodic_runs(runs.with_periodic_ends(frame(spark, rows)))
    want = []
    for i, t in rows:
        w = planted(i, t)
        found = [(0, len(w), 1)] if len(set(w)) == 1 and len(w) >= 24 else brute_runs(w)
        want.append((i, *brute_summary(w, found)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert runs.periodic_runs(frame(spark, [])).collect() == []
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i)


def test_periodic_runs_of_the_table(spark, small):
    got = {r.doc_id: tuple(r) for r in queries.op12_periodic_runs(spark, small).collect()}
    some = 0
    for d in spark.read.parquet(f"{small}/documents.parquet").where(F.length("text") < 4000).collect():
        w = planted(d.doc_id, d.text)
        found = brute_runs(w)
        some += bool(found)
        assert got[d.doc_id] == (d.doc_id, *brute_summary(w, found))
    assert some > 5


# 13: hard negatives


@pytest.mark.parametrize("most", [1, 3, 300, 10**4, 10**6, 10**8, 10**9])
def test_packed_products_are_exact(most):
    rng = np.random.default_rng(most)
    for _ in range(10):
        a, c = (rng.integers(-most, most + 1, (rng.integers(0, n), 7)) for n in (6, 12))
        assert (negatives.products(a, c) == a @ c.T).all()
    one_sided = rng.integers(0, most + 1, (5, 7))
    assert (negatives.products(-one_sided, one_sided) == -one_sided @ one_sided.T).all()


def test_scores_that_are_no_long_are_refused():
    big = np.full((1, 3), 2**62)
    with pytest.raises(OverflowError):
        negatives.products(big, big)


def brute_negatives(rows, anchors):
    good = [(i, lab, [int(np.floor(256.0 * x)) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out, seen = [], {}
    for a in sorted(r for r in good if r[0] in anchors):
        seen.setdefault(a[0], a)
    for i, lab, v in seen.values():
        scored = sorted((-sum(x * y for x, y in zip(v, c[2])), c[0], c[1]) for c in good if c[0] != i and len(c[2]) == len(v))
        for ps, pid in [(-s, c) for s, c, x in scored if x == lab][:5]:
            hits = [(-s, c) for s, c, x in scored if x != lab and 50 * ps <= -100 * s <= 95 * ps][:3]
            out += [(i, pid, r, nid, ps, ns) for r, (ns, nid) in enumerate(hits, 1)]
    return sorted(out)


VECTORS = "vec_id long, label int, embedding array<float>, slot string, v int, score string, rank int"


@pytest.mark.parametrize("scale", [0.01, 1.0, 3000.0])
def test_hard_negatives(spark, scale):
    rng = np.random.default_rng(int(scale * 100))
    rows = [(i, int(rng.integers(0, 3)), [float(np.float32(x * scale)) for x in rng.normal(0.3, 1, 6)]) for i in range(120)]
    rows += [(200 + i, 0, rows[1][2]) for i in range(4)] + [(5, 1, rows[7][2]), (5, 1, rows[7][2]), (10, 2, rows[9][2])]
    rows += [(300, None, rows[0][2]), (301, 1, None), (302, 1, [1.0, None]), (303, 1, [float("nan")] * 6), (None, 1, rows[0][2]), (305, 1, [1.0, 2.0]), (310, 1, [1.0, 2.5]), (315, 2, [1.0, 2.0]), (320, 1, []), (325, 0, [0.0] * 6)]
    vectors = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], VECTORS).repartition(3)
    for block in (4096, 7):
        got = negatives.hard_negatives(vectors, vectors.where("vec_id % 5 = 0"), block=block)
        want = brute_negatives(rows, {r[0] for r in rows if r[0] is not None and r[0] % 5 == 0})
        assert sorted(map(tuple, got.collect())) == want
    assert len(want) > 30
    assert negatives.hard_negatives(vectors.where("false"), vectors).collect() == []
    assert negatives.hard_negatives(vectors, vectors.where("false")).collect() == []

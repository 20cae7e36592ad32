import functools
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import packing, rans, tokens
from corpusloom.llm.common import scratch
from corpusloom.llm.tokens import ChunkIds

BYTES, WORDS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
TEXTS = ["", None, " ", "a  b", " lead", "trail ", "it's we'll 12 3a\n\nnext", "ΣΑΣ İx ſ é", "日本 語。", "<|endoftext|> x", "a <|startoftext|>\n<|EndOfText|> b", " \n\n a\n\n\tb. \nc%%%\n", "plain words, " * 4000, "plain words, " * 4000, "x" * 5000]


@functools.lru_cache
def tokenizer(path):
    return Tokenizer.from_file(path)


def whole(path, text):
    t = tokenizer(path)
    return t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_chunks_give_the_librarys_ids(path):
    words = ChunkIds(path)

    @settings(max_examples=200, deadline=None)
    @given(st.text(alphabet=st.sampled_from("ab Z9.,'s\n\té ſΣ　İ‌\x1ć"), max_size=30))
    def same(text):
        assert words.encode(text) == words.whole(text)

    same()


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, block int, words string")


def test_token_files_round_trip(spark):
    rows = [(3 * i if i % 4 else None, x, 1, "w") for i, x in enumerate(TEXTS)] + [(6, "again", 0, "w")]
    path = scratch(spark, "t")
    rans.write_tokens(frame(spark, rows), path, BYTES, 2)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in rans.read_tokens(spark, path).collect()))
    assert len(got) == len(rows)
    want = {}
    for doc_id, text, *_ in rows:
        want.setdefault(doc_id, []).append(np.array([*whole(BYTES, text), 2], "<u4").tobytes())
    ids = [x[1] for x in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    start = 0
    for at, doc_id, n, crc, raw in got:
        assert at == start and n * 4 == len(raw) and crc == zlib.crc32(raw)
        want[doc_id].remove(raw)
        start += n


def test_no_documents(spark):
    path = scratch(spark, "t")
    rans.write_tokens(frame(spark, []), path, BYTES, 2)
    assert rans.read_tokens(spark, path).count() == 0
    assert packing.pack(frame(spark, []), WORDS, 1).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), min_size=1, max_size=900), min_size=1, max_size=5))
def test_coder(blocks):
    blocks = [np.array(b) for b in blocks]
    blocks.append(np.random.default_rng(1).integers(0, 40, 40_000))
    coder = rans.Coder(rans.scaled(list(enumerate([1 + 3**i % 1000 for i in range(41)]))))
    coded = coder.encode(blocks)
    for b, back in zip(blocks, coder.decode([(len(b), *c) for b, c in zip(blocks, coded)])):
        assert (b == back).all()


def test_scaled_sums_to_the_range():
    for n in ([1], [1] * 1000, [10**9, *[1] * 60_000]):
        assert sum(f for _, f in rans.scaled(list(enumerate(n)))) == 1 << rans.SCALE_BITS


def pieces(spark, rows, **more):
    return [r.asDict() for r in packing.pack(frame(spark, rows), WORDS, 1, **more).collect()]


def check_pieces(found, want, max_tokens, max_segments, max_loss):
    sequences, docs = {}, {}
    for p in found:
        sequences.setdefault(p["sequence_id"], []).append(p)
        docs.setdefault(p["doc_id"], []).append(p)
        assert p["ids_crc32"] == zlib.crc32(bytes(p["ids"])) and 4 * p["length"] == len(p["ids"])
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= max_tokens and len(own) <= max_segments and sum(p["loss_tokens"] for p in own) <= max_loss
        assert {p["sequence_tokens"] for p in own} == {at}
    for doc_id, ids in want.items():
        own = sorted(docs.pop(doc_id), key=lambda p: p["start"])
        assert b"".join(bytes(p["ids"]) for p in own) == ids and {p["doc_tokens"] for p in own} == {len(ids) // 4}
    assert not docs
    return sequences


def test_packing_keeps_each_token_once(spark):
    rows = [(i, x, 1, "w") for i, x in enumerate(TEXTS)]
    want = {i: np.array([*whole(WORDS, x), 1], "<u4").tobytes() for i, x, *_ in rows}
    sequences = check_pieces(pieces(spark, rows), want, 2048, 256, 2048)
    for own in sequences.values():
        n = own[0]["sequence_tokens"]
        assert n == 2048 or n & (n - 1) == 0  # no padding at all
    check_pieces(pieces(spark, rows, max_tokens=64, max_segments=3, max_loss=64), want, 64, 3, 64)


def test_packing_limits_with_prompts(spark):
    rows = [(i, "answer words " * (i % 7), 1, "ask me " * (i % 40)) for i in range(300)]
    want = {i: np.array([*whole(WORDS, p), *whole(WORDS, t), 1], "<u4").tobytes() for i, t, _, p in rows}
    check_pieces(pieces(spark, rows, prompt="words", max_tokens=256, max_segments=8, max_loss=100), want, 256, 8, 100)

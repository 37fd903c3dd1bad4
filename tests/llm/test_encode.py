import random

import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")

from voxloom.llm.encode import ChunkEncoder, count_tokens, default_vocabulary, encode_texts
from voxloom.llm import encode as module

PARTS = ["the ", "window's", "'", "re", "'ll", " ", "  ", "\n", "\n\n", "\r\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "　", " ", "我们", "。", "１２", "12", "é", "é", "🙂", "👩‍💻", "<|endoftext|>", "ÃÃ", "…", "a" * 40, "Ω", "​", "-~"]


@pytest.fixture(scope="module")
def encoder():
    return ChunkEncoder(default_vocabulary())


def wrong(encoder, texts):
    offsets, ids = encoder.encode(pa.array(texts, pa.string()))
    flat = [x for part in ids for x in part.tolist()]
    return [t for n, t in enumerate(texts) if flat[offsets[n] : offsets[n + 1]] != encoder.encoding.encode_ordinary(t or "")]


@pytest.mark.parametrize("limits", [(64, 2048, 1024), (4, 40, 16), (2, 20, 2)])
def test_equals_encoding_at_once(encoder, monkeypatch, limits):
    plain = module.chunk_edges
    monkeypatch.setattr(module, "chunk_edges", lambda data, offsets: plain(data, offsets, *limits))
    rng = random.Random(limits[0])
    texts = [None, "", " ", "\n"] + ["".join(rng.choices(PARTS, k=rng.randint(1, 300))) for _ in range(60)] + ["字" * 2000, "x" * 2000, "word " * 5000]
    assert wrong(encoder, texts) == []


def test_cache_is_bounded_and_reused():
    small = ChunkEncoder(default_vocabulary(), 20_000)
    text = " ".join(f"word{i} of a long text" for i in range(5000))
    assert wrong(small, [text, text]) == [] and small.room >= 0
    large = ChunkEncoder(default_vocabulary())
    assert wrong(large, [text, "Other start. " + text]) == [] and large.reused > large.encoded / 2


def test_operator(spark):
    df = spark.createDataFrame([(1, "Hello world", 5), (2, None, 6), (3, "", 7), (None, "x", 8), (1, "Hello world", 5)], "doc_id long, text string, ids int")
    rows = encode_texts(df).collect()
    assert sorted([(r.doc_id or 0, r.ids) for r in rows]) == [(0, [87]), (1, [15496, 995]), (1, [15496, 995]), (2, []), (3, [])]
    assert encode_texts(df.limit(0)).count() == 0
    assert sorted((r.doc_id or 0, r.ids, r.n_tokens) for r in count_tokens(df).collect()) == [(0, 8, 1), (1, 5, 2), (1, 5, 2), (2, 6, 0), (3, 7, 0)]

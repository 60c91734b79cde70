"""Token-id files: exact round trips, damaged blocks, and the query against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from lookalike.llm import pretokens, token_coder
from lookalike.llm.common import shared_folder

DOCS = "doc_id long, text string, start long, ids string, n_tokens int"


@pytest.fixture(scope="module")
def model():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


@pytest.fixture(scope="module")
def plain(model):
    import tokenizers
    t = tokenizers.Tokenizer.from_str(model)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def sequences():
    rng = np.random.default_rng(3)
    yield np.zeros(1, int)
    yield np.array([5, 5, 5, 7])
    yield np.full(10_000, 50256)
    yield rng.integers(0, 50257, 9000)
    yield rng.zipf(1.2, 40_000) % 50257
    yield np.tile([1, 2, 3, 4, 5], 4000)
    yield np.concatenate([rng.integers(0, 65536, 3000), np.zeros(3000, int), rng.zipf(1.05, 3000) % 60_000])


@pytest.mark.parametrize("ids", sequences())
def test_groups_round_trip(ids):
    data = token_coder.pack_group([4, None], [1, len(ids) - 1], ids.astype(np.uint32))
    docs, lengths, got = token_coder.unpack_group(data)
    assert docs == [4, None] and lengths.tolist() == [1, len(ids) - 1] and (got == ids).all()


def test_many_rounds_of_lanes(monkeypatch):
    monkeypatch.setattr(token_coder, "LANES", 3)
    monkeypatch.setattr(token_coder, "BLOCK", 1024)
    ids = np.random.default_rng(1).zipf(1.3, 10_000) % 400
    assert (token_coder.unpack_group(token_coder.pack_group([1], [len(ids)], ids.astype(np.uint32)))[2] == ids).all()


def test_repetition_is_cheap_and_blocks_are_independent():
    rng = np.random.default_rng(2)
    phrase = rng.integers(0, 40_000, 200)
    ids = np.tile(phrase, 60)
    assert len(token_coder.pack_group([1], [len(ids)], ids.astype(np.uint32))) < len(ids) / 2
    alphabet = np.unique(ids)
    words = token_coder.encode_ids(ids, alphabet, 1024)
    third = token_coder.decode_ids(words[3:4], 1024, alphabet, 1024)
    assert (third == ids[3072:4096]).all()


def test_damage_is_found():
    ids = np.random.default_rng(4).zipf(1.2, 5000) % 1000
    data = bytearray(token_coder.pack_group([1], [5000], ids.astype(np.uint32)))
    for at in (2, token_coder.HEADER.size + 3, len(data) - 10):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            token_coder.unpack_group(bytes(bad))


def expected(rows, plain):
    start, out = 0, []
    for doc_id, ids in sorted(((d, [*plain(t), 0]) for d, t in rows), key=lambda x: (x[0] is not None, x[0] or 0)):
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("group_ids", [50, token_coder.GROUP_IDS])
def test_files_equal_the_library(spark, model, plain, group_ids):
    rng = random.Random(6)
    texts = [None, "", " ", "\n\n", "don't we'll <|endoftext|> x", "é ü 日本 \U0001f600 ߷ ՘ ࢏", "w" * 5000, "word " * 3000]
    texts += [" ".join(rng.choice(["alpha", "1.5", "it's", "été", "\n", " ", "\x1c"]) for _ in range(30)) for _ in range(40)]
    rows = [(i * 7 % 101 if i else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(d, t, 0, "x", 1) for d, t in rows], DOCS).repartition(5)
    groups = token_coder.write_files(docs, model, shared_folder(spark, "ids"), group_ids=group_ids)
    got = token_coder.read_files(token_coder.placed(groups), with_ids=True).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == expected(rows, plain)
    assert all(len(r["ids"]) == r["n_tokens"] and r["ids"][-1] == 0 for r in got)


def test_repeated_ids_and_empty_tables(spark, model):
    docs = spark.createDataFrame([(d, t, 0, "x", 1) for d, t in [(3, "b b"), (3, "a"), (3, "b b"), (1, "c")]], DOCS)
    got = token_coder.round_trip(docs, model).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [1, 3, 3, 3] and sorted(r["n_tokens"] for r in got) == [2, 2, 3, 3]
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got]])[:-1].tolist()
    assert token_coder.round_trip(docs.where("false"), model).count() == 0


def test_classes_are_certain_in_the_ranges(model):
    """The library sees a letter, a digit or neither in every code point of the ranges as ``cut`` does."""
    import tokenizers
    split = tokenizers.Tokenizer.from_str(model).pre_tokenizer.pre_tokenize_str
    for lo, hi in token_coder._CERTAIN:
        for at in range(lo, hi, 97 if hi - lo > 3000 else 1):
            text = f"a{chr(at)}a1{chr(at)}1"
            assert len(split(text)) == len(pretokens.cut([text]).number), hex(at)


def test_query_equals_the_library(spark, plain):
    from lookalike.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op13_token_files"](spark, sf).orderBy("start").collect()
    assert [tuple(r) for r in got] == expected(rows, plain)

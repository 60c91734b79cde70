"""Vectorised pre-tokens against the pattern, and batches of texts against the reference encoder."""

import random
import struct

import numpy as np
import public_tokenizers
import pytest
import regex

from lookalike.llm import bpe, pretokens

ALPHABETS = ["ab 'strevmld \n", "a1 .'\t\n!", "é²　  'sx\x1c\x85\x00", "'re'll ve's", "日本 語1.\U0001f600'd "]


def test_the_pattern_is_the_vocabularies_one():
    assert pretokens.PATTERN == public_tokenizers.PATTERN


@pytest.mark.parametrize("alphabet", ALPHABETS)
def test_cut_equals_findall(alphabet):
    rng = random.Random(7)
    findall = regex.compile(pretokens.PATTERN).findall
    for _ in range(1500):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 25))) for _ in range(4)]
        got, low = pretokens.cut(texts), 0
        for text, high in zip(texts, got.ends.tolist()):
            assert [got.distinct[i].decode() for i in got.number[low:high]] == findall(text)
            low = high


def test_other_patterns_and_forgetting(monkeypatch):
    import tiktoken
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 20)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    rng = random.Random(2)
    for pattern in (public_tokenizers.PATTERN, r"\s?\S+|\s+"):
        codec = bpe.ByteBPE.from_ranks(ranks, pattern)
        plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for _ in range(20):
            texts = [" ".join(rng.choice(["alpha", "béta", "x1", "'s", "\n", "w" * rng.randrange(9)]) for _ in range(30)) for _ in range(3)] + [""]
            ids, ends = codec.encode_many(texts)
            want = [plain.encode_ordinary(t) for t in texts]
            assert ids.tolist() == [i for w in want for i in w] and np.diff(ends, prepend=0).tolist() == [len(w) for w in want]
            assert [bytes(d).decode() for d in codec.decode_many(ids, ends)] == texts
            assert codec.encode_packed(texts[0]) == struct.pack(f"<{len(want[0])}I", *want[0])


def test_a_separator_inside_the_vocabulary_is_refused(spark):
    from lookalike.llm import token_scan
    codec = bpe.ByteBPE.from_file(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    with pytest.raises(ValueError):
        token_scan.document_token_counts(spark.createDataFrame([(1, "a")], "doc_id long, text string"), codec, 0)

"""Separator scan against a plain pass over the whole stream."""

import random
import struct

import pytest

from lookalike.llm import token_scan
from lookalike.llm.bpe import ByteBPE
from lookalike.llm.common import shared_folder
from lookalike.llm.files import open_output

END = 7


def plain(tokens):
    out, n = [], 0
    for t in tokens:
        if t == END:
            out.append(n)
            n = 0
        else:
            n += 1
    return out + [n] * (n > 0)


def write(folder, tokens):
    name, out = open_output(folder, ".tokens")
    out.write(struct.pack(f"<{len(tokens)}H", *tokens))
    out.close()
    return name, 2 * len(tokens)


@pytest.mark.parametrize("block_bytes,scan", [(8, 3), (2, 4), (64, 2), (1 << 20, 4096)])
def test_stitched_counts_equal_a_plain_pass(spark, monkeypatch, block_bytes, scan):
    rng = random.Random(block_bytes)
    streams = [[], [END], [1], [END, END, 1], [1] * 50, [1] * 50 + [END], [END] * 20 + [1] * 9]
    streams += [[END if rng.random() < share else 1 for _ in range(rng.randrange(1, 120))]
                for share in (0.02, 0.2, 0.6) for _ in range(6)]
    folder = shared_folder(spark, "test-tokens")
    files = [write(folder, s) for s in streams]
    table = spark.createDataFrame(files, "file string, bytes long")
    blocks = token_scan.scan_blocks(table, END, block_bytes)
    got = {}
    for r in token_scan.stitch(blocks, scan).collect():
        got.setdefault(r["file"], {})[r["position"]] = r["n_tokens"]
    for (name, _), stream in zip(files, streams):
        found = got.get(name, {})
        assert sorted(found) == list(range(len(found)))
        assert [found[i] for i in range(len(found))] == plain(stream), stream


def test_document_counts(spark):
    ranks = {bytes([b]): b for b in range(256)} | {b"th": 256, b"the": 257, b" the": 258}
    codec = ByteBPE.from_ranks(ranks, r" ?\p{L}+|\s+|[^\s\p{L}]+")
    rows = [(1, "the the"), (2, None), (3, ""), (3, "x" * 5000), (None, "the"), (5, "the the")]
    docs = spark.createDataFrame([(i, t, 0, "f") for i, t in rows], "doc_id long, text string, n_tokens int, file string")
    got = token_scan.document_token_counts(docs, codec, 999, block_bytes=1024).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in got) == [(-1, 1), (1, 2), (2, 0), (3, 0), (3, 5000), (5, 2)]
    empty = docs.limit(0)
    assert token_scan.document_token_counts(empty, codec, 999).count() == 0
    with pytest.raises(ValueError):
        token_scan.write_token_files(docs, codec, 1 << 16, "file:///tmp")


def test_the_rows_of_documents_are_not_broadcast(spark):
    codec = ByteBPE.from_ranks({bytes([b]): b for b in range(256)}, r"\S+|\s+")
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(300)], "doc_id long, text string")
    got = token_scan.document_token_counts(docs, codec, 999)
    assert got.count() == 300
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and "strategy=merge" in plan
    got.collect()
    joins = [line for line in got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines() if "Join [" in line]
    assert "SortMergeJoin" in joins[0]

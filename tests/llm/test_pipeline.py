"""The pipeline against a plain Python version of its stages."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from lookalike.llm import bpe, raking
from test_llm_edges import brute_components, brute_lines

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(9)
    vocabulary = [f"word{i}" for i in range(400)]
    shared = "this very line is found in many documents"
    rows = []
    for i in range(240):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(12, 80)))
        if i % 8 == 3:
            text += "\n" + shared
        if i % 4 == 1:
            text += " you worthless idiot"
        rows.append((i, text))
    for i in range(240, 270):  # near and exact copies of clean documents
        words = rows[(i - 240) * 2][1].split(" ")
        if i % 2:
            words[len(words) // 2] = "changed"
        rows.append((i, " ".join(words)))
    rows += [(270, shared), (271, None), (272, "")]
    return [(i, t, ["en", "de", None][i % 3], f"src{i % 5 % 3}", len(t or "")) for i, t in rows]


def toxic(text):
    return "idiot" in (text or "")


def brute(rows, topics):
    rows = [r for r in rows if not toxic(r[1])]
    lines = brute_lines([(r[0], r[1]) for r in rows])
    rows = [(r[0], lines[r[0]][2], r[2], r[3]) for r in rows if not lines[r[0]][1] or lines[r[0]][2].strip()]
    own = brute_components([r[1] for r in rows], 5, 80)
    rows = [r for i, r in enumerate(rows) if own[i][1] == i]
    cells = [(r[3], r[2], topics(r[1])) for r in rows]
    tokens = np.array([len(r[1].split()) for r in rows], float)
    names = sorted(set(cells), key=str)
    mass = np.array([tokens[[c == n for c in cells]].sum() for n in names])
    weight = mass / mass.sum()
    for _ in range(500):
        for d in range(3):
            values = sorted({n[d] for n in names}, key=str)
            share = np.array([mass[[n[d] == v for n in names]].sum() for v in values]) ** raking.RakingConfig().smoothing
            for v, goal in zip(values, share / share.sum()):
                mine = np.array([n[d] == v for n in names])
                if weight[mine].sum() > 0:
                    weight[mine] *= goal / weight[mine].sum()
    factor = np.divide(weight, mass, out=np.zeros_like(weight), where=mass > 0)
    p = dict(zip(names, factor / factor.max()))
    low = min(p[n] for n, m in zip(names, mass) if m > 0)
    kept = []
    for r, cell in zip(rows, cells):
        text = hashlib.md5(r[1].encode()).hexdigest()
        u = int(hashlib.md5(f"{r[0]}\x1f{text}".encode()).hexdigest()[:12], 16) / 16 ** 12
        if u < (p[cell] or low):
            kept.append(r)
    return kept


def test_pipeline_equals_the_plain_version(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(toxic(t))) for i, t, *_ in rows if i < 240]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    texts = sorted({t or "" for r in rows for t in (r[1], "\n".join((r[1] or "").split("\n")[:-1]))})
    known = {r["t"]: r["topic"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", raking.topic_of(raking.F.col("t")).alias("topic")).collect()}
    want = brute(rows, known.__getitem__)
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(got) == sorted(r[0] for r in want) and len(got) > 50
    codec = bpe.ByteBPE.from_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    for doc_id, text, lang, source in want:
        ids = np.frombuffer(codec.encode_packed(text), "<i4").tolist()
        assert got[doc_id]["ids"] == ids and got[doc_id]["n_tokens"] == len(ids) and got[doc_id]["source"] == source


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_edge_rows(spark, tmp_path, name, stage):
    spark.createDataFrame([(1, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "a b", "en", "s", 3),
                                (4, "word " * 30_000, "de", "t", 150_000)], COLUMNS)
    out = stage(spark, df, str(tmp_path))
    if stage is not corpus_pipeline.STAGES[-1][1]:
        assert out.columns == corpus_pipeline.COLUMNS
    assert out.count() <= 5
    assert stage(spark, df.limit(0), str(tmp_path)).count() == 0

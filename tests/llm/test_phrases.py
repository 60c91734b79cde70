"""Phrase mining against a plain count: edge cases, bursting containers, spilled subtrees."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lookalike.llm import phrases

DOCS = "doc_id long, text string, lang string, n long, phrase string, size int, score double"


def plain(rows, min_count, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i:i + size])] += 1
    f = {k: v for k, v in f.items() if v >= min_count}
    out = []
    for lang in n:
        found = []
        for (of, w), a in f.items():
            if of != lang or len(w) < 2:
                continue
            score, k = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
            inside = any(o == lang and len(x) > len(w) and 100 * b >= 80 * a and any(x[i:i + len(w)] == w for i in range(len(x)))
                         for (o, x), b in f.items())
            if not inside:
                phrase = " ".join(w)
                found.append((-score, -a, phrase.encode(), (phrase, a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score)))
        found.sort(key=lambda x: x[:3])
        out += [(lang, i + 1, *x[3]) for i, x in enumerate(found[:top])]
    return sorted(out)


def got(spark, rows, min_count, **options):
    docs = spark.createDataFrame([(i, t, lang, 1, "x", 2, 0.5) for i, (t, lang) in enumerate(rows)], DOCS).repartition(4)
    return sorted(tuple(r) for r in phrases.collocations(docs, min_count, **options).collect())


def prose(rng, words):
    out = []
    for _ in range(words):
        out.append(rng.choice(["Red", "red", "grün", "fox", "the", "ß", " ", "a\x1fb", "x" * 9]))
        out.append(rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "\x0b", " ! "]))
    return "".join(out)


def test_equals_the_plain_count(spark):
    rng = random.Random(5)
    rows = [(prose(rng, rng.randrange(0, 60)), rng.choice(["en", "de", None, "und", ""])) for _ in range(150)]
    rows += [(None, "en"), ("", None), (" \t\n", "en"), ("the " * 20_000, "en"), ("w" * 200_000 + " b", "de"), (None, None)] + [rows[0]] * 5
    want = plain(rows, 4)
    assert len(want) > 100 and got(spark, rows, 4) == want


def test_top_and_ties(spark):
    rows = [("b a. c a. a b. a c. d e f g", "en")] * 3
    want = plain(rows, 3)
    assert got(spark, rows, 3) == want
    assert got(spark, rows, 3, top=2) == [w for w in want if w[1] <= 2]


@pytest.mark.parametrize("rows", [[], [(None, None)], [("one two", "en")]])
def test_small_tables(spark, rows):
    assert got(spark, rows, 30) == []


def test_trie_bursts_and_spills_whole_subtrees():
    rng = np.random.default_rng(1)
    trie, want = phrases.HatTrie(), Counter()
    words = [f"w{i}".encode() for i in range(300)]
    ids = trie.number(words)
    runs, burst = [], False
    for _ in range(30):
        grams = rng.zipf(1.3, (4000, 4)) % 300
        sizes = rng.integers(1, 5, 4000)
        for g, size in zip(grams, sizes):
            want[tuple(g[:size])] += 1
        cut = np.where(np.arange(4) < sizes[:, None], ids[grams], 0)
        packed = (cut[:, 1] << 42) | (cut[:, 2] << 21) | cut[:, 3]
        keys, n = np.unique(np.stack([cut[:, 0], packed]), axis=1, return_counts=True)
        trie.add(keys[0], keys[1], n)
        burst = burst or any(isinstance(c, phrases.Node) for c in trie.children.values())
        if trie.entries > 20_000:
            before = set(trie.children)
            runs += list(phrases._runs("en", trie, 10_000))
            assert trie.entries <= 10_000 and before - set(trie.children)
    assert burst
    runs += list(phrases._runs("en", trie, 0))
    assert trie.entries == 0 and len(runs) > 1
    found = Counter()
    for run, prefixes in runs:
        assert len(prefixes) == run.num_rows
        assert run.column("phrase").to_pylist() == sorted(run.column("phrase").to_pylist())
        for phrase, size, n in zip(run.column("phrase").to_pylist(), run.column("size").to_pylist(), run.column("n").to_pylist()):
            key = tuple(int(w[1:]) for w in phrase.split(" "))
            assert len(key) == size
            found[key] += n
    assert found == want


def test_words_of_a_sliced_array():
    texts = pa.array(["zz", "A b", None, "", "b, c\tB"]).slice(1)
    words, found, piece = phrases.cut_words(texts)
    assert [words[i].as_py() for i in found] == [b"a", b"b", b"b", b"c", b"b"]
    assert piece[0] == piece[1] < piece[2] < piece[3] == piece[4]


def test_parts_of_a_run_hold_whole_prefixes():
    run = pa.RecordBatch.from_pydict({"lang": ["en"] * 4, "size": pa.array([1, 2, 3, 2], pa.int32()), "phrase": ["a", "a b", "a b c", "b c"],
                                      "n": [1, 2, 3, 4]}, schema=phrases.RUN)
    blobs = phrases._blobs(run, np.array([7, 9, 9, 5], np.uint64), 4)
    got = {p: pa.ipc.open_stream(r).read_all().column("phrase").to_pylist() for p, r in zip(*[c.to_pylist() for c in blobs.columns])}
    assert got == {3: ["a"], 1: ["a b", "a b c", "b c"]}

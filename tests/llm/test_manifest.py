"""The manifest against a plain tree: nulls, ties, lone languages, trees of several leaf partitions."""

import hashlib
import zlib

import pytest

from lookalike.llm import manifest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, idx int"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(doc_id, source, lang, n_chars, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i:i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def lower(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, plain_leaf(r[0], r[3], r[2], r[4], r[1]), r))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        by_lang[lang].sort(key=lambda x: x[:3])
        trees.append(plain_tree([x[2] for x in by_lang[lang]]))
    top = plain_tree([t[-1][0] for t in trees])
    out = []
    for place, lang in enumerate(langs):
        for i, (_, _, leaf, r) in enumerate(by_lang[lang]):
            text = lower(r[1]) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else r[1]
            node, proof = plain_leaf(r[0], r[3], lang, r[4], text), ""
            for levels, at in ((trees[place], i), (top, place)):
                for nodes in levels[:-1]:
                    run = at // 8 * 8
                    before, after = "".join(nodes[run:at]), "".join(nodes[at + 1:run + 8])
                    proof, node, at = proof + before + after, h(before + node + after), at // 8
            out.append((r[0], leaf, trees[place][-1][0], top[-1][0], h(proof), node, node == top[-1][0]))
    return sorted(out, key=str)


def got(spark, rows):
    data = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS).repartition(5)
    return sorted([tuple(r) for r in manifest.digest(data).collect()], key=str)


def test_edges_equal_the_plain_tree(spark):
    rows = [(None, "Null Id", "en", "s", 7), (None, None, None, None, None), (3, "Ünï ß A", "en", None, 1), (3, "Ünï ß A", "en", None, 1),
            (3, "other", "en", "s", 2), (5, "", "", "s", 0), (6, "X" * 300_000, "de", "s", 5), (2 ** 62 + 1, "Big", "en", "s", 3)]
    rows += [(100 + i, f"Text {i}", f"l{i}", "s", i) for i in range(20)]
    rows += [(1000 + i, f"Text {i}", "fr", "s", i) for i in range(70)]
    assert got(spark, rows) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(1, "A b", None, "s", 3)]])
def test_small_tables(spark, rows):
    assert got(spark, rows) == plain(rows)


def test_several_leaf_partitions(spark):
    # nine leaf partitions: the last one is alone in its run above
    rows = [(3 * i, f"T{i}", "en", "s", i) for i in range(8 * manifest.PART + 5)] + [(7, "T", "de", "s", 1)]
    assert got(spark, rows) == plain(rows)

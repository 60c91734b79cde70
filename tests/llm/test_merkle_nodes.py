"""Every node of a fingerprint is the hash of its children."""

import hashlib
import random

from pyspark.sql import functions as F

from lookalike.llm import merkle


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def parse(fp):
    root, body = fp.split("#")
    sections = []
    for s in body.split("|"):
        node, paragraphs = s.split("=")
        sections.append((node, [p.split(".") for p in paragraphs.split(",")]))
    return root, sections


def prints(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["f"] for r in rows.withColumn("f", merkle.fingerprint(F.coalesce("text", F.lit("")))).orderBy("doc_id").collect()]


def test_nodes_are_hashes_of_their_children(spark):
    rng = random.Random(1)
    texts = ["", "one", " \n\n", "a  b c. d!\n\nzwei drei\n"] + [
        "\n".join(" ".join(rng.choice(["red", "fox", "é", "x.", " "]) for _ in range(rng.randrange(0, 12))) for _ in range(30)) for _ in range(20)]
    for text, fp in zip(texts, prints(spark, texts)):
        root, sections = parse(fp)
        assert root == md5("r" + ",".join(n for n, _ in sections))
        lines = iter(text.split("\n"))
        for node, paragraphs in sections:
            assert node == md5(",".join(p[0] for p in paragraphs))[:merkle.NODE_HEX]
            for paragraph, *leaves in paragraphs:
                assert paragraph == md5("p" + ".".join(leaves) + "." + md5(next(lines)))[:merkle.NODE_HEX]
        assert next(lines, None) is None


def test_a_changed_leaf_changes_its_ancestors_alone(spark):
    lines = [f"first line {i} of some words. and more {i}" for i in range(40)]
    changed = list(lines)
    changed[17] = changed[17].replace("some", "other")
    (root_a, a), (root_b, b) = map(parse, prints(spark, ["\n".join(lines), "\n".join(changed)]))
    assert root_a != root_b
    flat = lambda sections: [p for _, ps in sections for p in ps]
    differing = [(x, y) for x, y in zip(flat(a), flat(b)) if x != y]
    assert len(differing) == 1 and differing[0][0][0] != differing[0][1][0]
    assert sum(x != y for x, y in zip(differing[0][0][1:], differing[0][1][1:])) == 1
    # blanks and signs between spans belong to the text, too
    spaced = prints(spark, ["\n".join(lines), "\n".join(lines).replace("line 5 of", "line  5 of")])
    assert spaced[0] != spaced[1] and merkle.LEAF_HEX == 8

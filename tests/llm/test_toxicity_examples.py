"""Whole scores against brute force, and examples without a telling term."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lookalike.llm import toxicity


def test_a_copy_of_an_example_without_kept_terms_is_found(spark):
    rng = random.Random(5)
    words = [f"w{''.join(rng.choice('abcdefgh') for _ in range(5))}" for _ in range(300)]
    text = lambda: " ".join(rng.choice(words) for _ in range(30))
    clean = [text() for _ in range(200)]
    bad = [text() + " you idiot" for _ in range(60)]
    odd = "some quite unusual sentence whose words no other example holds anywhere"
    docs = spark.createDataFrame(list(enumerate([*clean, *bad, odd, odd, odd + " today", "nothing shared here"])), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(200)] + [(i, 1) for i in range(200, 261)], "doc_id long, toxic int")
    fitted = toxicity.fit(docs, labels)
    model = fitted.load()
    assert model.weights[model.terms.find([b"idiot"])[0]] > 1 > model.weights[model.terms.find([b"unusual"])[0]]
    got = {r["doc_id"]: r for r in toxicity.score(docs, fitted).where("doc_id >= 259").collect()}
    assert [got[i]["predicted"] for i in (261, 262, 263)] == [1, 1, 0]
    assert got[261]["evidence"][0]["doc_id"] == 260 and got[261]["evidence"][0]["cosine"] == pytest.approx(1)
    assert all(r["predicted"] == 0 for r in toxicity.score(docs, fitted).where("doc_id < 200").collect())


def test_small_classes_keep_terms(spark):
    rows = [(i, f"some text number{i} here" + (" moron" if i < 5 else "")) for i in range(64)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 9)) for i in range(64)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels).load()
    assert model.weights[model.terms.find([b"moron"])[0]] > 1


def plain_words(text):
    """Lower-case words of three bytes or more."""
    low = toxicity._SIGNS.sub(" ", text.lower())
    return [w for w in re.findall(r"[^\W\d_]+", low) if len(w.encode()) >= 3]


def plain_scores(texts, examples, config):
    """Scores by comparing every text with every example.  ``examples``: (text, toxic)."""
    n = [sum(1 for _, x in examples if x == v) for v in (0, 1)]

    def terms(text):
        out = Counter()
        for w in plain_words(text):
            out[w] += 1
            for k in config.prefixes:
                if len(w) >= k:
                    out[w[:k] + "*"] += 1
        return out
    counts = [(terms(t), x) for t, x in examples]
    df, a = Counter(), Counter()
    for c, x in counts:
        df.update(c.keys())
        if x:
            a.update(c.keys())

    def part(x, e):
        return x * math.log(x / e) if x > 0 else 0.0
    bound = toxicity.lower_bound(config, len(df))
    telling = set()
    for t, m in df.items():
        p, x, y = m / sum(n), a[t], m - a[t]
        stat = 2 * (part(x, n[1] * p) + part(n[1] - x, n[1] * (1 - p)) + part(y, n[0] * p) + part(n[0] - y, n[0] * (1 - p)))
        if stat >= bound and x * n[0] >= config.min_lift * y * n[1]:
            telling.add(t)

    def vector(c):
        v = {t: (1 + math.log(k)) * (math.log(sum(n) + 1) - math.log(df[t] + 1) + 1) * (1.0 if t in telling else config.other_weight)
             for t, k in c.items() if not t.endswith("*") or t in telling}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()} if norm else {}
    vectors = [(vector(c), x) for c, x in counts]
    held = [i for i, (v, _) in enumerate(vectors) if v]
    rate = n[1] / sum(n)
    without = [x for c, x in counts if not telling & c.keys()]
    plain = (sum(without) + rate) / (len(without) + 1)
    out = []
    for text in texts:
        q = vector(terms(text))
        prior = rate if telling & q.keys() else plain
        every = sorted(((-min(round(sum(w * vectors[i][0].get(t, 0.0) for t, w in q.items()), 12), 1.0), i) for i in held))[:config.neighbours]
        near = [(-s, i) for s, i in every if s < 0]
        votes = [((s / (1.01 - s)) ** 2, vectors[i][1]) for s, i in near]
        share, total = sum(v * x for v, x in votes), sum(v for v, _ in votes)
        out.append((share + config.prior_weight * prior) / (total + config.prior_weight) if near else prior)
    return out, telling


@pytest.mark.parametrize("common", [0, 5, 512])
def test_scores_equal_brute_force(spark, common):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdeéßü") for _ in range(rng.randrange(2, 9))) for _ in range(120)]
    stems = ["achlich", "idiot", "réeux"]

    def text(toxic):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 40))]
        if toxic and rng.random() < 0.8:
            words += [rng.choice(stems) + rng.choice(["", "en", "ist", "à"]) for _ in range(rng.randrange(1, 4))]
        rng.shuffle(words)
        return "".join(w + rng.choice([" ", ", ", "1", "\n", " – "]) for w in words)
    examples = [(text(x), x) for x in [0] * 150 + [1] * 60]
    others = [text(i % 3 == 0) for i in range(120)] + ["", "?? 12", examples[5][0], examples[160][0], "x" * 5000]
    texts = [t for t, _ in examples] + others
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, (_, x) in enumerate(examples)], "doc_id long, toxic int")
    config = toxicity.ToxicityConfig(common=common, block=8)
    fitted = toxicity.fit(docs, labels, config)
    want, telling = plain_scores(texts, examples, config)
    assert {t.decode() for t in fitted.load().telling} == {t for t in telling if t.endswith("*")} and len(telling) > 3
    got = [r["score"] for r in toxicity.score(docs, fitted).orderBy("doc_id").collect()]
    assert np.abs(np.array(got) - np.array(want)).max() < 1e-6


def test_the_sample_is_bounded_in_bytes(spark):
    rows = [(i, f"alpha beta w{i % 7} " + "x" * 100) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, toxicity.ToxicityConfig(max_bytes=1000)).load()
    assert 2 * 8 <= len(model.example_ids) <= 2 * 10

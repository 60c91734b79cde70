"""Edge cases and brute-force comparisons of the llm operators on small fixtures."""

import hashlib
import random
import re
import struct

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lookalike.llm import bpe, graph_ann, line_dedup, merkle, ngram_join, pii, raking, toxicity, warc
from lookalike.llm.common import shared_folder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score int, ids string, h string"


def docs(spark, texts, start=0):
    """Rows with extra columns whose names clash with the operators' own."""
    rows = [(start + i, t, "en" if i % 3 else None, f"s{i % 2}", 0, 1, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


LONG = "word " * 40_000
EDGE = [None, "", " ", "\n\n", "same text here", "same text here", "x" * 100_000, LONG, "Ünïcode ß 😀 é", "\t a\x0b"]


@pytest.fixture(scope="module")
def codec():
    return bpe.ByteBPE.from_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


# ---------------- byte-level BPE ----------------

def test_bpe_equals_tiktoken_and_round_trips(spark, codec):
    import tiktoken
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = EDGE + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(161, 0x2fff)])) for _ in range(60)) for _ in range(40)]
    got = bpe.decode(bpe.encode(docs(spark, texts), codec), codec).orderBy("doc_id").collect()
    for row, text in zip(got, texts):
        want = plain.encode_ordinary(text or "")
        assert bytes(row["ids"]) == struct.pack(f"<{len(want)}I", *want)
        assert bytes(row["decoded"]) == (text or "").encode() and row["h"] == "y"
    listed = bpe.encode(docs(spark, texts), codec, packed=False).orderBy("doc_id").collect()
    assert [r["ids"] for r in listed] == [plain.encode_ordinary(t or "") for t in texts]
    assert bpe.round_trip(docs(spark, []), codec).count() == 0


def test_ranks_with_gaps_are_refused():
    with pytest.raises(ValueError):
        bpe.sentencepiece_model({b"a": 0, b"b": 2})


# ---------------- personal data ----------------

def brute_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"\D", "", m.group())
        if 12 <= len(digits) <= 19 and pii.luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"\D", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def test_base_spans_equal_the_patterns():
    rng = random.Random(0)
    for alphabet in ("ab1@.-+ ", "0123. ", "0123456789 -", "+01234 ().-", "a@.1+5 0-x_%"):
        for _ in range(3000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 40)))
            assert [s[:3] for s in pii.find_spans(text) if s[3]] == brute_spans(text), text


@pytest.mark.parametrize("text,kind,span", [
    ("mail me john [at] example [dot] com now", "email", "john [at] example [dot] com"),
    ("john.doe at example dot com", "email", "john.doe at example dot com"),
    ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
    ("plus one five five five one two three four five six seven", "phone", None),
    ("card 4522 68OO 8302 6435 x", "card", "4522 68OO 8302 6435"),
    ("４５２２６８００８３０２６４３５", "card", None),
    ("vier fünf zwei zwei sechs acht null null acht drei null zwei sechs vier drei fünf", "card", None),
    ("54[.]54[.]173[.]120", "ip", None), ("54 dot 54 dot 173 dot 120", "ip", None),
    ("jo​hn@example.com", "email", None),
])
def test_disguises_are_found_at_source_offsets(text, kind, span):
    found = [(k, text[s:e]) for k, s, e, base in pii.find_spans(text) if not base]
    assert (kind, span or text) in found


@pytest.mark.parametrize("text", ["look at example.com there", "one two buckle my shoe", "at a point in time", "", "O lO Il 5 0",
                                  "the point at hand [at] all"])
def test_clean_texts_stay_clean(text):
    assert pii.find_spans(text) == []


def test_pii_on_edge_rows(spark):
    out = pii.digest(docs(spark, EDGE + ["a@b.c and 1.2.3.4"])).orderBy("doc_id").collect()
    assert len(out) == len(EDGE) + 1 and out[-1]["spans"] == "email:0:5,ip:10:17" and out[-1]["n_ip"] == 1
    assert out[-1]["base_sha256"] == hashlib.sha256(b"email:0:5,ip:10:17").hexdigest()
    assert pii.redact(pii.detect(docs(spark, ["to a@b.c!", None]))).orderBy("doc_id").first()["text"] == "to [EMAIL]!"
    assert pii.digest(docs(spark, [])).count() == 0


# ---------------- line dedup ----------------

def brute_lines(rows, min_chars=20, min_docs=3):
    blanks = " \t\n\x0b\x0c\r"
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(blanks))
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(i)
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= min_docs and i != max(holders[key(x)]))]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("batches,fanout", [(1, 2), (5, 2)])
def test_line_dedup_equals_brute_force(spark, batches, fanout):
    rng = random.Random(batches)
    pool = [f"  Shared Line number {i} of the pool\t" for i in range(12)] + ["short", "", "ÜBER " * 5]
    texts = EDGE + ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    out = line_dedup.drop_repeated_lines(docs(spark, texts), batches=batches, fanout=fanout).orderBy("doc_id").collect()
    want = brute_lines(list(enumerate(texts)))
    assert [(r["n_lines"], r["n_dropped"], r["text"]) for r in out] == [want[i] for i in range(len(texts))]
    assert out[0]["h"] == "y"


def test_line_dedup_with_repeated_and_null_ids(spark):
    line = "one line that three documents share"
    df = spark.createDataFrame([(5, line), (5, line), (5, "a\n" + line), (None, line), (7, line)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_dropped"], r["text"]) for r in line_dedup.drop_repeated_lines(df).collect())
    assert got == [(-1, 1, ""), (5, 1, ""), (5, 1, ""), (5, 1, "a"), (7, 0, line)]
    assert line_dedup.digest(df.limit(0)).count() == 0


# ---------------- fingerprints ----------------

def test_next_documents_cross_windows(spark):
    ids = [3, 5, 600, 601, 5000, 5001, 400_000, -9]
    df = spark.createDataFrame([(i, f"text of {i}") for i in ids], "doc_id long, text string")
    got = {r["doc_id"]: r["next_text"] for r in merkle.with_next(df, ["text"]).collect()}
    down = sorted(ids, reverse=True)
    assert got == {i: f"text of {down[(k + 1) % len(down)]}" for k, i in enumerate(down)}


def test_fingerprints_on_edge_rows(spark):
    got = {r["doc_id"]: r for r in merkle.digest(docs(spark, EDGE)).collect()}
    assert len(got) == len(EDGE) and got[0]["fingerprint"] == got[1]["fingerprint"] and got[4]["fingerprint"] == got[5]["fingerprint"]
    assert got[5]["near_next"] == 1.0 and got[6]["near_next"] == 0.0 and got[0]["n_chars"] == 0
    text = LONG
    cut = len(text) // 3
    assert got[7]["edited_sha256"] == hashlib.sha256((text[:len(text) - cut] + EDGE[6][:cut]).encode()).hexdigest()
    one = merkle.digest(docs(spark, ["alone in the world"])).first()
    assert one["near_next"] == 1.0
    assert merkle.digest(docs(spark, [])).count() == 0
    twice = spark.createDataFrame([(1, "b"), (1, "a"), (None, "c")], "doc_id long, text string")
    assert sorted(r["next_text"] for r in merkle.with_next(twice, ["text"]).collect()) == ["a", "b", "c"]


def test_branches_locate_an_edit(spark):
    lines = [f"Paragraph {i} has some words. And a second sentence." for i in range(40)]
    other = lines[:20] + ["This one was rewritten."] + lines[21:]
    df = spark.createDataFrame([("\n".join(lines), "\n".join(other))], "a string, b string")
    row = df.select(merkle.changed(merkle.fingerprint(F.col("a")), merkle.fingerprint(F.col("b"))).alias("x")).first()
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    leaves = ".".join(md5(s)[:8] for s in re.findall(merkle.SPAN, lines[20]))
    assert row["x"] == [md5(f"p{leaves}.{md5(lines[20])}")[:12]]


# ---------------- n-gram join ----------------

def brute_components(texts, n, percent):
    def grams(text):
        words = (text or "").encode().lower().split()
        return {tuple(words)} if 0 < len(words) < n else {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}
    sets = [grams(t) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("n,percent", [(4, 85), (2, 60)])
def test_ngram_components_equal_brute_force(spark, n, percent):
    rng = random.Random(n)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = list(EDGE)
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 90))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
        texts.append(passage + " " + " ".join(base))
    got = ngram_join.join_components(docs(spark, texts), n, percent).orderBy("doc_id").collect()
    assert [(r["n_shingles"], r["component_id"]) for r in got] == brute_components(texts, n, percent)


def test_ngram_join_with_repeated_and_null_ids(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    df = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b), (None, a), (4, "x y")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in ngram_join.join_components(df).collect())
    assert got == [(-1, None), (1, 1), (2, 1), (2, 1), (3, 1), (4, 4)]
    assert sorted(r["doc_id"] or -1 for r in ngram_join.keep_one(df).collect()) == [-1, 1, 4]
    assert ngram_join.join_components(df.limit(0)).count() == 0


def test_links_beside_an_unrelated_leader(spark):
    """A list whose leader links with nothing still yields the link of two other sets."""
    shared = " ".join(f"s{i}" for i in range(40))
    texts = [shared + " " + " ".join(f"a{i}" for i in range(200))]
    texts += [shared + " " + " ".join(f"b{i}" for i in range(200)) + end for end in (" one", " two", " three")]
    got = ngram_join.join_components(docs(spark, texts)).orderBy("doc_id").collect()
    assert [(r["n_shingles"], r["component_id"]) for r in got] == brute_components(texts, 4, 85)
    assert [r["component_id"] for r in got] == [0, 1, 1, 1]


@pytest.mark.parametrize("percent", [1, 30, 50, 60, 70, 80, 85, 95, 100])
def test_prefixes_of_similar_sets_collide(percent):
    """The bound behind the index, on random sets with worst-case differences; the first token that
    two sets share leaves both of them enough tokens."""
    rng = random.Random(percent)
    for _ in range(3000):
        size = rng.randrange(1, 60)
        a = rng.sample(range(1000), size)
        b = set(a)
        for _ in range(rng.randrange(0, size)):
            b = b | {rng.randrange(1000)} if rng.random() < 0.5 else b - {min(b)} if len(b) > 1 else b
        a = set(a)
        if 100 * len(a & b) < percent * len(a | b):
            continue
        order = list(range(1000))
        rng.shuffle(order)
        sample = lambda s: sorted(sorted(s)[:ngram_join.sample_size(len(s), percent)], key=order.__getitem__)
        pick = lambda s: sample(s)[:ngram_join.prefix_size(len(s), percent)]
        shared = set(pick(a)) & set(pick(b))
        assert shared
        first = min(shared, key=order.__getitem__)
        rest = min(len(s) - s.index(first) for s in (sample(a), sample(b)))
        larger = max(len(a), len(b))
        assert rest >= max(1, -(-(ngram_join.sample_percent(percent) + percent - 100) * larger // 100))


@pytest.mark.parametrize("percent", [50, 60, 70, 80, 85, 95])
def test_links_equal_brute_force_at_every_threshold(spark, percent):
    rng = random.Random(percent)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(25):  # pairs of chosen similarity, and small sets
        words = [rng.choice(vocabulary) for _ in range(rng.choice([2, 5, 9, 40, 80]))]
        texts.append(" ".join(words))
        for _ in range(3):
            other = list(words)
            for _ in range(rng.randrange(0, 1 + len(words) // 8)):
                other[rng.randrange(len(other))] = rng.choice(vocabulary)
            texts.append(" ".join(other[:rng.randrange(len(other) // 2, len(other)) + 1]))
    # sets whose similarity is exactly one half: words of one gram each
    texts += [" ".join(f"x{i}_{j}" for j in range(13)) + end for i in range(5) for end in ("", " " + " ".join(f"y{i}_{j}" for j in range(10)))]
    got = ngram_join.join_components(docs(spark, texts), 4, percent).orderBy("doc_id").collect()
    assert [(r["n_shingles"], r["component_id"]) for r in got] == brute_components(texts, 4, percent)


def test_thresholds_out_of_range_are_refused(spark):
    with pytest.raises(ValueError):
        ngram_join.join_components(docs(spark, ["a b c d"]), 4, 0)


# ---------------- toxicity ----------------

@pytest.mark.parametrize("common", [0, 7, 45])
def test_nearest_examples_are_exact(common):
    rng = np.random.default_rng(0)

    def vectors(n, terms, size):
        out = []
        for _ in range(n):
            v = dict(zip(rng.choice(terms, size, False).tolist(), rng.random(size).tolist()))
            norm = sum(w * w for w in v.values()) ** 0.5
            out.append({t: w / norm for t, w in sorted(v.items())})
        return out

    def triples(rows):
        return (np.array([i for i, v in enumerate(rows) for _ in v], int), np.array([t for v in rows for t in v], int),
                np.array([w for v in rows for w in v.values()]))
    examples = vectors(500, 40, 6)
    examples[7] = examples[300]
    queries = [*vectors(60, 45, 5), examples[300], {}]
    index = toxicity.BlockMaxIndex(*triples(examples), 500, 45, common, 16)
    got = index.nearest(*triples(queries), len(queries), 10)
    for q, (ids, cosines) in zip(queries, got):
        every = [(round(sum(w * v.get(t, 0.0) for t, w in q.items()), 12), i) for i, v in enumerate(examples)]
        want = [(i, s) for s, i in sorted(every, key=lambda x: (-x[0], x[1])) if s > 0][:10]
        assert cosines.tolist() == pytest.approx([s for _, s in want], abs=1e-11)
        assert all(abs(dict((i, s) for s, i in every)[i] - c) < 1e-11 for i, c in zip(ids.tolist(), cosines.tolist()))
    assert got[60][0][:2].tolist() == [7, 300] and len(got[61][0]) == 0


def test_blocks_without_neighbours_are_skipped(monkeypatch):
    """Groups of like examples: a query scores few blocks beyond the first ones."""
    rng = np.random.default_rng(1)
    example, term, weight = [], [], []
    for i in range(2048):
        own = np.concatenate([[i % 16], 20 + (i % 16) * 30 + rng.choice(30, 6, False)])
        example += [i] * len(own)
        term += own.tolist()
        weight += [1 / len(own) ** 0.5] * len(own)
    index = toxicity.BlockMaxIndex(np.array(example), np.array(term), np.array(weight), 2048, 500, 100, 64)
    pairs, plain = [], index._score
    monkeypatch.setattr(index, "_score", lambda found, dense, wanted: pairs.append(int(wanted.sum())) or plain(found, dense, wanted))
    part = np.array(example) < 64
    index.nearest(np.array(example)[part], np.array(term)[part], np.array(weight)[part], 64, 15)
    assert sum(pairs) < 64 * index.blocks / 2


def test_toxicity_learns_and_handles_edges(spark):
    rng = random.Random(1)
    clean = [f"{rng.choice('abcdef')}lpha beta gamma{rng.randrange(50)} delta" for _ in range(300)]
    bad = [c + " you idiot" for c in clean[:150]]
    df = docs(spark, clean + bad + EDGE)
    labels = spark.createDataFrame([(i, 0) for i in range(300)] + [(i, 1) for i in range(300, 450)] + [(None, 1), (3, None), (3, 0)],
                                   "doc_id long, toxic int")
    rows = {r["doc_id"]: r for r in toxicity.score_documents(df, labels).collect()}
    assert len(rows) == 460 and all(0 <= r["score"] <= 1 for r in rows.values())
    assert all(rows[i]["predicted"] == int(i >= 300) for i in range(450))
    assert rows[450]["score"] == rows[451]["score"] == rows[452]["score"] and rows[450]["predicted"] == 0
    assert {e["label"] for e in rows[310]["evidence"]} == {1}
    assert any(r["held_out"] for r in rows.values())
    none = toxicity.score_documents(df, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.0}
    assert toxicity.score_documents(df.limit(0), labels).count() == 0


# ---------------- raking ----------------

def test_raking_reaches_targets(spark):
    rng = random.Random(2)
    rows = [(i, "word " * rng.randrange(1, 60), rng.choice(["en", "de", None]), rng.choice("ab"), 0) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept long")
    config = raking.RakingConfig(targets={"source": {"a": 0.8, "b": 0.2, "absent": 0.5}})
    out = raking.mix(df, config, topic=F.when(F.col("doc_id") % 2 == 0, F.lit("even"))).toPandas()
    assert len(out) == 600 and out.probability.max() == pytest.approx(1.0) and out.kept.dtype == bool
    expected = (out.n_tokens * out.probability).groupby(out.source).sum()
    assert (expected / expected.sum())["a"] == pytest.approx(0.8, abs=1e-4)
    smooth = out.groupby(out.topic.fillna("-")).n_tokens.sum() ** config.smoothing
    found = (out.n_tokens * out.probability).groupby(out.topic.fillna("-")).sum()
    assert (found / found.sum()).to_numpy() == pytest.approx((smooth / smooth.sum()).to_numpy(), abs=1e-4)


def test_raking_on_edge_rows(spark):
    out = raking.mix(docs(spark, EDGE)).collect()
    assert len(out) == len(EDGE) and all(0 <= r["probability"] <= 1 for r in out)
    assert raking.digest(docs(spark, [])).count() == 0


# ---------------- WARC ----------------

@pytest.mark.parametrize("block", [64, 1000, 1 << 22])
def test_warc_records_survive_any_ranges(spark, block):
    rng = random.Random(block)
    inner = warc.gzip_member(warc.VERSION + b"WARC-Type: fake").decode("latin-1")
    pages = [(i, f"http://x.y/{i} a", rng.choice([None, "", "same", "é" * 50, inner, str(rng.random()) * 400])) for i in range(40)]
    df = spark.createDataFrame(pages + [(7, None, "same"), (7, "u", "other")], "page_id long, url string, html string")
    folder = shared_folder(spark, "test-warc")
    got = warc.read_archives(warc.write_archives(df, folder), block_bytes=block).collect()
    assert len(got) == 42
    payloads = {}
    for i, _, html in [(p[0], p[1], p[2] or "") for p in pages] + [(7, None, "same"), (7, "u", "other")]:
        payloads.setdefault(html.encode(), []).append(i)
    want = sorted((i, len(p), warc.payload_digest(p), max(ids) if i != max(ids) else -1) for p, ids in payloads.items() for i in ids)
    assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], -1 if r["refers_to"] is None else r["refers_to"]) for r in got) == want
    assert all((r["payload"] is None) == (r["record_type"] == "revisit") for r in got)


def test_warc_edges(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(empty).count() == 0
    nameless = spark.createDataFrame([(None, "u", "x")], "page_id long, url string, html string")
    with pytest.raises(Exception, match="must not be NULL"):
        warc.round_trip(nameless, null_ids=False).collect()
    one = warc.round_trip(nameless).collect()
    assert [(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in one] == [(None, 1, "response", None)]


# ---------------- nearest vectors ----------------

def test_graph_recall_and_ties(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(900, 12)) * rng.uniform(0.5, 2, (900, 1))
    base[100:160] = base[100]  # a very common vector
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(base)]
    rows += [(2000, None, 0), (2001, [0.0] * 12, 0), (2002, [float("nan")] * 12, 0), (2003, [None] + [1.0] * 11, 0),
             (2004, [1.0, 2.0], 0), (None, [1.0] * 12, 0), (5, rows[5][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    config = graph_ann.GraphConfig(shard_rows=300)
    got = graph_ann.nearest(df, k=10, every=20, config=config).toPandas()
    assert sorted(got.query_id.unique()) == list(range(0, 900, 20))
    hits = 0
    for q, part in got.groupby("query_id"):
        scores = base @ base[q]
        order = [i for i in sorted(range(900), key=lambda i: (-round(scores[i], 9), i)) if i != q][:10]
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, 11)) and q not in set(part.vec_id)
        assert np.allclose(part.score, scores[part.vec_id])
        hits += len(set(order) & set(part.vec_id))
    assert hits >= 0.95 * 10 * got.query_id.nunique()
    same = got[got.query_id == 100].sort_values("rank").vec_id.tolist()
    assert same[0] == 101 or base[same[0]] @ base[100] >= base[100] @ base[100]
    few = df.where("vec_id < 4 or vec_id = 20")
    assert graph_ann.nearest(few, k=10, every=20, config=config).groupBy("query_id").count().toPandas()["count"].tolist() == [4, 4]
    assert graph_ann.nearest(df.limit(0)).count() == 0

"""Operator 5: toxicity from the nearest labelled examples by exact TF-IDF cosine.

``fit`` learns from a bounded sample of labelled rows (``max_examples`` rows and ``max_bytes`` bytes of text
of each class, those with the smallest row hash).  Terms are all words of the sample, and the
beginnings of words that tell the classes apart.  A term's weight is (1 + log tf) * idf * class weight: the
class weight is 1 for terms that are ``min_lift`` times as frequent in toxic rows with a
likelihood-ratio statistic of ``min_g2`` (or less where fewer terms were looked at, ``lower_bound``), and
``other_weight`` for all others.  So a text with a telling term is nearest to examples that share such
terms, and any other text, whose weights all shrink alike, is compared by plain TF-IDF.

All examples lie in one block-max inverted index over all terms: blocks of ``block`` examples that are
alike, postings for rare terms, rows of weights for the ``common`` most frequent ones, and the largest
weight of every common term in every block.  Queries run in batches.  The postings of their rare
terms are added up exactly; a block's bound is the best of those sums plus the bound of the common
terms.  A query first scores the blocks with its highest bounds whole, which gives a floor for its
k-th best cosine, and then the blocks whose bound reaches that floor; the others can hold none of its
neighbours, so these are exact.

Votes are weighted by the inverse squared distance and by how many labelled rows an example stands
for; the prior joins as one further vote, which keeps scores calibrated when little evidence is found:
the share of toxic rows among labelled rows, or, for a text without a telling term, among those that
have none either.  The nearest examples are returned as evidence.

Edge cases: NULL or empty texts, and texts that share no word with an example, have no neighbours
and get the prior of texts without telling terms; without labelled rows every score is 0; equal
texts get equal scores, and cosine ties go to the example with the smaller id; repeated labels of one
document count once, toxic if any of them is; extra columns pass through, clashing output names
replace the input's; empty tables give empty tables.
"""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lookalike.llm.common import prepare, shared_folder, text_slices, written
from lookalike.llm.files import open_input, open_output

#: Signs beyond ASCII that separate words; ASCII signs and digits do so by BREAKS.
_SIGNS = re.compile("[\x80-\xbf×÷ -⯿　-〿＀-＠]")
BREAKS = bytes(c if chr(c).isalpha() or c > 127 else 32 for c in range(256))
LEAST_BYTES = 3             #: shorter words are no terms
SLICE = 2 << 20             #: bytes of text that are cut into words at once
BATCH = 32                  #: queries that are searched at once
FIRST_BLOCKS = 4            #: blocks that every query scores first


@dataclass(frozen=True)
class ToxicityConfig:
    max_examples: int = 5_000     #: labelled rows per class that are learned from (documented bound)
    max_bytes: int = 32 << 20     #: bytes of their texts per class (documented bound)
    max_terms: int = 50_000       #: terms of class weight 1, highest statistic first
    prefixes: tuple[int, ...] = (4, 5, 6)  #: lengths of word beginnings that may be terms
    min_g2: float = 24.0          #: likelihood ratio statistic that suffices for class weight 1
    min_lift: float = 8.0         #: times that such a term must be more frequent in toxic rows
    other_weight: float = 0.02    #: class weight of all other terms
    neighbours: int = 15
    prior_weight: float = 0.25    #: weight of the prior among the votes
    threshold: float = 0.3
    common: int = 256             #: most frequent terms, kept as rows of weights
    block: int = 64               #: examples per block of the index
    evidence: int = 3


def cut_words(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, word number and text number of every occurrence) of all texts: lower-case, in
    UTF-8, cut at everything that is no letter, LEAST_BYTES long or longer."""
    low = [t.lower() for t in texts]
    raw = [(t if t.isascii() else _SIGNS.sub(" ", t)).encode("utf-8", "replace") for t in low]
    data = np.frombuffer(b" ".join(raw).translate(BREAKS), np.uint8)
    inside = data != 32
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    stops = np.cumsum([len(r) + 1 for r in raw])
    text = np.searchsorted(stops, first, side="right")
    ends = np.concatenate([[0], np.cumsum(last - first)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    long = (last - first) >= LEAST_BYTES
    coded = words.filter(pa.array(long)).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), text[long]


def counted(number: np.ndarray, text: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word, occurrences) of the distinct words of every text, by text and word."""
    keys, n = np.unique(text * max(words, 1) + number, return_counts=True)
    return keys // max(words, 1), keys % max(words, 1), n


def beginnings(word: bytes, lengths: tuple[int, ...]) -> list[bytes]:
    """Beginnings of a word (in characters), marked by a star."""
    text = word.decode("utf-8", "replace")
    return [text[:n].encode() + b"*" for n in lengths if len(text) >= n]


class Terms:
    """Numbers of terms, found by hash and compared: most frequent term first."""

    def __init__(self, names: list[bytes]):
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.numbers, self.names = hashes[order], order.astype(np.int32), pa.array(names, pa.large_binary())

    def find(self, words: list[bytes]) -> np.ndarray:
        """Number of every word; -1 where it is no term."""
        if not len(self.hashes) or not words:
            return np.full(len(words), -1)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        got = self.numbers[np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)]
        same = pc.equal(self.names.take(pa.array(got)), pa.array(words, pa.large_binary())).to_numpy(zero_copy_only=False)
        return np.where(same, got, -1)


class BlockMaxIndex:
    """Inverted index over unit vectors of examples, given as (example, term, weight); terms below
    ``common`` are kept as rows of weights with their largest weight per block, the others as postings."""

    def __init__(self, example: np.ndarray, term: np.ndarray, weight: np.ndarray, examples: int, terms: int, common: int, block: int):
        self.size, self.block, self.common = examples, block, min(common, terms)
        often = term < self.common
        rows = np.zeros((examples, self.common))
        rows[example[often], term[often]] = weight[often]
        # like examples side by side: by the nearest of a few of them
        pivots = rows[np.linspace(0, examples - 1, min(examples, 16)).astype(int)]
        nearest = (rows @ pivots.T).argmax(axis=1)
        self.order = np.lexsort((np.arange(examples), nearest))       # example at every place
        place = np.empty(examples, np.int64)
        place[self.order] = np.arange(examples)
        self.blocks = -(-examples // block)
        self.padded = self.blocks * block
        self.rows = np.zeros((self.blocks, block, self.common))
        self.rows.reshape(self.padded, self.common)[:examples] = rows[self.order]
        del rows
        self.top = self.rows.max(axis=1).T.copy()                     # (common term, block)
        place, rare = place[example[~often]].astype(np.int32), term[~often]
        by_term = np.lexsort((place, rare))
        self.places, self.weights = place[by_term], weight[~often][by_term]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(rare, minlength=terms))]).astype(np.int32)

    def nearest(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray, queries: int, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(examples, cosines) of the k nearest examples with a cosine above 0 of every query, exactly;
        queries are unit vectors given as (query, term, weight)."""
        often = term < self.common
        dense = np.zeros((queries, self.common))
        dense[query[often], term[often]] = weight[often]
        query, term, weight = query[~often], term[~often], weight[~often]
        held = self.start[term + 1] - self.start[term]
        stops = np.cumsum(held, dtype=np.int32)
        at = np.repeat(self.start[term] - (stops - held), held)
        at += np.arange(len(at), dtype=np.int32)
        places = np.repeat((query * self.padded).astype(np.int32), held)
        places += self.places[at]
        found = np.bincount(places, self.weights[at] * np.repeat(weight, held), queries * self.padded).astype(float).reshape(queries, self.blocks, self.block)
        bound = found.max(axis=2) + dense @ self.top
        first = np.argpartition(-bound, min(FIRST_BLOCKS, self.blocks) - 1, axis=1)[:, :FIRST_BLOCKS]
        scored = np.zeros((queries, self.blocks), bool)
        scored[np.arange(queries)[:, None], first] = True
        visited = scored & (bound > 0)
        self._score(found, dense, visited)
        # a floor of the k-th best cosine, from the blocks scored so far; reached within 1e-9
        seen = np.take_along_axis(found * visited[:, :, None], first[:, :, None], axis=1).reshape(queries, -1)
        floor = np.partition(seen, seen.shape[1] - k, axis=1)[:, seen.shape[1] - k] if seen.shape[1] >= k else np.zeros(queries)
        more = ~scored & (bound > 0) & (bound >= floor[:, None] - 1e-9)
        self._score(found, dense, more)
        visited |= more
        out = []
        for q in range(queries):
            blocks = np.flatnonzero(visited[q])
            cosines = np.round(found[q, blocks].ravel(), 12)
            examples = (blocks[:, None] * self.block + np.arange(self.block)).ravel()
            keep = cosines > 0
            if keep.sum() > k:
                keep &= cosines >= np.partition(cosines, len(cosines) - k)[len(cosines) - k]
            examples, cosines = self.order[examples[keep]], np.minimum(cosines[keep], 1.0)
            best_first = np.lexsort((examples, -cosines))[:k]
            out.append((examples[best_first], cosines[best_first]))
        return out

    def _score(self, found: np.ndarray, dense: np.ndarray, wanted: np.ndarray) -> None:
        """Add the common terms' part to the sums of the wanted (query, block) pairs."""
        for b in np.flatnonzero(wanted.any(axis=0)):
            queries = np.flatnonzero(wanted[:, b])
            found[queries, b] += dense[queries] @ self.rows[b].T


@dataclass
class ToxicityModel:
    config: ToxicityConfig
    terms: Terms | None
    weights: np.ndarray              # idf * class weight of every term
    unknown: float                   # of a word that no example holds
    telling: frozenset               # beginnings that are terms
    index: BlockMaxIndex | None
    example_ids: list[int]
    labels: np.ndarray
    stands_for: np.ndarray           # labelled rows per example of its class
    prior: float                     # toxic share of the labelled rows
    tells: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))   # terms of class weight 1
    plain_prior: float = 0.0         # toxic share (smoothed) of the labelled rows without such terms
    _heads: frozenset = field(default=frozenset(), repr=False)

    def __post_init__(self):
        self._heads = frozenset(t[:3] for t in self.telling)

    def vectors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, weight) of the unit vectors of all texts, by text and term."""
        words, number, text = cut_words(texts)
        text, word, n = counted(number, text, len(words))
        numbers = self.terms.find(words)
        held = numbers[word]
        value = (1 + np.log(n)) * np.where(held >= 0, self.weights[held], self.unknown)
        norm = np.bincount(text, value * value, len(texts))
        text_, term_, value_ = text[held >= 0], held[held >= 0], value[held >= 0]
        # beginnings: occurrences of all words that begin so
        begun = [(i, b) for i, w in enumerate(words) if w[:3] in self._heads for b in beginnings(w, self.config.prefixes) if b in self.telling]
        if begun:
            of = np.array([i for i, _ in begun])
            term = self.terms.find([b for _, b in begun])
            # (text, word) rows of the words with a beginning, once per beginning
            slots = np.argsort(of, kind="stable")
            per_word = np.bincount(of, minlength=len(words))
            first = np.cumsum(per_word) - per_word
            rows = np.flatnonzero(per_word[word])
            many = per_word[word[rows]]
            stops = np.cumsum(many)
            at = np.repeat(first[word[rows]] - (stops - many), many) + np.arange(int(stops[-1]))
            keys, inverse = np.unique(np.repeat(text[rows], many) * len(self.weights) + term[slots[at]], return_inverse=True)
            total = np.bincount(inverse, np.repeat(n[rows], many))
            more = (1 + np.log(total)) * self.weights[keys % len(self.weights)]
            norm += np.bincount(keys // len(self.weights), more * more, len(texts))
            text_ = np.concatenate([text_, keys // len(self.weights)])
            term_ = np.concatenate([term_, keys % len(self.weights)])
            value_ = np.concatenate([value_, more])
            order = np.lexsort((term_, text_))
            text_, term_, value_ = text_[order], term_[order], value_[order]
        return text_, term_, value_ / np.sqrt(norm)[text_]

    def scores(self, texts: list[str]) -> list[tuple[float, list[tuple[int, float]]]]:
        """Score from 0 to 1 and the nearest examples (example, cosine) of every text."""
        if self.index is None:
            return [(self.plain_prior, [])] * len(texts)
        text, term, weight = self.vectors(texts)
        prior = np.where(np.bincount(text, self.tells[term], len(texts)) > 0, self.prior, self.plain_prior).tolist()
        out = []
        w = self.config.prior_weight * float(self.stands_for.mean())
        for lo in range(0, len(texts), BATCH):
            hi = min(lo + BATCH, len(texts))
            part = slice(*np.searchsorted(text, [lo, hi]))
            near = self.index.nearest(text[part] - lo, term[part], weight[part], hi - lo, self.config.neighbours)
            for (ids, cosines), p in zip(near, prior[lo:hi]):
                votes = (cosines / (1.01 - cosines)) ** 2 * self.stands_for[ids]
                share = float((votes * self.labels[ids]).sum())
                out.append(((share + w * p) / (float(votes.sum()) + w), list(zip(ids.tolist(), cosines.tolist()))))
        return out


def held_out(doc_id: str = "doc_id"):
    """True for rows whose crc32 of the id as text leaves 2 divided by 4 (NULL ids: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def g2(a, n1: int, b, n0: int):
    """Likelihood-ratio statistic of a term present in ``a`` of n1 and ``b`` of n0 rows (columns)."""
    def part(x, e):
        return F.when(x > 0, x * F.log(x / e)).otherwise(F.lit(0.0))
    p = (a + b) / F.lit(n1 + n0)
    return 2 * (part(a, n1 * p) + part(n1 - a, n1 * (1 - p)) + part(b, n0 * p) + part(n0 - b, n0 * (1 - p)))


def lower_bound(config: ToxicityConfig, terms: int) -> float:
    """Statistic for class weight 1: about one of ``terms`` terms that mean nothing reaches it."""
    return min(config.min_g2, NormalDist().inv_cdf(1 - 0.5 / max(terms, 2)) ** 2)


def _examples(docs: DataFrame, marked: DataFrame, config: ToxicityConfig) -> DataFrame:
    """(doc_id, _toxic, text) of the sampled labelled rows."""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = None
    for value in (0, 1):  # bounded: max_examples rows of each class
        part = marked.where(F.col("_toxic") == value).orderBy(*order).limit(config.max_examples)
        sample = part if sample is None else sample.unionByName(part)
    # one text per document id (repeated rows: the smallest text)
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
            .join(sample.select(F.col("doc_id").cast("long").alias("doc_id"), "_toxic"), "doc_id")
            .groupBy("doc_id").agg(F.min("text").alias("text"), F.first("_toxic").alias("_toxic")))
    rows = written(rows, "toxicity-sample")
    # of each class, the first texts of max_bytes together (at most max_examples sizes, without texts)
    sizes = rows.select("doc_id", "_toxic", F.octet_length("text").alias("_size"))
    so_far = F.sum("_size").over(Window.partitionBy("_toxic").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    kept = sizes.withColumn("_before", F.coalesce(so_far, F.lit(0))).where(F.col("_before") < config.max_bytes)
    return rows.join(kept.select("doc_id"), "doc_id", "left_semi")


def _counted_terms(rows: DataFrame, config: ToxicityConfig) -> DataFrame:
    """(doc_id, _toxic, term, tf) arrays of the examples: words, and all beginnings (marked)."""
    prefixes = config.prefixes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", SLICE):
            words, number, text = cut_words(batch.column("text").to_pylist())
            text, word, n = counted(number, text, len(words))
            begun = [beginnings(w, prefixes) for w in words]
            terms: list[dict[bytes, int]] = [{} for _ in range(batch.num_rows)]
            for t, w, c in zip(text.tolist(), word.tolist(), n.tolist()):
                for name in (words[w], *begun[w]):
                    terms[t][name] = terms[t].get(name, 0) + c
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "_toxic": batch.column("_toxic"),
                "term": pa.array([list(c) for c in terms], pa.list_(pa.binary())),
                "tf": pa.array([list(c.values()) for c in terms], pa.list_(pa.int32()))})
    return written(rows.mapInArrow(run, "doc_id long, _toxic int, term array<binary>, tf array<int>"), "toxicity-terms")


def fit(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> FittedModel:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).  Counts of the classes
    cover all labelled rows; terms and examples come from the bounded sample."""
    spark = docs.sparkSession
    prepare(spark)
    marked = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
              .groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("_toxic")))
    totals = {r["_toxic"]: r["n"] for r in marked.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    prior = totals.get(1, 0) / max(sum(totals.values()), 1)
    rows = _counted_terms(_examples(docs, marked, config), config)
    sizes = {r["_toxic"]: r["n"] for r in rows.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 + n0:
        return FittedModel(_empty(config, prior))
    counts = written(rows.select("_toxic", F.explode("term").alias("term")).groupBy("term").agg(
        F.sum("_toxic").alias("a"), F.count("*").alias("n")), "toxicity-counts")
    bound = lower_bound(config, counts.count())
    telling = [bytes(r["term"]) for r in counts
               .withColumn("g2", g2(F.col("a"), n1, F.col("n") - F.col("a"), n0)).where(
                   (F.col("g2") >= bound) & (F.col("a") * F.lit(n0) >= config.min_lift * (F.col("n") - F.col("a")) * F.lit(n1)))
               .orderBy(F.desc("g2"), "term").limit(config.max_terms).collect()] if n1 and n0 else []
    # all words, and the telling beginnings; bounded by the sample's bytes
    ends = F.expr("endswith(term, X'2A')")
    named = spark.createDataFrame([(bytearray(t),) for t in telling if t.endswith(b"*")], "term binary")
    wanted = counts.where(~ends).unionByName(counts.join(F.broadcast(named), "term", "left_semi"))  # at most max_terms rows
    pairs = rows.select("doc_id", "_toxic", F.filter(F.arrays_zip("term", "tf"), lambda e: ~F.endswith(e["term"], F.lit(b"*"))).alias("e"))
    pairs = pairs.select("doc_id", "_toxic", "e.term", "e.tf")
    if any(t.endswith(b"*") for t in telling):
        starred = (rows.select("doc_id", F.explode(F.arrays_zip("term", "tf")).alias("e")).select("doc_id", "e.*").where(ends)
                   .join(F.broadcast(named), "term").groupBy("doc_id").agg(F.collect_list("term").alias("_t"), F.collect_list("tf").alias("_n")))
        pairs = pairs.join(starred, "doc_id", "left").select(
            "doc_id", "_toxic", F.concat("term", F.coalesce("_t", F.array().cast("array<binary>"))).alias("term"),
            F.concat("tf", F.coalesce("_n", F.array().cast("array<int>"))).alias("tf"))
    folder = shared_folder(spark, "toxicity-model")

    def build(terms: pa.Table, examples: pa.Table) -> pa.Table:
        uri, out = open_output(folder, ".model")
        with out:
            pickle.dump(_build(terms, examples, config, telling, totals, sizes, prior), out, protocol=5)
        return pa.table({"uri": pa.array([uri])})
    # one task: the sample is bounded in rows and bytes, and neither it nor the index passes the driver
    one = F.lit(0).alias("_one")
    made = wanted.select(one, "term", "n").groupBy("_one").cogroup(
        pairs.where(F.size("term") > 0).select(one, "doc_id", "_toxic", "term", "tf").groupBy("_one")).applyInArrow(build, "uri string").head()
    return FittedModel(None, made["uri"]) if made else FittedModel(_empty(config, prior))


def _empty(config: ToxicityConfig, prior: float) -> ToxicityModel:
    return ToxicityModel(config, None, np.zeros(0), 0.0, frozenset(), None, [], np.zeros(0), np.zeros(0), prior, plain_prior=prior)


def _build(terms: pa.Table, examples: pa.Table, config: ToxicityConfig, telling: list[bytes], totals: dict, sizes: dict,
           prior: float) -> ToxicityModel:
    """The model from the sample's terms (term, n) and examples (doc_id, _toxic, term, tf)."""
    told = set(telling)
    named = terms.column("term").take(pc.sort_indices(terms, [("n", "descending"), ("term", "ascending")])).combine_chunks()
    held = terms.column("n").take(pc.sort_indices(terms, [("n", "descending"), ("term", "ascending")])).to_numpy()
    names = named.to_pylist()
    full = math.log(sum(sizes.values()) + 1)
    tells = np.array([t in told for t in names], bool)
    weights = (full - np.log(held + 1) + 1) * np.where(tells, 1.0, config.other_weight)
    data = examples.take(pc.sort_indices(examples, [("doc_id", "ascending")])).combine_chunks()
    lists = data.column("term").combine_chunks()
    number = pc.index_in(lists.flatten(), value_set=named).to_numpy(zero_copy_only=False).astype(np.int32)
    example = np.repeat(np.arange(data.num_rows, dtype=np.int32), lists.value_lengths().to_numpy(zero_copy_only=False))
    ids, toxic = data.column("doc_id").to_pylist(), data.column("_toxic").to_numpy().astype(float)
    value = (1 + np.log(data.column("tf").combine_chunks().flatten().to_numpy(zero_copy_only=False))) * weights[number]
    del data, lists
    value /= np.sqrt(np.bincount(example, value * value, len(ids)))[example]
    stands_for = np.array([totals.get(int(v), 0) / sizes[int(v)] for v in toxic])
    # labelled rows without telling terms
    told_1, told_0 = [float((stands_for * (toxic == v))[np.bincount(example, tells[number], len(ids)) > 0].sum()) for v in (1, 0)]
    plain = totals.get(1, 0) - told_1, totals.get(0, 0) - told_0
    index = BlockMaxIndex(example, number, value, len(ids), len(names), config.common, config.block) if ids else None
    return ToxicityModel(config, Terms(names), weights, (full + 1) * config.other_weight, frozenset(t for t in telling if t.endswith(b"*")),
                         index, ids, toxic, stands_for, prior, tells, (plain[0] + prior) / (sum(plain) + 1))


@dataclass
class FittedModel:
    """A fitted model: its file in the shared folder, or the model itself when nothing was learned."""
    held: ToxicityModel | None
    uri: str | None = None

    def load(self) -> ToxicityModel:
        """The model, read from its file.  Tasks let go of it when they end: idle workers of later
        stages should not hold it."""
        if self.uri is None:
            return self.held
        with open_input(self.uri) as source:
            return pickle.load(source)


EVIDENCE = "array<struct<doc_id:bigint,cosine:double,label:int>>"
_ARROW_EVIDENCE = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))


def score(df: DataFrame, fitted: FittedModel, column: str = "text", keep_text: bool = True) -> DataFrame:
    """Add score (double), predicted (int) and evidence (the nearest examples) to every row.  Tasks
    open the model's file; its size is bounded by max_examples, max_bytes and max_terms."""
    prepare(df.sparkSession)
    added = ("score", "predicted", "evidence")
    fields = [f for f in df.schema.fields if f.name not in added and (keep_text or f.name != column)]
    schema = T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()),
                           T.StructField("evidence", T._parse_datatype_string(EVIDENCE))])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = fitted.load()
        for batch in text_slices(batches, column, SLICE):
            got = m.scores([v or "" for v in batch.column(column).to_pylist()])
            proof = [[{"doc_id": m.example_ids[i], "cosine": s, "label": int(m.labels[i])}
                      for i, s in near[:m.config.evidence]] for _, near in got]
            yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in names} | {
                "score": pa.array([s for s, _ in got], pa.float64()),
                "predicted": pa.array([int(s >= m.config.threshold) for s, _ in got], pa.int32()),
                "evidence": pa.array(proof, _ARROW_EVIDENCE)})
        del m
        pa.default_memory_pool().release_unused()
    return df.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """Query form: learns from the labelled rows outside the held-out fold and scores every text."""
    model = fit(docs, labels.where(~held_out()), config)
    return score(docs.select("doc_id", "text", held_out().alias("held_out")), model, keep_text=False).select(
        "doc_id", "held_out", "score", "predicted", "evidence")

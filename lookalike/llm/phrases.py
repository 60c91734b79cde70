"""Operator 11: phrase collocation mining by HAT-trie counting.

Texts are cut into words with array operations over whole record batches, and the words of a task
get ids.  A task counts phrases in a ``HatTrie``: a shallow trie by word id whose children start as
hash containers (packed ids of the remaining words -> count); a container that grows beyond
``BURST`` entries bursts into a trie node with a container per next word.  When a task's tries hold
``MAX_ENTRIES`` entries (or too many words), they spill the largest subtrees whole, as runs sorted by
phrase, written to the shared folder.  The runs of all tasks are merged per prefix partition: a
partition holds the phrases whose first two words have one hash, so a word that begins a third of
all phrases is spread by the words that follow it.

What a trie counts is found before, in two passes over the texts that count hashes: of words and
pairs of words; then of phrases of three and four words whose pairs all reach ``min_count``.  The
hashes that reach it travel as a bitmap of a fixed size (``FILTER_BITS``).  A bit that is set without
need (hashes that collide) only means a phrase that is counted in vain, so counts stay exact whatever
the number of phrases.

Scores: a candidate (2 to 4 words, a occurrences) cut after its first k words into parts of l and r
occurrences scores floor(2000000 * a / (l + r)), in decimal arithmetic of 38 digits; the lowest
cut counts.  Candidates inside a longer one of at least ``inside_percent`` of their occurrences are
dropped, whether or not the longer one is dropped itself.

Edge cases: NULL texts have no words; a NULL language is ``und``, together with rows marked so;
repeated rows count each; a phrase never crosses the end of a piece; texts without words only
matter in that they add nothing; a language without candidates has no rows; ties in the order go
by occurrences, then by the phrase's UTF-8 bytes; very long words are words; extra columns don't
matter; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lookalike.llm.common import prepare, text_slices, written

MAX_WORDS = 4
SLICE = 4 << 20                    #: bytes of text that are cut into words at once
WORD_BITS = 21                     #: bits of a word id in a packed phrase; three ids fill a key
MASK = (1 << WORD_BITS) - 1
RUN_WORDS = 1 << 19                #: occurrences whose phrases are grouped before they enter the trie
MAX_KNOWN = 400_000                #: words a task numbers before it spills everything
BURST = 2048                       #: entries of a container before it becomes a node
MAX_ENTRIES = 600_000            #: entries of a task's tries before they spill
FILTER_BITS = 27                   #: the bitmap of frequent words and pairs has 2 ** 27 bits (16 MB)
KEY_BYTES = 5                      #: bytes of a hash that are sent beside its range
UNDEFINED = "und"

# Bytes that end a piece, and bytes between words.
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_BLANKS = b" \t"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)
_KIND[list(_BLANKS)] = 1
_KIND[list(_BREAKS)] = 2


def cut_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, word number of every occurrence, piece of every occurrence) of all texts;
    occurrences with equal piece numbers lie in one piece of one text."""
    whole = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts.fill_null(""))
    data = np.frombuffer(pc.binary_join(whole, "\n")[0].as_buffer(), np.uint8)
    kind = _KIND[data]
    word = kind == 0
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    piece = np.cumsum(kind == 2, dtype=np.int32)[first] if len(first) else np.empty(0, np.int32)
    ends = np.concatenate([[0], np.cumsum(last - first)]).astype(np.int64)
    flat = _LOWER[data[word]]
    words = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(flat)])
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), piece


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a pair from the hashes of its words."""
    out = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + b
    return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _bit(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - FILTER_BITS)


def is_set(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = _bit(hashes)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


class HatTrie:
    """Counts of phrases: word id -> container of packed further ids (node -> containers once burst);
    the counts of single words are the trie's own."""

    def __init__(self):
        self.ids: dict[bytes, int] = {}
        self.words: list[bytes] = [b""]    # word of every id; 0 stands for no word
        self.alone = np.zeros(1024, np.int64)
        self.children: dict[int, dict | Node] = {}
        self.sizes: dict[int, int] = {}    # entries below each first word
        self.entries = 0

    def number(self, words: list[bytes]) -> np.ndarray:
        """Ids of words (new ones get the next id)."""
        ids, known = self.ids, self.words
        out = np.empty(len(words), np.int64)
        for i, w in enumerate(words):
            got = ids.get(w)
            if got is None:
                got = ids[w] = len(known)
                known.append(w)
            out[i] = got
        if len(known) > len(self.alone):
            self.alone = np.append(self.alone, np.zeros(len(known), np.int64))
        return out

    def add(self, firsts: np.ndarray, rests: np.ndarray, counts: np.ndarray) -> None:
        """Add distinct phrases: id of the first word, the others packed (most significant first)."""
        single = rests == 0
        self.alone[firsts[single]] += counts[single]
        firsts, rests, counts = firsts[~single], rests[~single], counts[~single]
        if not len(firsts):
            return
        order = np.lexsort((rests, firsts))
        firsts, rests, counts = firsts[order], rests[order], counts[order]
        starts = np.flatnonzero(np.append(True, firsts[1:] != firsts[:-1]))
        stops = np.append(starts[1:], len(firsts))
        keys, values = rests.tolist(), counts.tolist()
        for first, lo, hi in zip(firsts[starts].tolist(), starts.tolist(), stops.tolist()):
            child, new = _grow(self.children.get(first), keys[lo:hi], values[lo:hi])
            self.children[first] = child
            self.sizes[first] = self.sizes.get(first, 0) + new
            self.entries += new

    def spill(self, keep: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Take out whole subtrees, the largest first, until at most ``keep`` entries stay, and the
        counts of single words."""
        held = np.flatnonzero(self.alone)
        yield held, np.zeros(len(held), np.int64), self.alone[held]
        self.alone[:] = 0
        for first in sorted(self.sizes, key=self.sizes.get, reverse=True):
            if self.entries <= keep:
                break
            for rests, counts in _walk(self.children.pop(first), 0, 2 * WORD_BITS):
                yield np.full(len(rests), first), rests, counts
            self.entries -= self.sizes.pop(first)


class Node(dict):
    """Burst container: next word id -> container."""


def _grow(child, keys: list[int], counts: list[int]):
    """(child with the entries added, number of new entries)."""
    if child is None:
        child = {}
    if isinstance(child, Node):
        new, lo = 0, 0
        while lo < len(keys):
            word, hi = keys[lo] >> 2 * WORD_BITS, lo
            while hi < len(keys) and keys[hi] >> 2 * WORD_BITS == word:
                hi += 1
            rest = [(k << WORD_BITS) & (1 << 3 * WORD_BITS) - 1 for k in keys[lo:hi]]
            child[word], more = _grow(child.get(word), rest, counts[lo:hi])
            new, lo = new + more, hi
        return child, new
    before = len(child)
    for k, c in zip(keys, counts):
        child[k] = child.get(k, 0) + c
    new = len(child) - before
    if len(child) > BURST and any(child):
        child, burst = Node(), sorted(child.items())
        _grow(child, [k for k, _ in burst], [c for _, c in burst])
    return child, new


def _walk(child, prefix: int, shift: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(packed ids, counts) of every container."""
    if isinstance(child, Node):
        for word, below in child.items():
            yield from _walk(below, prefix | word << shift, shift - WORD_BITS)
    else:
        keys, counts = (np.fromiter(x, np.int64, len(child)) for x in (child.keys(), child.values()))
        yield keys >> 2 * WORD_BITS - shift | prefix, counts


RUN = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])


def _runs(lang: str, trie: HatTrie, keep: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Spilled subtrees of a trie as sorted runs, with the hash of each phrase's prefix."""
    firsts, rests, counts = (np.concatenate(x) for x in zip(*trie.spill(keep)))
    table = pa.array(trie.words, pa.binary()).cast(pa.string())
    hashes = word_hashes(trie.words, lang)
    for lo in range(0, len(firsts), 1 << 18):
        part = slice(lo, lo + (1 << 18))
        ids = [firsts[part], *[(rests[part] >> WORD_BITS * (2 - i)) & MASK for i in range(MAX_WORDS - 1)]]
        used = [table.take(pa.array(i)) if not k else pc.if_else(pa.array(i > 0), table.take(pa.array(i)), pa.scalar(None, pa.string()))
                for k, i in enumerate(ids)]
        phrase = pc.binary_join_element_wise(*used, " ", null_handling="skip")
        batch = pa.RecordBatch.from_arrays([pa.array([lang] * len(phrase), pa.string()), pa.array(sum((i > 0).astype(np.int32) for i in ids)),
                                            phrase, pa.array(counts[part])], schema=RUN)
        order = pc.sort_indices(phrase)
        yield batch.take(order), mix(hashes[ids[0]], hashes[ids[1]])[order.to_numpy()]


def _blobs(run: pa.RecordBatch, prefixes: np.ndarray, parts: int) -> pa.RecordBatch:
    """(part, run): a sorted run cut by prefix partition, each part compressed."""
    part = (prefixes % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    run, part = run.take(pa.array(order)), part[order]
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist() if len(part) else []
    out = []
    for lo, hi in zip(first, [*first[1:], len(part)]):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, RUN, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_batch(run.slice(lo, hi - lo))
        out.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([pa.array(part[first], pa.int64()), pa.array(out, pa.binary())], names=["part", "run"])


def _pairs(ids: np.ndarray, piece: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of occurrences that the next one follows in the same piece, hash of those two)."""
    at = np.flatnonzero(piece[1:] == piece[:-1])
    return at, mix(hashes[ids[at]], hashes[ids[at + 1]])


def _longer(ids: np.ndarray, piece: np.ndarray, hashes: np.ndarray, bitmap: np.ndarray, starts: int):
    """Places (below ``starts``) and hashes of pairs, of three and of four words whose pairs are all
    in the bitmap."""
    at, hashed = _pairs(ids, piece, hashes)
    by_place = np.zeros(len(ids) + 3, np.uint64)
    by_place[at] = hashed
    good = np.zeros(len(ids) + 3, bool)
    good[at] = is_set(bitmap, hashed)
    two = np.flatnonzero(good[:starts])
    three = two[good[two + 1]]
    four = three[good[three + 2]]
    return ((two, by_place[two]), (three, mix(by_place[three], hashes[ids[three + 2]]) if len(three) else by_place[three]),
            (four, mix(by_place[four], by_place[four + 2])))


def _grams(ids: np.ndarray, piece: np.ndarray, hashes: np.ndarray, bitmap: np.ndarray, starts: int):
    """(first, rest, count) of the distinct phrases in the bitmap that begin at one of the first
    ``starts`` occurrences."""
    bits = 2 * WORD_BITS
    found, n = np.unique(ids[:starts], return_counts=True)
    good = is_set(bitmap, hashes[found])
    out = [(found[good], np.zeros(int(good.sum()), np.int64), n[good])]
    (at, _), (three, hashed_3), (four, hashed_4) = _longer(ids, piece, hashes, bitmap, starts)
    found, n = np.unique(ids[at] << WORD_BITS | ids[at + 1], return_counts=True)
    out.append((found >> WORD_BITS, (found & MASK) << bits, n))
    at = three[is_set(bitmap, hashed_3)]
    found, n = np.unique(ids[at] << bits | ids[at + 1] << WORD_BITS | ids[at + 2], return_counts=True)
    out.append((found >> bits, (found & (1 << bits) - 1) << WORD_BITS, n))
    at = four[is_set(bitmap, hashed_4)]
    heads, head = np.unique(ids[at] << WORD_BITS | ids[at + 1], return_inverse=True)
    found, n = np.unique(head << bits | ids[at + 2] << WORD_BITS | ids[at + 3], return_counts=True)
    pair = heads[found >> bits]
    out.append((pair >> WORD_BITS, (pair & MASK) << bits | found & (1 << bits) - 1, n))
    return tuple(np.concatenate(x) for x in zip(*out))


def _chunks(batches: Iterator[pa.RecordBatch]):
    """(lang, distinct words, their numbers in the slice, ids, pieces, hashes by id, starts) of runs of
    at most RUN_WORDS occurrences, each with the occurrences that phrases begun in it reach into.
    Ids count from 1."""
    for batch in text_slices(batches, "text", SLICE):
        langs = batch.column("lang")
        for lang in pc.unique(langs).to_pylist():
            words, found, piece = cut_words(batch.column("text").filter(pc.equal(langs, lang)))
            hashes = word_hashes(words.to_pylist(), lang)
            for lo in range(0, len(found), RUN_WORDS):
                hi = min(lo + RUN_WORDS, len(found))
                used, ids = np.unique(found[lo:hi + MAX_WORDS - 1], return_inverse=True)
                yield lang, words, used, ids + 1, piece[lo:hi + MAX_WORDS - 1], np.append(np.uint64(0), hashes[used]), hi - lo


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNDEFINED)).alias("lang"), F.col("text").cast("string").alias("text"))


def _pack(keys: np.ndarray) -> bytes:
    """The low KEY_BYTES bytes of every key."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def _unpack(blobs: pa.ChunkedArray) -> np.ndarray:
    data = np.frombuffer(b"".join(blobs.to_pylist()), np.uint8).reshape(-1, KEY_BYTES)
    out = np.zeros((len(data), 8), np.uint8)
    out[:, :KEY_BYTES] = data
    return out.view("<u8").ravel()


def _parts(df: DataFrame) -> int:
    """Ranges of hashes and prefix partitions: twice as many as shuffle partitions."""
    return 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def frequent_bitmap(docs: DataFrame, min_count: int, shorter=None) -> np.ndarray:
    """Bitmap of the hashes of words and pairs of words that occur ``min_count`` times; with a
    broadcast of that, of phrases of three and four words whose pairs all do.  Tasks send their counts
    by ranges of the hashes, packed: a range's keys are the KEY_BYTES bytes of the hash below the
    range's bits."""
    top = max(1, (_parts(docs) - 1).bit_length())   # bits that tell a range
    low = np.uint64(64 - top - 8 * KEY_BYTES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, ids, piece, hashes, starts in _chunks(batches):
            if shorter is None:
                at, hashed = _pairs(ids, piece, hashes)
                hashed = [hashes[ids[:starts]], hashed[at < starts]]
            else:
                hashed = [h for _, h in _longer(ids, piece, hashes, shorter.value, starts)[1:]]
            keys, n = np.unique(np.concatenate(hashed), return_counts=True)
            keys = keys >> low
            part = (keys >> np.uint64(8 * KEY_BYTES)).astype(np.int64)
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.empty(0, np.int64)
            rows = []
            for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(part)]):
                once = n[lo:hi] == 1
                rows.append((int(part[lo]), _pack(keys[lo:hi][once]), _pack(keys[lo:hi][~once]), n[lo:hi][~once].astype("<i8").tobytes()))
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["part", "once", "keys", "n"])

    def frequent(table: pa.Table) -> pa.Table:
        once, more = _unpack(table.column("once")), _unpack(table.column("keys"))
        n = np.frombuffer(b"".join(table.column("n").to_pylist()), "<i8")
        keys, at = np.unique(np.concatenate([once, more]), return_inverse=True)
        total = np.bincount(at, np.concatenate([np.ones(len(once)), n]), len(keys))
        hashes = (np.uint64(table.column("part")[0].as_py()) << np.uint64(8 * KEY_BYTES) | keys[total >= min_count]) << low
        return pa.table({"bit": pa.array(_bit(hashes).astype(np.int64))})

    cells = (_rows(docs).mapInArrow(count, "part long, once binary, keys binary, n binary").groupBy("part").applyInArrow(frequent, "bit long")
             .groupBy(F.shiftright("bit", 6).alias("cell"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask")).toArrow())  # bounded: cells of the bitmap
    out = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    out[cells.column("cell").to_numpy()] = cells.column("mask").to_numpy().view(np.uint64)
    return out


def runs(docs: DataFrame, bitmap) -> DataFrame:
    """(part, run): the sorted runs (lang, size, phrase, n) of the phrases that every task counted, by
    prefix partition, and a run of size 0 with the number of all words of a language.  ``bitmap``:
    broadcast of ``frequent_bitmap``."""
    parts = _parts(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, HatTrie] = {}
        totals: dict[str, int] = {}

        def spill(lang: str, keep: int) -> Iterator[pa.RecordBatch]:
            for run, prefixes in _runs(lang, tries[lang], keep):
                yield _blobs(run, prefixes, parts)
        for lang, words, used, ids, piece, hashes, starts in _chunks(batches):
            totals[lang] = totals.get(lang, 0) + starts
            insert(tries.setdefault(lang, HatTrie()), words, used, *_grams(ids, piece, hashes, bitmap.value, starts))
            if sum(len(t.words) for t in tries.values()) > MAX_KNOWN:
                for name in list(tries):
                    yield from spill(name, 0)
                    del tries[name]
            elif sum(t.entries for t in tries.values()) > MAX_ENTRIES:
                for name, t in tries.items():
                    yield from spill(name, t.entries // 2)
        for name in tries:
            yield from spill(name, 0)
        if totals:
            run = pa.RecordBatch.from_arrays([pa.array(list(totals)), pa.array([0] * len(totals), pa.int32()), pa.array([""] * len(totals)),
                                              pa.array(list(totals.values()))], schema=RUN)
            yield _blobs(run, np.concatenate([word_hashes([b""], lang) for lang in totals]), parts)

    def insert(trie: HatTrie, words: pa.Array, used: np.ndarray, firsts, rests, counts) -> None:
        """Phrases over the words ``used`` (numbered from 1), with the trie's own ids."""
        held = np.zeros(len(used) + 1, bool)
        held[firsts] = True
        for i in range(MAX_WORDS - 1):
            held[(rests >> WORD_BITS * i) & MASK] = True
        held[0] = False
        at = np.flatnonzero(held)
        ids = np.zeros(len(used) + 1, np.int64)
        ids[at] = trie.number(words.take(pa.array(used[at - 1])).to_pylist())
        packed = np.zeros(len(rests), np.int64)
        for i in range(MAX_WORDS - 1):
            packed |= ids[(rests >> WORD_BITS * i) & MASK] << WORD_BITS * i
        trie.add(ids[firsts], packed, counts)

    return written(_rows(docs).mapInArrow(count, "part long, run binary"), "phrase-runs")


def merged(spilled: DataFrame, min_count: int) -> DataFrame:
    """(lang, size, phrase, n): the runs merged per prefix partition; of phrases, those that reach
    ``min_count``."""
    def merge(table: pa.Table) -> pa.Table:
        held = pa.concat_tables([pa.ipc.open_stream(r.as_py()).read_all() for r in table.column("run")])
        sums = held.group_by(["lang", "size", "phrase"]).aggregate([("n", "sum")]).rename_columns(["lang", "size", "phrase", "n"])
        return sums.filter(pc.or_(pc.greater_equal(sums["n"], min_count), pc.equal(sums["size"], 0)))
    return spilled.groupBy("part").applyInArrow(merge, "lang string, size int, phrase string, n long")


def phrase_counts(docs: DataFrame, min_count: int = 30) -> tuple[DataFrame, DataFrame]:
    """((lang, size, phrase, n) of all phrases of 1 to 4 words with n >= min_count, (lang, n) of
    all words)."""
    spark = docs.sparkSession
    prepare(spark)
    bitmap = frequent_bitmap(docs, min_count)
    shorter = spark.sparkContext.broadcast(bitmap)   # 2 ** FILTER_BITS bits
    bitmap = spark.sparkContext.broadcast(bitmap | frequent_bitmap(docs, min_count, shorter))
    counts = written(merged(runs(docs, bitmap), min_count), "phrase-counts")
    return counts.where("size > 0"), counts.where("size = 0").select("lang", "n")


def collocations(docs: DataFrame, min_count: int = 30, inside_percent: int = 80, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language."""
    counts, totals = phrase_counts(docs, min_count)
    words = F.split("phrase", " ")
    candidates = counts.where("size >= 2").select("lang", "phrase", F.col("n").alias("a"), "size", words.alias("w"))
    part = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    cuts = (candidates.select("lang", "phrase", "a", "w", "size", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
            .select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right")))
    side = lambda name, value: counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(value))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    score = F.expr("(cast(a as decimal(38,0)) * 2000000BD) div (cast(l as decimal(20,0)) + r)").cast("bigint")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("c"))
    # contiguous parts of longer candidates
    inner = candidates.where("size >= 3").select("lang", F.col("a").alias("longer"), F.explode(F.expr(
        "flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), s -> array_join(slice(w, s, m), ' '))))")).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = scored.join(inner, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < inside_percent * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.select("lang", "phrase", "a", "c.l", "c.r", "c.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
           FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d),
w AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
      FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
c AS (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL),
t AS (SELECT lang, sum(n)::BIGINT AS n FROM c WHERE k = 1 GROUP BY lang),
f AS (SELECT * FROM c WHERE n >= 30),
x AS (SELECT lang, phrase, n AS a, k AS size, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
u AS (SELECT x.lang, x.phrase, x.a, x.size, x.w, k FROM x, (SELECT unnest([1, 2, 3]) AS k) WHERE k < x.size),
s AS (SELECT u.lang, u.phrase, u.a, u.k, fl.n AS l, fr.n AS r, ((2000000::HUGEINT * u.a) // (fl.n + fr.n))::BIGINT AS score
      FROM u JOIN f fl ON fl.lang = u.lang AND fl.phrase = array_to_string(u.w[1:u.k], ' ')
             JOIN f fr ON fr.lang = u.lang AND fr.phrase = array_to_string(u.w[u.k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, part, max(a) AS longer FROM (
        SELECT lang, a, unnest(list_transform(range(1, size - m + 2), lambda j: array_to_string(w[j:j + m - 1], ' '))) AS part
        FROM x, (SELECT unnest([2, 3]) AS m) WHERE m < size) GROUP BY lang, part),
o AS (SELECT b.* FROM b LEFT JOIN i ON i.lang = b.lang AND i.part = b.phrase WHERE i.longer IS NULL OR 100 * i.longer < 80 * b.a),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT k.lang, k.rank, k.phrase, k.a, k.l, k.r, t.n, k.score FROM k JOIN t ON t.lang = k.lang WHERE k.rank <= 2000
"""

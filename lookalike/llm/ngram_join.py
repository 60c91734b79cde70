"""Operator 4: exact n-gram Jaccard join with set-relation skipping.

A document is the set of its distinct word n-grams (64-bit hashes).  Documents with equal sets are
one class.  Between class representatives the join finds every link that can change a component:

1. Candidates.  Of each set a share of the hashes, the smallest ones, enters the index.  Two sets that
   reach the threshold share so many of them that, ordered by how many sets hold a token, they
   collide within a short prefix (see ``sample_size`` and ``prefix_size``); tokens of one set only
   fill the front of that order, so a document that shares little drops out without any list.
2. Index lists are skipped by block and position.  They are cut into blocks by set size, and an entry
   meets the block of its own sizes and the one below only; other blocks are skipped as no set in them
   can reach the threshold.  An entry knows the position of the token in its set's order: a pair
   whose shorter rest behind that position is below the overlap it needs is skipped, as the token is
   not the first they share, or they cannot reach the threshold.
3. Stars.  Each block has a leader, the entry with the fewest tokens of its own (the base text of
   a group of copies), then a random one.  Every entry is compared with its leaders: linear work in
   the list, and a group of copies becomes one component without pairs inside it.  Rounds go on until
   the pairs that are left in all lists are no more than ``LINEAR`` per entry, or hardly become fewer.
4. The rest of the pairs is derived from the leaders' answers: a pair within one component needs
   no check; for sets x, z compared with the same leader y, |x and z| is at most |y and z| + |x
   minus y|, so most pairs are skipped on those numbers; an exact bound from bitmaps (differing bits
   never exceed differing elements) skips nearly all others.  Only pairs that pass both are compared.

All comparisons that decide a link count the intersection of whole sets.

Edge cases: NULL, empty and blank texts have an empty set, link to nothing and are their own
component; fewer than n words make one n-gram of all of them; equal rows of one doc_id are one
document, rows with equal doc_id and different texts are all nodes of that id (their links join);
a NULL doc_id is a document of its own with a NULL component and is linked with nothing; extra
columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lookalike.llm.common import prepare, text_slices, with_partitions, written
from lookalike.functions.components import components as components_of

LEAST_SAMPLE = 30    #: percent of a set's tokens (the smallest hashes) that enter the index at least
BITS = 512           #: bits of a set's bitmap
LINEAR = 2           #: open pairs per entry of open lists that are left to the last step
SHRINKS = 0.8        #: a round of stars must leave this share of the open pairs at most, or it is the last
SLICE = 4 << 20      #: bytes of text that are cut into words at once
SALTS = 16           #: parts of a component's rows in the join with its smallest id
#: Entries of one list that the count of holders goes up to; the order needs no exact count beyond.
MOST_HOLDERS = 1 << 16
#: Ids that may be broadcast to select rows (8 bytes each); a shuffle join beyond.
BROADCAST_IDS = 1_000_000
#: Rows with a bitmap that may be broadcast (about 100 bytes each); a shuffle join beyond.
BROADCAST_BITMAPS = 100_000

# Odd multipliers that combine the hashes of consecutive words.
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def _kept(rounds: DataFrame) -> DataFrame:
    return written(rounds, "components")


def _ceil(a, b: int):
    return -(-a // b)


def sample_percent(percent: int) -> int:
    """Share of a set's tokens that enter the index: 10 points more than a pair of sets may differ by,
    so that two sets that reach the threshold always share sampled tokens."""
    if not 0 < percent <= 100:
        raise ValueError("percent must lie above 0 and at most at 100")
    return min(100, max(LEAST_SAMPLE, 110 - percent))


def sample_size(n: int, percent: int) -> int:
    return _ceil(sample_percent(percent) * n, 100)


def prefix_size(n: int, percent: int) -> int:
    """Sets x, z that reach the threshold t share at least (c + t - 1) * max(|x|, |z|) tokens of
    their samples (c the sampled share): of the set with the lower last sampled hash at least
    c|x| - (|x| - |x and z|) sampled tokens are common, and those are sampled in the other set too.
    So they collide in the first sample - needed + 1 tokens of any common order."""
    return sample_size(n, percent) - max(1, _ceil((sample_percent(percent) + percent - 100) * n, 100)) + 1


_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts, words up to the end of every text); words are runs without
    blanks, A-Z lower-cased."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw), np.uint8)
    inside = ~_BLANK[data]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ends = np.concatenate([[0], np.cumsum(last - first)]).astype(np.int64)
    flat = _LOWER[data[inside]]
    words = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(flat)]).dictionary_encode()
    distinct = words.dictionary.to_pylist()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))
    stops = np.cumsum(np.array([len(r) + 1 for r in raw], np.int64))
    return hashes[words.indices.to_numpy(zero_copy_only=False)], np.searchsorted(first, stops)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words."""
    out = np.full(len(hashes) - size + 1, (size * 0x9E3779B97F4A7C15 + 1) % (1 << 64), np.uint64)
    for i in range(size):
        out ^= out >> np.uint64(29)
        out *= np.uint64(_MULTIPLIERS[i % 4])
        out += hashes[i:len(hashes) - size + 1 + i]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def shingle_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-grams of words of every text; a text of fewer words has one,
    of all its words."""
    hashes, ends = word_hashes(texts)
    whole = shingles(hashes, n) if len(hashes) >= n else np.empty(0, np.uint64)
    out, lo = [], 0
    for hi in ends.tolist():
        if hi - lo >= n:
            out.append(np.unique(whole[lo:hi - n + 1]))
        else:
            out.append(shingles(hashes[lo:hi], hi - lo) if hi > lo else np.empty(0, np.uint64))
        lo = hi
    return out


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Parity of the tokens that fall on each of BITS bits, as 64-bit integers."""
    counts = np.bincount((tokens >> np.uint64(20)).astype(np.int64) % BITS, minlength=BITS)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def set_name(tokens: np.ndarray) -> int:
    """64-bit fingerprint of a set, which names it."""
    return struct.unpack("<q", xxhash.xxh3_64_digest(tokens.tobytes())[::-1])[0]


def signatures(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, n, rep, sample, bits) of every whole text; ``rep`` names the set."""
    sample_percent(percent)  # refuses thresholds out of range
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", SLICE):
            sets = shingle_sets([v or "" for v in batch.column("text").to_pylist()], n)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n": pa.array([len(t) for t in sets], pa.int64()),
                "rep": pa.array([set_name(t) for t in sets], pa.int64()),
                "sample": pa.array([t[:sample_size(len(t), percent)].view(np.int64) for t in sets], pa.list_(pa.int64())),
                "bits": pa.array([bitmap(t) for t in sets], pa.list_(pa.int64()))})
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n long, rep long, sample array<long>, bits array<long>")


def shared_tokens(postings: DataFrame) -> DataFrame:
    """(token, rep, n, holders) of the tokens that two sets or more hold.  ``postings`` (token, rep,
    n) are sorted within hash partitions and counted as they stream by: nothing but the entries of
    the current list up to MOST_HOLDERS is held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []   # pieces of the list that is still open
        open_token, size, flushed = None, 0, False

        def close() -> Iterator[pa.RecordBatch]:
            if size > 1 or flushed:
                yield from emit()

        def emit() -> Iterator[pa.RecordBatch]:
            for t, r, n in held:
                yield batch_of(t, r, n, np.full(len(t), MOST_HOLDERS if flushed else size))

        for batch in batches:
            token, rep, n = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "rep", "n")]
            if not len(token):
                continue
            first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            counts = np.diff(np.append(first, len(token)))
            if open_token is not None and token[0] == open_token:
                held.append((token[:counts[0]], rep[:counts[0]], n[:counts[0]]))
                size += int(counts[0])
                if size >= MOST_HOLDERS:
                    flushed = True
                    yield from emit()
                    held, size = [], 0
                if len(first) == 1:
                    continue
                first, counts = first[1:], counts[1:]
            if open_token is not None:
                yield from close()
            # whole lists inside this batch; the last one stays open
            inside = np.repeat(counts, counts)
            lo, hi = first[0], first[-1]
            keep = np.flatnonzero(inside[:hi - lo] > 1) + lo
            if len(keep):
                yield batch_of(token[keep], rep[keep], n[keep], inside[keep - lo])
            held, size, flushed, open_token = [(token[hi:], rep[hi:], n[hi:])], int(counts[-1]), False, token[-1]
        if open_token is not None:
            yield from close()

    def batch_of(token, rep, n, holders) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(token), pa.array(rep), pa.array(n), pa.array(holders.astype(np.int64))],
                                          names=["token", "rep", "n", "holders"])
    return with_partitions(postings, "token").sortWithinPartitions("token").mapInArrow(
        run, "token long, rep long, n long, holders long")


def size_band(n, percent: int):
    """Sizes of two sets that reach the threshold lie in the same or in neighbouring bands."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")


def needed(a, b, percent: int):
    """Smallest intersection of sets of sizes a, b that reaches the threshold."""
    return F.ceil((a + b) * percent / (100 + percent) - 1e-9)


def index_entries(reps: DataFrame, percent: int) -> DataFrame:
    """(token, rep, n, own, rest): index lists.  ``own``: the share of the set's sampled tokens that no
    other set holds; ``rest``: sampled tokens from this position of the set's order on."""
    postings = reps.where(F.col("n") > 0).select(F.explode("sample").alias("token"), "rep", "n")
    shared = shared_tokens(postings)
    by_rep = Window.partitionBy("rep")
    share = sample_percent(percent)
    sample = F.ceil(F.col("n") * share / 100 - 1e-9)
    prefix = sample - least_common(F.col("n"), F.col("n"), percent) + 1
    ranked = (shared.withColumn("own", sample - F.count("*").over(by_rep))
              .withColumn("at", F.col("own") + F.row_number().over(by_rep.orderBy("holders", "token"))))
    return ranked.where(F.col("at") <= prefix).select("token", "rep", "n", (F.col("own") / sample).alias("own"),
                                                      (sample - F.col("at") + 1).cast("int").alias("rest"))


def least_common(a, b, percent: int):
    """Sampled tokens that sets of sizes a, b share at least when they reach the threshold."""
    return F.greatest(F.lit(1), F.ceil(F.greatest(a, b) * (sample_percent(percent) + percent - 100) / 100 - 1e-9))


def in_reach(a: str, b: str, percent: int):
    """False where a token's positions in both sets leave too few tokens for a pair that shares no
    earlier one."""
    return F.least(f"rest{a}", f"rest{b}") >= least_common(F.col(f"n{a}"), F.col(f"n{b}"), percent)


def differing(a: str = "bits_a", b: str = "bits_b"):
    return sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(BITS // 64)), F.lit(0))


def _may_link(percent: int):
    """No bound rules the pair out: sizes, and differing bits against differing elements."""
    a, b = F.col("n_a"), F.col("n_b")
    return ((100 * F.least(a, b) >= percent * F.greatest(a, b))
            & (differing() <= a + b - 2 * needed(a, b, percent)))


def small(df: DataFrame, limit: int) -> DataFrame:
    """``df`` (a written table) as the broadcast side when it has at most ``limit`` rows."""
    return F.broadcast(df) if df.count() <= limit else df


def chosen(rows: DataFrame, ids: DataFrame, key: str = "rep") -> DataFrame:
    """Rows whose ``key`` is among ``ids`` (rep): by broadcast up to BROADCAST_IDS ids (counted),
    by a shuffle join beyond."""
    ids = small(ids.select(F.col("rep").alias("_rep")), BROADCAST_IDS)
    return rows.join(ids, rows[key] == ids["_rep"], "left_semi")


def compare(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, n_a, n_b, common, linked) of candidate pairs, from the whole sets (rep, tokens)."""
    sets = chosen(sets, written(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct(), "ngram-wanted"))
    left = sets.select(F.col("rep").alias("a"), F.col("tokens").alias("_ta"))
    right = sets.select(F.col("rep").alias("b"), F.col("tokens").alias("_tb"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("_ta", "_tb"))
    out = both.select("a", "b", F.size("_ta").alias("n_a"), F.size("_tb").alias("n_b"), common.alias("common"))
    return out.withColumn("linked", 100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common")))


def usable(signed: DataFrame) -> DataFrame:
    """Rows that can be linked, named by their set: those with an id and a set that isn't empty."""
    return signed.where((F.col("n") > 0) & F.col("doc_id").isNotNull())


def whole_sets(docs: DataFrame, ids: DataFrame, leaders: DataFrame, n: int) -> DataFrame:
    """(rep, tokens) of the sets named in ``ids`` (rep); ``leaders`` (rep, doc_id) names a document of each."""
    wanted = chosen(leaders, ids).select(F.col("doc_id").alias("rep"))
    rows = chosen(docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text")), wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", SLICE):
            sets = shingle_sets([v or "" for v in batch.column("text").to_pylist()], n)
            yield pa.RecordBatch.from_pydict({"rep": pa.array([set_name(t) for t in sets], pa.int64()),
                                              "tokens": pa.array([t.view(np.int64) for t in sets], pa.list_(pa.int64()))})
    return chosen(rows.mapInArrow(run, "rep long, tokens array<long>"), ids)


def class_links(docs: DataFrame, signed: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b): links between sets (named by their first fingerprint) whose components are those of
    all links.  Equal sets are one node, whatever the number of documents that hold them."""
    spark = docs.sparkSession
    full = usable(signed)
    leaders = written(full.groupBy("rep").agg(F.min("doc_id").alias("doc_id")), "ngram-classes")
    reps = chosen(full, leaders.select(F.col("doc_id").alias("rep")), "doc_id").select("rep", "n", "sample", "bits")
    # ids that repeat: some of their rows may stand for sets that other rows stand for, too
    repeated = bool(full.groupBy("doc_id").count().where("count > 1").head(1))
    one_each = (lambda df: df.dropDuplicates(["rep"])) if repeated else (lambda df: df)
    reps = one_each(reps)
    entries = written(index_entries(reps, percent).withColumn("band", size_band(F.col("n"), percent)), "ngram-index")
    ids = written(entries.select("rep").distinct(), "ngram-candidates")
    info = written(chosen(reps, ids).select("rep", "n", "bits"), "ngram-bitmaps")
    info = small(info, BROADCAST_BITMAPS)
    sets = None
    links = spark.createDataFrame([], "a long, b long")
    answers = spark.createDataFrame([], "a long, b long, n_a int, n_b int, common int, linked boolean")
    turn, labels, before = 0, None, math.inf
    while True:
        named = _named(entries, labels)
        if turn:
            named = written(named.join(_mixed(named), "token"), "ngram-named")
            open_ = _open_pairs(named)
            if open_ <= LINEAR * named.count() or open_ > SHRINKS * before:
                break
            before = open_
        # first the sets with the fewest tokens of their own lead, then a random one of each list:
        # a set that the base text misses meets about as many other sets as it has tokens
        order = F.struct("own", "n", "rep") if turn == 0 else F.struct(F.xxhash64("rep", "token", F.lit(turn)), F.col("n"), F.col("rep"))
        leader = named.groupBy("token", "band").agg(F.min(F.struct(order.alias("o"), F.col("rep"), F.col("component"), "n", "rest")).alias("x")).select(
            "token", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"), F.col("x.rep").alias("a"),
            F.col("x.component").alias("_ca"), F.col("x.n").alias("n_a"), F.col("x.rest").alias("rest_a"))
        pairs = named.join(leader, ["token", "band"]).where(
            (F.col("rep") != F.col("a")) & (F.col("component") != F.col("_ca")) & in_reach("", "_a", percent))
        pairs = pairs.select("a", F.col("rep").alias("b")).distinct()
        if turn:
            pairs = pairs.join(answers.select("a", "b"), ["a", "b"], "left_anti")
        turn += 1
        pairs = written(_with_info(pairs, info).where(_may_link(percent)).select("a", "b"), "ngram-stars")
        if not pairs.head(1):
            break
        if sets is None:
            sets = written(one_each(whole_sets(docs, ids, leaders, n)), "ngram-sets")
        compared = written(compare(pairs, sets, percent), "ngram-answers")
        answers = answers.unionByName(compared)
        links = links.unionByName(compared.where("linked").select("a", "b"))
        labels = written(components_of(links, keep=_kept), "ngram-labels")
    rest = written(_remaining(entries, labels, answers, info, percent), "ngram-rest")
    if rest.head(1):
        if sets is None:
            sets = written(one_each(whole_sets(docs, ids, leaders, n)), "ngram-sets")
        links = links.unionByName(compare(rest, sets, percent).where("linked").select("a", "b"))
    return links


def _named(entries: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``entries`` with the component of each set by the links found so far."""
    if labels is None:
        return entries.withColumn("component", F.col("rep"))
    labels = small(labels, BROADCAST_IDS)
    return entries.join(labels, entries["rep"] == labels["node"], "left").drop("node").withColumn(
        "component", F.coalesce("component", "rep"))


def _open_pairs(named: DataFrame) -> int:
    """Pairs of entries of one block that lie in different components."""
    own = named.groupBy("token", "band", "component").agg(F.count("*").alias("c"))
    lists = own.groupBy("token", "band").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("s"))
    return lists.agg(F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("s")) / 2), F.lit(0.0))).head()[0]


def _mixed(named: DataFrame) -> DataFrame:
    """(token): the lists whose entries are not all in one component."""
    return named.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("z")).where("x <> z").select("token")


def _with_info(pairs: DataFrame, info: DataFrame) -> DataFrame:
    side = lambda s: info.select(F.col("rep").alias(s), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b")


def _remaining(entries: DataFrame, labels: DataFrame | None, answers: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that no bound rules out and no star has compared."""
    # each set's answer from one leader (its smallest): overlap with it and its size
    leader = answers.groupBy("b").agg(F.min(F.struct("a", "common", "n_a")).alias("y")).select(
        F.col("b").alias("rep"), F.col("y.a").alias("y"), F.col("y.common").alias("with_y"))
    named = _named(entries, labels).drop("own")
    named = named.join(_mixed(named), "token").join(leader, "rep", "left").join(info.select("rep", "bits"), "rep")
    named = written(named, "ngram-open")
    columns = ("rep", "n", "rest", "component", "y", "with_y", "bits")
    a = named.select("token", "band", *[F.col(c).alias(f"{c}_a") for c in columns])
    # b is the smaller set of a pair (ties: the smaller name), so its block is a's or the one below
    b = named.select("token", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"),
                     *[F.col(c).alias(f"{c}_b") for c in columns])
    need = needed(F.col("n_a"), F.col("n_b"), percent)
    by_leader = (~F.col("y_a").eqNullSafe(F.col("y_b")) | F.col("y_a").isNull()
                 | ((F.col("with_y_b") + F.col("n_a") - F.col("with_y_a") >= need) & (F.col("with_y_a") + F.col("n_b") - F.col("with_y_b") >= need)))
    pairs = a.join(b, (a["token"] == b["token"]) & (a["band"] == b["band"]) & (F.struct("n_b", "rep_b") < F.struct("n_a", "rep_a"))
                   & (F.col("component_a") != F.col("component_b")) & in_reach("_a", "_b", percent) & by_leader & _may_link(percent))
    pairs = pairs.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct()
    done = answers.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.join(done, ["a", "b"], "left_anti")


def join_components(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; component_id is the smallest doc_id that
    links reach."""
    prepare(docs.sparkSession)
    signed = written(signatures(docs, n, percent), "ngram-signatures")
    links = class_links(docs, signed, n, percent)
    full = usable(signed).select("doc_id", "n", "rep")
    # rows of one doc_id belong together, whatever their texts
    several = full.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z")
    links = links.unionByName(full.join(several, "doc_id").where(F.col("rep") != F.col("a")).select("a", F.col("rep").alias("b")))
    labels = components_of(links, keep=_kept)
    members = full.join(labels, full["rep"] == labels["node"], "left").select(
        "doc_id", "n", F.coalesce("component", "rep").alias("component"))
    smallest = members.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    # a component may hold a third of all rows: its rows are dealt to SALTS parts, its smallest id to each
    smallest = smallest.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    members = members.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    linked = members.join(smallest, ["component", "_salt"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = signed.where((F.col("n") == 0) | F.col("doc_id").isNull()).select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component stays: the one with the smallest id (documents linked with
    nothing all stay; of rows repeated with one id, one stays)."""
    found = join_components(docs, n, percent).where(F.col("doc_id").isNotNull())
    found = found.select(F.col("doc_id").alias("_id"), "component_id").where(F.col("_id") == F.col("component_id")).select("_id").distinct()
    same = docs["doc_id"].cast("long") == found["_id"]
    kept = docs.join(found, same, "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
             lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d),
c AS (SELECT doc_id, len(g) AS n_shingles, g FROM s),
p AS (SELECT doc_id, n_shingles, unnest(g) AS t FROM c),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.t = b.t AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n_shingles, b.n_shingles
      HAVING 100 * count(*) >= 85 * (a.n_shingles + b.n_shingles - count(*))),
r AS (SELECT doc_id AS node, doc_id AS root FROM c
      UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node)
SELECT c.doc_id, any_value(c.n_shingles) AS n_shingles, min(r.root) AS component_id
FROM c JOIN r ON r.node = c.doc_id GROUP BY c.doc_id
"""

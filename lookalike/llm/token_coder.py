"""Operator 13: token-id files compressed by an adaptive context-mixing range coder.

Texts are encoded by a tokenizer, an end id closes every document, and the ids are written in
ascending doc_id order.  Ids are coded in blocks of up to ``BLOCK`` ids.  Every block starts from
the same state and has checksums of its own, so blocks are coded and decoded independently; a task
steps through ``LANES`` blocks side by side with array operations.

The model of a block mixes three predictions of the next id with weights that adapt:

    P(id) = w2 [id = a] + w1 [id = b] + w0 P0(id)

* a, order 2: the id that followed the last two ids; b, order 1: the id that followed the last one.
  Both come from hash tables whose entries carry a confidence (0 to 3), raised by hits, lowered by
  misses; an entry without confidence is replaced.
* The weights are looked up by both confidences and by whether a equals b, and move towards what
  happened (``RATE``).
* P0, order 0: a binary tree of counts over buckets of ids, most frequent ids of the group first.  The
  first 128 have buckets of their own; the others share buckets of 1/32 octave, uniformly inside.

The range coder (64-bit low, carry-less, 16-bit words) narrows its range by which prediction holds, and
further by P0 where neither does.  All arithmetic is on integers, so every machine
decodes alike.

File format, little-endian.  A file is a row of groups; a group holds whole documents and can be read
alone: ``HEADER`` (magic, documents, ids, ids per block, blocks, bytes and crc32 of the tables, bytes of the
payload), the tables deflated (doc_id and a null flag of every document, ids of every document, the
ids that occur by falling frequency, per block its words, crc32 of its payload and of its ids), then
the blocks' words.

Edge cases: a NULL or empty text is the end id alone; rows with a NULL doc_id come first; rows with
equal ids lie side by side, in the order of a hash of their texts, and are documents of their own; very long texts span
blocks; equal tables give equal ids, whatever the number of tasks; extra columns don't matter; an
empty table writes no file and gives an empty result.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lookalike.llm import pretokens
from lookalike.llm.bpe import SLICE, Remembered
from lookalike.llm.common import prepare, shared_folder, text_slices, written
from lookalike.llm.files import open_input, open_output

BLOCK = 4096                #: ids of a block at most
LANES = 2048                #: blocks that are coded side by side
GROUP_IDS = BLOCK * LANES   #: ids after which a group is closed (at the end of a document)
RATE = 4                    #: weights move by 1/16 of the error

MAGIC = b"IDG1"
HEADER = struct.Struct("<4sIQIIIIQ")

_WORD, _TOP, _BOTTOM = np.uint64(16), np.uint64(1 << 48), np.uint64(1 << 40)
_ONE = 4096                 # sum of the weights
_LEAST = 16                 # a weight never falls below
_LEVELS = 9                 # of the order-0 tree: 512 buckets
_OWN = 128                  # ids with a bucket of their own
_STEP = 3                   # added to a bucket's count when it is seen
_SLOTS = 12                 # bits of a hash table's index
# After a shift a range has 40 bits or more: 12 for the weights, 14 for the tree's counts (512 buckets,
# first counts and _STEP * BLOCK), 10 inside a bucket leave 4.


def _buckets(alphabet: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every rank, first rank of every bucket, bits inside every bucket)."""
    rank = np.arange(max(alphabet, 1))
    octave = np.maximum(np.floor(np.log2(np.maximum(rank, 1) / _OWN)).astype(int), 0)
    bucket = np.where(rank < _OWN, rank, _OWN + octave * 32 + ((rank - (_OWN << octave)) >> octave + 2))
    if bucket[-1] >= 1 << _LEVELS:
        raise ValueError("too many different ids for the order-0 tree")
    first = np.zeros(1 << _LEVELS, np.int64)
    first[bucket[::-1]] = rank[::-1]
    bits = np.zeros(1 << _LEVELS, np.int64)
    bits[bucket] = np.where(rank < _OWN, 0, octave + 2)
    return bucket, first, bits


def _first_tree(alphabet: int) -> tuple[np.ndarray, int]:
    """Counts before the first id: about 1 / (rank + 8).  Every inner node holds its left side's."""
    bucket, _, _ = _buckets(alphabet)
    weight = np.bincount(bucket, 500.0 / (np.arange(len(bucket)) + 8), 1 << _LEVELS)
    sums = np.zeros(2 << _LEVELS, np.int64)
    sums[1 << _LEVELS:] = np.maximum(weight.astype(np.int64), 1)
    for node in range((1 << _LEVELS) - 1, 0, -1):
        sums[node] = sums[2 * node] + sums[2 * node + 1]
    left = np.zeros(1 << _LEVELS, np.int64)
    left[1:] = sums[2:2 << _LEVELS:2]
    return left, int(sums[1])


class Lanes:
    """Range coder and model state of ``n`` blocks that are coded side by side."""

    def __init__(self, n: int, alphabet: np.ndarray, words: np.ndarray | None = None, most: int = BLOCK):
        """``words``: (n, w) words to decode; otherwise up to ``most`` ids per block are encoded."""
        self.alphabet = alphabet
        self.bucket, self.first, self.bits = _buckets(len(alphabet))
        self.rank = np.zeros(int(alphabet.max()) + 1 if len(alphabet) else 1, np.int64)
        self.rank[alphabet] = np.arange(len(alphabet))
        tree, total = _first_tree(len(alphabet))
        self.tree, self.total = np.tile(tree.astype(np.int32), (n, 1)).reshape(-1), np.full(n, total, np.int32)
        self.second = np.zeros(n << _SLOTS, np.int32)
        self.firsts = np.zeros(n << _SLOTS, np.int32)
        self.hit_a = np.full(n << 5, _ONE // 8, np.int32)
        self.hit_b = np.full(n << 5, _ONE // 8, np.int32)
        self.lane = np.arange(n)
        self.slots, self.states, self.trees = self.lane << _SLOTS, self.lane << 5, self.lane << _LEVELS
        self.last, self.older = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.low, self.range = np.zeros(n, np.uint64), np.full(n, ~np.uint64(0))
        self.decoding = words is not None
        if self.decoding:
            self.words = np.concatenate([words, np.zeros((n, 8), np.uint16)], axis=1)
            self.at = np.full(n, 4, np.int64)
            self.code = np.zeros(n, np.uint64)
            for i in range(4):
                self.code = self.code << _WORD | self.words[:, i].astype(np.uint64)
        else:
            self.words = np.zeros((n, 3 * most + 8), np.uint16)
            self.at = np.zeros(n, np.int64)

    def _shift(self, n: int) -> None:
        """Settle words of the first ``n`` lanes until their ranges are wide enough again."""
        low, wide, lanes = self.low[:n], self.range[:n], None
        while True:
            same = (low ^ (low + wide)) < _TOP
            narrow = wide < _BOTTOM
            go = np.flatnonzero(same | narrow)
            if not len(go):
                return
            low, wide = low[go], wide[go]
            wide = np.where(same[go], wide, -low & (_BOTTOM - np.uint64(1)))
            lanes = go if lanes is None else lanes[go]
            at = self.at[lanes]
            if self.decoding:
                self.code[lanes] = self.code[lanes] << _WORD | self.words[lanes, np.minimum(at, self.words.shape[1] - 1)]
            else:
                self.words[lanes, at] = low >> np.uint64(48)
            self.at[lanes] = at + 1
            low, wide = low << _WORD, wide << _WORD
            self.low[lanes], self.range[lanes] = low, wide

    def step(self, n: int, ids: np.ndarray | None) -> np.ndarray:
        """Code the next id of the first ``n`` lanes; ``ids`` are given for encoding."""
        last, mixed, mask = self.last[:n], self.last[:n] * 40503, (1 << _SLOTS) - 1
        slot_b = self.slots[:n] + (mixed >> 7 & mask)
        slot_a = self.slots[:n] + ((mixed ^ self.older[:n] * 60493) >> 5 & mask)
        entry_a, entry_b = self.second[slot_a], self.firsts[slot_b]
        a, b, sure_a, sure_b = entry_a >> 2, entry_b >> 2, entry_a & 3, entry_b & 3
        state = self.states[:n] + ((sure_a << 3) + (sure_b << 1) + (a == b))
        to_a, weight_b = self.hit_a[state], self.hit_b[state]
        to_b = to_a + 1 + ((_ONE - 2 - to_a) * weight_b >> 12)
        unit = self.range[:n] >> np.uint64(12)
        if ids is None:
            place = ((self.code[:n] - self.low[:n]) // unit).astype(np.int32)
            not_a, miss = place >= to_a, place >= to_b
            got = np.where(not_a, b, a).astype(np.int64)
        else:
            not_a, got = ids != a, ids
            miss = not_a & (ids != b)
        start = np.where(miss, to_b, to_a * not_a)
        width = np.where(miss, _ONE, np.where(not_a, to_b, to_a)) - start
        self.low[:n] += unit * start.view(np.uint32)
        self.range[:n] = unit * width.view(np.uint32)
        missed = np.flatnonzero(miss)
        if len(missed):
            known = self._order_0(missed, None if ids is None else self.rank[ids[missed]])
            if ids is None:
                got[missed] = self.alphabet[known]
        self._shift(n)
        # what happened moves the weights, the tables and the context
        self.hit_a[state] = np.maximum(to_a + ((~not_a * (_ONE - 1) - to_a) >> RATE), _LEAST)
        later = np.flatnonzero(not_a)
        weight_b = weight_b[later]
        self.hit_b[state[later]] = np.maximum(weight_b + ((~miss[later] * (_ONE - 1) - weight_b) >> RATE), _LEAST)
        fresh = got << 2
        for table, slot, entry, hit, sure in ((self.second, slot_a, entry_a, ~not_a, sure_a), (self.firsts, slot_b, entry_b, got == b, sure_b)):
            table[slot] = np.where(hit, entry + (sure < 3), np.where(sure > 0, entry - 1, fresh))
        self.older[:n] = last
        self.last[:n] = got
        return got

    def _order_0(self, lanes: np.ndarray, ranks: np.ndarray | None) -> np.ndarray:
        """Code ranks of ids by the order-0 tree of their lanes."""
        total, low = self.total[lanes], self.low[lanes]
        unit = self.range[lanes] // total.view(np.uint32)
        base = self.trees[lanes]
        at = base + 1
        below, size = np.zeros(len(lanes), np.int32), total
        if ranks is None:
            target = np.minimum((self.code[lanes] - low) // unit, (total - 1).view(np.uint32)).astype(np.int32)
        else:
            bucket = self.bucket[ranks]
        node = 1
        for level in range(_LEVELS - 1, -1, -1):
            left = self.tree[at]
            right = target - below >= left if ranks is None else bucket >> level & 1 == 1
            self.tree[at] = left + _STEP * ~right
            below += left * right
            size = np.where(right, size - left, left)
            node = 2 * node + right
            at = base + node
        self.total[lanes] = total + _STEP
        bucket = node - (1 << _LEVELS)
        bits = self.bits[bucket].view(np.uint64)
        inner = unit * size.view(np.uint32) >> bits
        low += unit * below.view(np.uint32)
        if ranks is None:
            offset = np.minimum((self.code[lanes] - low) // inner, (np.uint64(1) << bits) - np.uint64(1))
            ranks = self.first[bucket] + offset.view(np.int64)
        else:
            offset = (ranks - self.first[bucket]).view(np.uint64)
        self.low[lanes] = low + inner * offset
        self.range[lanes] = inner
        return ranks

    def finish(self) -> list[bytes]:
        """Words of every encoded block."""
        for i in range(4):
            self.words[self.lane, self.at] = self.low >> np.uint64(48)
            self.low <<= _WORD
            self.at += 1
        return [row[:n].astype("<u2").tobytes() for row, n in zip(self.words, self.at.tolist())]


def _cut(n: int) -> tuple[int, int]:
    """(ids per block, blocks) of a group of n ids: blocks get shorter where lanes would stay empty."""
    block = min(BLOCK, max(1024, -(-n // LANES)))
    return block, -(-n // block)


def encode_ids(ids: np.ndarray, alphabet: np.ndarray, block: int) -> list[bytes]:
    """Words of the blocks of ``ids``."""
    blocks, out = -(-len(ids) // block), []
    for lo in range(0, blocks, LANES):
        part = ids[lo * block:(lo + LANES) * block]
        n = -(-len(part) // block)
        last = len(part) - (n - 1) * block
        table = np.zeros(n * block, np.int64)
        table[:len(part)] = part
        table = np.ascontiguousarray(table.reshape(n, block).T)
        lanes = Lanes(n, alphabet, most=block)
        for t in range(block if n > 1 else last):
            active = n if t < last else n - 1
            lanes.step(active, table[t, :active])
        out += lanes.finish()
    return out


def decode_ids(words: list[bytes], n: int, alphabet: np.ndarray, block: int) -> np.ndarray:
    """The ``n`` ids of the blocks."""
    out = np.empty(n, np.int64)
    for lo in range(0, len(words), LANES):
        part = words[lo:lo + LANES]
        table = np.zeros((len(part), max(map(len, part)) // 2), np.uint16)
        for i, w in enumerate(part):
            table[i, :len(w) // 2] = np.frombuffer(w, "<u2")
        first = lo * block
        count = min(n - first, len(part) * block)
        last = count - (len(part) - 1) * block
        lanes = Lanes(len(part), alphabet, words=table)
        got = np.zeros((block, len(part)), np.int64)
        for t in range(block if len(part) > 1 else last):
            active = len(part) if t < last else len(part) - 1
            got[t, :active] = lanes.step(active, None)
        out[first:first + count] = got.T.reshape(-1)[:count]
    return out


def pack_group(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """Bytes of one group."""
    counts = np.bincount(ids)
    alphabet = np.argsort(-counts, kind="stable")[:np.count_nonzero(counts)]
    block, blocks = _cut(len(ids))
    words = encode_ids(ids.astype(np.int64), alphabet, block)
    plain = ids.astype("<u4")
    per_block = np.array([(len(w) // 2, zlib.crc32(w), zlib.crc32(plain[i * block:(i + 1) * block])) for i, w in enumerate(words)], "<u4")
    tables = zlib.compress(b"".join([
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(),
        np.array(lengths, "<u8").tobytes(), struct.pack("<I", len(alphabet)), alphabet.astype("<u4").tobytes(), per_block.tobytes()]))
    payload = b"".join(words)
    return HEADER.pack(MAGIC, len(doc_ids), len(ids), block, blocks, len(tables), zlib.crc32(tables), len(payload)) + tables + payload


def unpack_group(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, ids per document, ids) of one group; ValueError where a checksum differs."""
    magic, docs, n, block, blocks, size, crc, payload = HEADER.unpack_from(data)
    packed = data[HEADER.size:HEADER.size + size]
    if magic != MAGIC or zlib.crc32(packed) != crc or len(data) < HEADER.size + size + payload:
        raise ValueError("damaged group header")
    tables = zlib.decompress(packed)
    doc_ids = np.frombuffer(tables, "<i8", docs).tolist()
    null = np.frombuffer(tables, "u1", docs, 8 * docs)
    lengths = np.frombuffer(tables, "<u8", docs, 9 * docs).astype(np.int64)
    held, = struct.unpack_from("<I", tables, 17 * docs)
    alphabet = np.frombuffer(tables, "<u4", held, 17 * docs + 4).astype(np.int64)
    per_block = np.frombuffer(tables, "<u4", 3 * blocks, 17 * docs + 4 + 4 * held).reshape(blocks, 3)
    at, words = HEADER.size + size, []
    for i, (count, crc, _) in enumerate(per_block.tolist()):
        words.append(data[at:at + 2 * count])
        at += 2 * count
        if zlib.crc32(words[-1]) != crc:
            raise ValueError(f"damaged block {i}")
    ids = decode_ids(words, n, alphabet, block)
    plain = ids.astype("<u4")
    for i, crc in enumerate(per_block[:, 2].tolist()):
        if zlib.crc32(plain[i * block:(i + 1) * block]) != crc:
            raise ValueError(f"block {i} decodes to other ids")
    return [None if e else d for d, e in zip(doc_ids, null.tolist())], lengths, ids


# Ranges of code points whose classes (letter, digit, white space) are certain, so that
# pre-tokens are cut by array operations; texts with any other go to the tokenizer whole.
_CERTAIN = ((0, 0x530), (0x2000, 0x2070), (0x20A0, 0x20C0), (0x2100, 0x2400), (0x2500, 0x2C00), (0x3000, 0x9FFF), (0xAC00, 0xD7A4),
            (0xFF00, 0xFFEF), (0x1F300, 0x1FB00))


class Tokenizer:
    """A byte-level tokenizer of the tokenizers library for batches of texts: distinct pre-tokens are
    encoded once and remembered.  Strings of special tokens are ordinary text."""

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        import tokenizers

        self.plain = tokenizers.Tokenizer.from_str(model)
        self.plain.encode_special_tokens = True
        made = json.loads(model)
        # pre-tokens can be taken one by one only where nothing looks across them
        self.by_pretoken = made["normalizer"] is None and made["pre_tokenizer"] == {
            "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.known = Remembered()
        self.certain = np.zeros(0x110000, bool)
        for lo, hi in _CERTAIN:
            self.certain[lo:hi] = True

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for i in range(0, len(texts), 64):
            out += [np.array(e.ids, np.uint32) for e in self.plain.encode_batch_fast(texts[i:i + 64], add_special_tokens=False)]
        return out

    def _pretokens(self, tokens: list[bytes]) -> list[bytes]:
        out = []
        for i in range(0, len(tokens), 4096):
            got = self.plain.encode_batch_fast([t.decode() for t in tokens[i:i + 4096]], add_special_tokens=False)
            out += [np.array(e.ids, "<u4").tobytes() for e in got]
        return out

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text."""
        sure = [self.by_pretoken and (t.isascii() or bool(self.certain[np.frombuffer(t.encode("utf-32-le"), "<u4")].all())) for t in texts]
        found = pretokens.cut([t for t, s in zip(texts, sure) if s])
        ids, ends = pretokens.expand(found, self.known.all(found.distinct, self._pretokens))
        cut = iter(np.split(ids, ends[:-1]) if len(ends) else [])
        rest = iter(self._whole([t for t, s in zip(texts, sure) if not s]))
        return [next(cut) if s else next(rest) for s in sure]


_MADE: dict[int, Tokenizer] = {}


def _tokenizer(model: str) -> Tokenizer:
    """The tokenizer of a worker, made once from its JSON."""
    key = hash(model)
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Tokenizer(model)
    return _MADE[key]


def write_files(docs: DataFrame, model: str, folder: str, end: int = 0, group_ids: int = GROUP_IDS) -> DataFrame:
    """Encode every text of ``docs`` (doc_id, text) by the tokenizer whose JSON is ``model`` and write
    the ids to files below ``folder``, one per range of doc_id.  Returns the groups: (part, seq, file, offset,
    bytes, ids), in file order by (part, seq)."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)  # as large as the tokenizer's file
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # rows with equal ids go by the hash of their texts; rows that are equal in both are dealt by a row number
    keys = ["doc_id", F.xxhash64("text"), F.monotonically_increasing_id()]
    ranges = (rows.select("doc_id", "text", keys[1].alias("_hash"), keys[2].alias("_row"))
              .repartitionByRange(n, "doc_id", "_hash", "_row").sortWithinPartitions("doc_id", "_hash", "_row").select("doc_id", "text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, at, name, out = TaskContext.get().partitionId(), 0, 0, None, None
        tokenizer = _tokenizer(shared.value)
        doc_ids, lengths, held, size = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal seq, at, name, out, doc_ids, lengths, held, size
            if out is None:
                name, out = open_output(folder, ".ids")
            data = pack_group(doc_ids, lengths, np.concatenate(held))
            out.write(data)
            row = pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "file": pa.array([name]),
                "offset": pa.array([at], pa.int64()), "bytes": pa.array([len(data)], pa.int64()), "ids": pa.array([size], pa.int64())})
            seq, at, doc_ids, lengths, held, size = seq + 1, at + len(data), [], [], [], 0
            return row
        rows = []
        for batch in text_slices(batches, "text", SLICE):
            coded = tokenizer.encode_many([t or "" for t in batch.column("text").to_pylist()])
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), coded):
                doc_ids.append(doc_id)
                lengths.append(len(ids) + 1)
                held.append(np.append(ids, np.uint32(end)))
                size += len(ids) + 1
                if size >= group_ids:
                    rows.append(close())
        if doc_ids:
            rows.append(close())
        if out is not None:
            out.close()
        yield from rows  # reported when the file is whole
    return written(ranges.mapInArrow(write, "part int, seq int, file string, offset long, bytes long, ids long"), "id-groups")


def placed(groups: DataFrame) -> DataFrame:
    """Add ``start``, the ids of all groups before: a running sum inside each part and one over the
    parts' sums (one row per task that wrote)."""
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = groups.groupBy("part").agg(F.sum("ids").alias("_sum")).select("part", F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_before"))
    return (groups.withColumn("_inside", F.coalesce(F.sum("ids").over(inside), F.lit(0))).join(parts, "part")
            .withColumn("start", F.col("_before") + F.col("_inside")).drop("_before", "_inside"))


def read_files(groups: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, and ids as array<int> if asked for) of every document of
    the groups (file, offset, bytes, start); tasks read one group at a time."""
    n = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, offset, size, start in zip(*[batch.column(c).to_pylist() for c in ("file", "offset", "bytes", "start")]):
                with open_input(file) as source:
                    source.seek(offset)
                    doc_ids, lengths, ids = unpack_group(source.read(size))
                stops = np.cumsum(lengths)
                plain = ids.astype("<u4")
                sums = [zlib.crc32(plain[a:z]) for a, z in zip((stops - lengths).tolist(), stops.tolist())]
                columns = {"doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(start + stops - lengths), "n_tokens": pa.array(lengths),
                           "ids_crc32": pa.array(sums, pa.int64())}
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(np.append(0, stops), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(columns)
    dealt = groups.select("file", "offset", "bytes", "start").repartition(n, F.xxhash64("file", "offset"))
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


def round_trip(docs: DataFrame, model: str, end: int = 0) -> DataFrame:
    """Query form: write the ids of all texts and return the documents from the files."""
    groups = write_files(docs, model, shared_folder(docs.sparkSession, "ids"), end)
    return read_files(placed(groups))

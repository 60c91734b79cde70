"""Operator 3: byte-level BPE encoding and decoding through a SentencePiece model.

The rank file of a byte-level BPE vocabulary is serialised directly as a SentencePiece BPE model:
every byte b of a piece becomes the character U+0100+b, the score of a piece is its negative rank
(lower ranks merge first, as in the rank file), and the normaliser is the identity.  Texts are cut
into pre-tokens by the vocabulary's pattern, a slice of texts at a time; each distinct pre-token is
encoded on its own, and ids decode through the inverse mapping, so decoding returns the exact bytes of
the text.

Edge cases: NULL text counts as empty and gives no ids; a pre-token that is itself a piece gets
that piece's id without merging (as the rank format demands); repeated rows are encoded alike;
extra columns pass through untouched, and an output name that clashes with an input column
replaces it; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lookalike.llm import pretokens
from lookalike.llm.common import prepare, text_slices

#: Pre-tokens whose ids a worker remembers: those met since the memory last filled, and as many before.
CACHE_ENTRIES = 100_000
#: Bytes of text that are encoded at once.
SLICE = 4 << 20

# Fixed values of the SentencePiece model format: piece types and model type.
NORMAL, UNKNOWN = 1, 2
MODEL_BPE = 2


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank file (base64 piece, rank per line) as {piece: rank}."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _bytes_field(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def _int_field(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


_MAPPED = "".join(chr(256 + b) for b in range(256))


def byte_mapped(piece: bytes) -> str:
    """Each byte b as the character U+0100+b (one character per byte, none of them white space)."""
    return piece.decode("latin-1").translate(_MAPPED)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """Serialised SentencePiece BPE model; piece number rank+1 holds the piece of that rank."""
    by_rank = sorted(ranks, key=ranks.get)
    if [ranks[p] for p in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    pieces = [_bytes_field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _int_field(3, UNKNOWN)]
    for rank, piece in enumerate(by_rank):
        pieces.append(_bytes_field(1, byte_mapped(piece).encode()) + _varint(2 << 3 | 5)
                      + struct.pack("<f", -float(rank)) + _int_field(3, NORMAL))
    trainer = _int_field(3, MODEL_BPE) + _int_field(4, len(pieces))
    normalizer = _bytes_field(1, b"identity") + _int_field(3, 0) + _int_field(4, 0) + _int_field(5, 0)
    return b"".join(_bytes_field(1, p) for p in pieces) + _bytes_field(2, trainer) + _bytes_field(3, normalizer)


@dataclass
class ByteBPE:
    """Codec of one vocabulary: built from ranks, shipped to the tasks as (model, pieces, pattern)."""

    pattern: str
    model: bytes
    pieces: list[bytes]
    _state: tuple = field(default=(), repr=False, compare=False)

    @classmethod
    def from_ranks(cls, ranks: dict[bytes, int], pattern: str) -> ByteBPE:
        return cls(pattern, sentencepiece_model(ranks), sorted(ranks, key=ranks.get))

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBPE:
        return cls.from_ranks(read_ranks(path), pattern)

    def __getstate__(self):
        return {"pattern": self.pattern, "model": self.model, "pieces": self.pieces, "_state": ()}

    def _open(self) -> tuple:
        if not self._state:
            import regex
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_proto=self.model)
            ids = {p: struct.pack("<I", i) for i, p in enumerate(self.pieces)}
            findall = None if self.pattern == pretokens.PATTERN else regex.compile(self.pattern).findall
            self._state = (sp, findall, ids, Remembered(), pa.array(self.pieces, pa.large_binary()))
        return self._state

    def _cut(self, texts: list[str]) -> pretokens.Cut:
        findall = self._open()[1]
        if findall is None:
            return pretokens.cut(texts)
        known: dict[bytes, int] = {}
        number, ends = [], []
        for text in texts:
            number += [known.setdefault(t.encode(), len(known)) for t in findall(text)]
            ends.append(len(number))
        return pretokens.Cut(list(known), np.array(number, np.int64), np.array(ends, np.int64))

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, ids up to the end of every text)."""
        sp, _, ids, known, _ = self._open()
        found = self._cut(texts)

        def merge(tokens: list[bytes]) -> list[bytes]:
            # a pre-token that is a piece itself gets that piece's id without merging
            out = [ids.get(t) for t in tokens]
            open_ = [i for i, got in enumerate(out) if got is None]
            coded = sp.encode([byte_mapped(tokens[i]) for i in open_], out_type=int, num_threads=1)
            flat = (np.fromiter(chain.from_iterable(coded), np.uint32) - 1).astype("<u4").tobytes()
            at = 0
            for i, got in zip(open_, coded):
                out[i] = flat[at:at + 4 * len(got)]
                at += 4 * len(got)
            return out
        return pretokens.expand(found, known.all(found.distinct, merge))

    def encode_packed(self, text: str) -> bytes:
        """Ids of ``text`` as little-endian unsigned 32-bit integers."""
        return self.encode_many([text])[0].tobytes()

    def decode_many(self, ids: np.ndarray, ends: np.ndarray) -> list[memoryview]:
        """Bytes of every text from the ids of all."""
        taken = self._open()[4].take(pa.array(ids))
        stops = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1, 8 * taken.offset)[np.append(0, ends)]
        data = memoryview(taken.buffers()[2] or b"")
        return [data[a:z] for a, z in zip(stops[:-1].tolist(), stops[1:].tolist())]

    def decode_packed(self, ids: bytes) -> bytes:
        packed = np.frombuffer(ids, "<u4")
        return bytes(self.decode_many(packed, np.array([len(packed)]))[0])


class Remembered:
    """Ids of pre-tokens met before, in two generations of at most CACHE_ENTRIES: when the young one is
    full it becomes the old one, so pre-tokens that keep occurring are not forgotten."""

    def __init__(self):
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def all(self, tokens: list[bytes], make) -> list[bytes]:
        """Values of ``tokens`` (distinct ones); ``make`` gives those of a list of new ones."""
        young, old = self.young, self.old
        out = [young.get(t) for t in tokens]
        rest = [i for i, got in enumerate(out) if got is None]
        new = []
        for i in rest:
            got = out[i] = old.get(tokens[i])
            if got is None:
                new.append(i)
        if new:
            for i, got in zip(new, make([tokens[i] for i in new])):
                out[i] = got
        if len(young) + len(rest) > CACHE_ENTRIES:
            self.old = young
            young = self.young = {}
        if len(rest) <= CACHE_ENTRIES:
            young.update((tokens[i], out[i]) for i in rest)
        return out


def _texts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in text_slices(batches, column, SLICE):
        yield batch, [t or "" for t in batch.column(column).to_pylist()]


def _with_column(df: DataFrame, column: str, out: str, values, kind: T.DataType) -> DataFrame:
    """Append (or replace) column ``out`` = values(batch), an Arrow array, for slices of the rows."""
    fields = [f for f in df.schema.fields if f.name != out]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, column, SLICE):
            yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in names} | {out: values(batch.column(column).to_pylist())})
    return df.mapInArrow(run, T.StructType([*fields, T.StructField(out, kind)]))


def encode(df: DataFrame, codec: ByteBPE, column: str = "text", out: str = "ids", packed: bool = True) -> DataFrame:
    """Add ``out``: the ids of ``column``, as little-endian unsigned 32-bit integers in a binary
    (``packed``) or as array<int>.  The codec is broadcast; its size is that of the vocabulary file."""
    prepare(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(codec)

    def ids(texts: list[str | None]) -> pa.Array:
        flat, ends = shared.value.encode_many([t or "" for t in texts])
        bounds = np.append(0, ends).astype(np.int32)
        if not packed:
            return pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat.view(np.int32)))
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(4 * bounds), pa.py_buffer(flat)])
    return _with_column(df, column, out, ids, T.BinaryType() if packed else T.ArrayType(T.IntegerType()))


def decode(df: DataFrame, codec: ByteBPE, column: str = "ids", out: str = "decoded") -> DataFrame:
    """Add binary ``out``: the bytes that the packed ids of ``column`` stand for."""
    prepare(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(codec)
    return _with_column(df, column, out, lambda packed: pa.array([shared.value.decode_packed(p or b"") for p in packed], pa.binary()), T.BinaryType())


def round_trip(df: DataFrame, codec: ByteBPE) -> DataFrame:
    """Query form: doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text; a task encodes a
    slice of texts, decodes the ids again and keeps the digests alone."""
    prepare(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _texts(batches, "text"):
            ids, ends = shared.value.encode_many(texts)
            first = np.append(0, ends[:-1])
            data = memoryview(ids).cast("B")
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_tokens": pa.array(ends - first),
                "ids_sha256": pa.array([hashlib.sha256(data[4 * a:4 * z]).hexdigest() for a, z in zip(first.tolist(), ends.tolist())], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(d).hexdigest() for d in shared.value.decode_many(ids, ends)], pa.string())})
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

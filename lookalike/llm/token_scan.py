"""Operator 1: token counts of documents in flat token files, by separator scan.

A token file is nothing but ids, little-endian unsigned 16-bit integers, each document ended by a
separator id.  Blocks of a file are scanned independently: one vectorised comparison finds the
separators of a block, which gives the lengths of the documents that lie whole inside it, the
tokens before its first and after its last separator.  A prefix scan over the blocks of a file
(documents ended before the block, tokens of a document that is still open) then stitches the
documents that cross block boundaries: a scan inside runs of ``scan_blocks`` blocks, and one over
the totals of the runs, so no task holds all blocks of a long file.

Edge cases: an empty document is a lone separator and counts 0 tokens; a document longer than a
block gets its tokens from all blocks it crosses; tokens after the last separator form a last
document only when there are any; an empty file has no documents; NULL texts count as empty; rows
with equal ids are documents of their own; extra columns don't matter; an empty table writes no
file and gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lookalike.llm.bpe import SLICE, ByteBPE
from lookalike.llm.common import prepare, shared_folder, text_slices, written
from lookalike.llm.files import byte_ranges, open_input, open_output

TOKEN_BYTES = 2
BLOCK_BYTES = 1 << 20
SCAN_BLOCKS = 4096


def write_token_files(docs: DataFrame, codec: ByteBPE, separator: int, folder: str, ids: str = "doc_id",
                      column: str = "text") -> DataFrame:
    """Encode every whole text into flat token files below ``folder``; returns (file, bytes,
    doc_ids), the ids of a file's documents in their order."""
    if separator >= 1 << 16 or len(codec.pieces) >= 1 << 16:
        raise ValueError("ids must fit into 16 bits")
    if 0 <= separator < len(codec.pieces):
        raise ValueError("the separator must not be an id of the vocabulary")
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(codec)  # as large as the vocabulary file

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, size, order = None, None, 0, []
        for batch in text_slices(batches, "text", SLICE):
            packed, ends = shared.value.encode_many([t or "" for t in batch.column("text").to_pylist()])
            if out is None:
                name, out = open_output(folder, ".tokens")
            out.write(np.insert(packed, ends, separator).astype("<u2").tobytes())
            size += TOKEN_BYTES * (len(packed) + len(ends))
            order += batch.column("doc_id").to_pylist()
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": pa.array([name]), "bytes": pa.array([size], pa.int64()),
                                              "doc_ids": pa.array([order], pa.list_(pa.int64()))})
    rows = docs.select(F.col(ids).cast("long").alias("doc_id"), F.col(column).cast("string").alias("text"))
    return written(rows.mapInArrow(write, "file string, bytes long, doc_ids array<long>"), "token-files")


def scan_block(tokens: np.ndarray, separator: int) -> tuple[int, int, int, np.ndarray]:
    """(separators, tokens before the first, tokens after the last, lengths between separators);
    without a separator all tokens are both before and after."""
    at = np.flatnonzero(tokens == separator)
    if not len(at):
        return 0, len(tokens), len(tokens), np.empty(0, np.int64)
    return len(at), int(at[0]), len(tokens) - int(at[-1]) - 1, np.diff(at) - 1


def scan_blocks(files: DataFrame, separator: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, block, n_sep, before, after, inner): one row per block of every file."""
    if block_bytes % TOKEN_BYTES:
        raise ValueError("blocks must hold whole tokens")
    prepare(files.sparkSession)
    kinds = pa.schema([("file", pa.string()), ("block", pa.int64()), ("n_sep", pa.int64()), ("before", pa.int64()),
                       ("after", pa.int64()), ("inner", pa.list_(pa.int64()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, block, start, stop in zip(*[batch.column(c).to_pylist() for c in ("file", "block", "start", "stop")]):
                with open_input(uri) as source:
                    source.seek(start)
                    tokens = np.frombuffer(source.read((stop - start) // TOKEN_BYTES * TOKEN_BYTES), "<u2")
                n, before, after, inner = scan_block(tokens, separator)
                yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([block]), pa.array([n]), pa.array([before]),
                                                  pa.array([after]), pa.array([inner], pa.list_(pa.int64()))], schema=kinds)
    return byte_ranges(files.select("file", "bytes"), block_bytes).mapInArrow(
        scan, "file string, block long, n_sep long, before long, after long, inner array<long>")


def stitch(blocks: DataFrame, scan_blocks: int = SCAN_BLOCKS) -> DataFrame:
    """(file, position, n_tokens) of every document from the rows of ``scan_blocks``: prefix scan
    of (documents ended so far, tokens of the document still open)."""
    blocks = blocks.withColumn("run", F.floor(F.col("block") / scan_blocks))
    by_run = Window.partitionBy("file", "run").orderBy("block")
    so_far = by_run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # inside a run: separators before the block; tokens left open by the blocks since the last separator
    blocks = blocks.withColumn("ended", F.sum("n_sep").over(so_far) - F.col("n_sep"))
    blocks = blocks.withColumn("segment", F.sum((F.col("n_sep") > 0).cast("int")).over(so_far) - (F.col("n_sep") > 0).cast("int"))
    in_segment = Window.partitionBy("file", "run", "segment").orderBy("block")
    # a segment: the blocks after one with a separator, up to the next one with a separator
    blocks = blocks.withColumn("open_here", F.when(F.col("n_sep") > 0, F.lit(0)).otherwise(F.col("after")))
    blocks = blocks.withColumn("left", F.last(F.when(F.col("n_sep") > 0, F.col("after")), ignorenulls=True).over(
        by_run.rowsBetween(Window.unboundedPreceding, -1)))
    blocks = blocks.withColumn("open", F.coalesce(F.sum("open_here").over(in_segment.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
                               + F.coalesce("left", F.lit(0)))
    # over the runs of a file: their separators, and what they leave open
    runs = blocks.groupBy("file", "run").agg(
        F.sum("n_sep").alias("n"), F.sum(F.when(F.col("left").isNull() & (F.col("segment") == 0), F.col("open_here"))).alias("plain"),
        F.max_by(F.when(F.col("n_sep") > 0, F.col("after")).otherwise(F.col("open") + F.col("after")), "block").alias("tail"))
    over = Window.partitionBy("file").orderBy("run")
    runs = runs.withColumn("run_ended", F.coalesce(F.sum("n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    runs = runs.withColumn("run_segment", F.coalesce(F.sum((F.col("n") > 0).cast("int")).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = Window.partitionBy("file", "run_segment").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("run_left", F.last(F.when(F.col("n") > 0, F.col("tail")), ignorenulls=True).over(
        over.rowsBetween(Window.unboundedPreceding, -1)))
    runs = runs.withColumn("run_open", F.coalesce(F.sum(F.when(F.col("n") == 0, F.col("plain")).otherwise(F.lit(0))).over(within), F.lit(0))
                           + F.coalesce("run_left", F.lit(0)))
    blocks = blocks.join(runs.select("file", "run", "run_ended", "run_open"), ["file", "run"])
    first = F.col("segment") == 0  # no separator in this run before the block: the runs before also count
    opened = F.col("open") + F.when(first, F.col("run_open")).otherwise(F.lit(0))
    lengths = F.concat(F.array(opened + F.col("before")), F.col("inner"))
    ends = (blocks.where(F.col("n_sep") > 0)
            .select("file", (F.col("run_ended") + F.col("ended")).alias("at"), F.posexplode(lengths).alias("i", "n_tokens"))
            .select("file", (F.col("at") + F.col("i")).alias("position"), "n_tokens"))
    # tokens after the last separator of a file
    last = runs.groupBy("file").agg(F.max_by(F.struct((F.col("run_ended") + F.col("n")).alias("position"), (
        F.col("tail") + F.when(F.col("n") > 0, F.lit(0)).otherwise(F.col("run_open"))).alias("n_tokens")), "run").alias("x"))
    return ends.unionByName(last.select("file", "x.position", "x.n_tokens").where(F.col("n_tokens") > 0))


def count_tokens(files: DataFrame, separator: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, position, n_tokens) of every document of the token files (file, bytes)."""
    blocks = written(scan_blocks(files, separator, block_bytes), "token-blocks")
    return stitch(blocks)


def document_token_counts(docs: DataFrame, codec: ByteBPE, separator: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Query form: write token files of every text, scan them, and name the documents: doc_id,
    position (in its file), n_tokens."""
    files = write_token_files(docs, codec, separator, shared_folder(docs.sparkSession, "tokens"))
    names = files.select("file", F.posexplode("doc_ids").alias("position", "doc_id"))
    counts = count_tokens(files, separator, block_bytes)
    # a row per document on both sides: few bytes on disk, but too many rows for the driver to broadcast
    return counts.join(names.hint("merge"), ["file", "position"]).select("doc_id", F.col("position").cast("bigint"), F.col("n_tokens").cast("bigint"))

"""Operator 6: line deduplication with levelled sorted runs of line hashes.

``LineRuns`` keeps, in the shared folder, runs of rows (key hash, first holder, documents of its
batch), each bucketed and sorted by the hash.  A new batch of documents is reduced to its distinct
(hash, document) pairs and merge-anti-joined with the runs: hashes that no run holds form the
batch's own run on level 0, the others go to the repeats.  When a level holds ``fanout`` runs, they
are merged into one run of the next level, so a store of n batches has about fanout * log(n) runs.

Batches are ranges of document ids, added from the largest ids down, so the first holder of a key
is the largest document that holds it.  Once all batches are in, keys held by at least ``min_docs``
documents lose their lines everywhere but in the first holder.

A line's key is the line without blanks at both ends, with A-Z in lower case; keys below
``min_chars`` code points are never dropped.  Edge cases: NULL or empty text is one empty line and
stays as empty text; lines repeated within a document count once and go together; repeated rows of
one doc_id count as one document and all lose or keep their lines alike; a NULL doc_id counts as
one document below all others; extra columns don't matter; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lookalike.llm.common import prepare, shared_folder, text_or_empty, written

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWEST = -(1 << 63)


def line_key(line):
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def occurrences(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """(h, doc, row, positions): where the lines of each row hold each key; one row per key and text."""
    lines = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("doc"),
        F.xxhash64(text_or_empty()).alias("row"), F.posexplode(F.split(text_or_empty(), "\n")).alias("pos", "line"))
    return (lines.withColumn("key", line_key("line")).where(F.char_length("key") >= min_chars)
            .groupBy(F.unhex(F.md5("key")).alias("h"), "doc", "row")
            .agg(F.array_distinct(F.collect_list("pos")).alias("positions")))


@dataclass
class LineRuns:
    """Store of line hashes: sorted runs by level (tables bucketed by the hash).  ``save`` leaves a
    manifest in the store's folder; ``open`` goes on from it in a later session."""

    spark: SparkSession
    fanout: int = 4
    levels: list[list[str]] = field(default_factory=list)
    name: str = field(default_factory=lambda: f"line_runs_{uuid.uuid4().hex}")
    written_runs: int = 0

    def __post_init__(self):
        prepare(self.spark)
        self.folder = shared_folder(self.spark, self.name)
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions", "200"))

    def _write(self, run: DataFrame) -> str:
        """One sorted file per bucket; the table's files lie in the shared folder."""
        self.written_runs += 1
        table = f"{self.name}_{self.written_runs}"
        (run.repartition(self.buckets, "h").write.bucketBy(self.buckets, "h").sortBy("h").format("parquet")
         .option("path", f"{self.folder}/{table}").saveAsTable(table))
        return table

    def runs(self) -> DataFrame | None:
        """All runs together; a hash is in one of them at most."""
        out = None
        for table in (t for level in self.levels for t in level):
            one = self.spark.table(table)
            out = one if out is None else out.unionByName(one)
        return out

    def unseen(self, pairs: DataFrame) -> DataFrame:
        """Rows of ``pairs`` whose hash no run holds (one merge anti-join per run)."""
        for level in self.levels:
            for table in level:
                pairs = pairs.join(self.spark.table(table).select("h"), "h", "left_anti")
        return pairs

    def add(self, keys: DataFrame) -> None:
        """Add the hashes of a batch, (h, doc, n_docs) with one row per hash, that no run holds yet."""
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self._write(self.unseen(keys)))
        self._compact()

    def _compact(self) -> None:
        for i, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                merged = None
                for table in level:
                    one = self.spark.table(table)
                    merged = one if merged is None else merged.unionByName(one)
                if i + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[i + 1].append(self._write(merged))
                for table in level:
                    self.spark.sql(f"DROP TABLE {table}")  # the files stay: readers may still be at work
                level.clear()

    def save(self) -> str:
        """Write the manifest of the runs (levels, buckets); returns the folder that ``open`` takes."""
        text = json.dumps({"name": self.name, "fanout": self.fanout, "buckets": self.buckets, "levels": self.levels, "written_runs": self.written_runs})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/manifest")
        return self.folder

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> LineRuns:
        """The store saved in ``folder``: its tables are registered again over their files."""
        held = json.loads(spark.read.text(f"{folder}/manifest").head()[0])
        store = cls(spark, held["fanout"], held["levels"], held["name"], held["written_runs"])
        store.folder, store.buckets = folder, held["buckets"]
        for table in (t for level in store.levels for t in level):
            spark.sql(f"CREATE TABLE IF NOT EXISTS {table} (h BINARY, doc BIGINT, n_docs BIGINT) USING parquet "
                      f"CLUSTERED BY (h) SORTED BY (h) INTO {store.buckets} BUCKETS LOCATION '{folder}/{table}'")
        return store

    def close(self) -> None:
        """Forget the tables (the files lie in the checkpoint folder, which its owner clears)."""
        for level in self.levels:
            for table in level:
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.levels.clear()


def batch_edges(docs: DataFrame, batches: int) -> list[int]:
    """Ascending ids that cut the documents into at most ``batches`` ranges of about equal size."""
    cuts = docs.select(F.percentile_approx(F.col("doc_id").cast("long"),
                                           [i / batches for i in range(1, batches)], 1000)).first()[0]
    return sorted(set(cuts or []))


def dropped_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 3,
                  fanout: int = 2) -> tuple[DataFrame, LineRuns]:
    """(doc, row, dropped): positions of the lines that go, and the store (close it after use)."""
    spark = docs.sparkSession
    prepare(spark)
    edges = batch_edges(docs, batches)
    marked = occurrences(docs, min_chars).withColumn(
        "batch", sum([(F.col("doc") >= F.lit(e)).cast("int") for e in edges], F.lit(0)))
    path = shared_folder(spark, "line-occurrences")
    marked.write.partitionBy("batch").parquet(path)
    found = spark.read.schema(marked.schema).parquet(path)
    store = LineRuns(spark, fanout)
    counts = None
    for batch in range(len(edges), -1, -1):  # largest ids first
        own = found.where(F.col("batch") == batch)
        # a document counts once for a key however many rows it has; first holder: largest id
        keys = own.select("h", "doc").distinct().groupBy("h").agg(
            F.max("doc").alias("doc"), F.count("*").alias("n_docs"))
        keys = written(keys, "line-keys")
        counts = keys if counts is None else counts.unionByName(keys)
        store.add(keys)
    totals = counts.groupBy("h").agg(F.sum("n_docs").alias("n")).where(F.col("n") >= min_docs)
    # written first: a join of two plain exchanges lets Spark split the partition of a very common line
    holders = written(store.runs().select("h", F.col("doc").alias("holder")).join(totals, "h"), "line-holders")
    gone = found.join(holders, "h").where(F.col("doc") != F.col("holder"))
    return gone.groupBy("doc", "row").agg(F.flatten(F.collect_list("positions")).alias("dropped")), store


def drop_repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, **options) -> DataFrame:
    """``docs`` with repeated lines removed from ``text``, plus n_lines and n_dropped.

    The lines of a text that stay keep their order; where nothing is dropped the text is unchanged
    (a NULL text becomes empty)."""
    gone, store = dropped_lines(docs, min_chars, min_docs, **options)
    store.close()  # what goes is in written tables of its own
    keep = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    rows = docs.select(*keep, text_or_empty().alias("text"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("_doc"),
                       F.xxhash64(text_or_empty()).alias("_row"))
    out = (rows.join(gone.select(F.col("doc").alias("_doc"), F.col("row").alias("_row"), F.col("dropped").alias("_dropped")),
                     ["_doc", "_row"], "left")
           .withColumn("_lines", F.split("text", "\n"))
           .withColumn("n_lines", F.size("_lines").cast("bigint"))
           .withColumn("n_dropped", F.coalesce(F.size("_dropped"), F.lit(0)).cast("bigint")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_dropped"))
    text = F.when(F.col("_dropped").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n"))
    return out.withColumn("text", text).select(*[c if c != "text" else F.col("text") for c in docs.columns
                                                 if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")


def digest(docs: DataFrame, **options) -> DataFrame:
    """Query form: doc_id, n_lines, n_dropped, kept_sha256."""
    out = drop_repeated_lines(docs.select("doc_id", "text"), **options)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
repeated AS (
  SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.pos, k.line, (r.key IS NOT NULL AND k.doc_id <> r.holder) AS gone
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

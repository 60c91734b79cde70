"""Corpus pipeline: toxicity, line dedup, n-gram Jaccard join, mixing, byte-level BPE.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and reread as the next one's docs.  All stages but the last
return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lookalike.llm import bpe, line_dedup, ngram_join, raking, toxicity
from lookalike.llm.common import prepare, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near-duplicates of the pipeline: word 5-grams, similarity of 0.8 or more.
WORDS, PERCENT = 5, 80


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold; learns from the labels of the
    documents at hand, outside the held-out fold."""
    prepare(spark)
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out())
    scored = toxicity.score(docs.select(*COLUMNS), toxicity.fit(docs, labels))
    return scored.where(F.col("predicted") == 0).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 code points or more that three documents hold stay in one of them only;
    documents left without any text go."""
    prepare(spark)
    kept = line_dedup.drop_repeated_lines(docs.select(*COLUMNS))
    kept = kept.where((F.col("n_dropped") == 0) | (F.btrim("text", F.lit(line_dedup.BLANKS)) != ""))
    return kept.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-copies."""
    prepare(spark)
    return ngram_join.keep_one(docs.select(*COLUMNS), WORDS, PERCENT).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by the probabilities raked to source, language and topic targets."""
    prepare(spark)
    return raking.mix(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, and the ids as array<int>."""
    prepare(spark)
    codec = bpe.ByteBPE.from_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = bpe.encode(docs.select("doc_id", "text", "lang", "source"), codec, packed=False)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", remove_toxic),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode),
]

#: Scores of nearest neighbours and the raked sample are not SQL; tests hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each one's result written and read again."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "pipeline")
    return docs

"""Queries of the operators and of the pipeline, over whole tables, with production parameters."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lookalike.llm import bpe, graph_ann, line_dedup, manifest, merkle, ngram_join, phrases, pii, raking, token_coder, token_scan, toxicity, warc
from lookalike.llm.common import table


#: Id that ends a document in token files; the vocabulary leaves it free.
END_OF_DOCUMENT = 50256


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = bpe.ByteBPE.from_file(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return token_scan.document_token_counts(table(spark, sf_dir, "documents"), codec, END_OF_DOCUMENT)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = bpe.ByteBPE.from_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.round_trip(table(spark, sf_dir, "documents"), codec)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(table(spark, sf_dir, "documents"), n=4, percent=85)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(table(spark, sf_dir, "documents"))


def op8_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_ann.nearest(table(spark, sf_dir, "embeddings"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raking.digest(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.digest(table(spark, sf_dir, "documents"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        model = f.read()
    return token_coder.round_trip(table(spark, sf_dir, "documents"), model, end=0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_warc, op3_byte_level_bpe, op4_ngram_jaccard_join, op5_toxicity, op6_line_dedup,
                                  op7_document_fingerprints, op8_nearest_vectors, op9_mixing,
                                  op10_pii, op11_phrases, op12_merkle_manifest, op13_token_files, pipeline)}
ORACLE_SQL = {"op2_warc": warc.SQL, "op4_ngram_jaccard_join": ngram_join.SQL, "op6_line_dedup": line_dedup.SQL, "op7_document_fingerprints": merkle.SQL,
              "op11_phrases": phrases.SQL, "op12_merkle_manifest": manifest.SQL}

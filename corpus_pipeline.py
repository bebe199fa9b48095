"""A pipeline over the documents table, made of five of the training-data operators.

Stages, in order: quality rules (what they reject goes), MinHash near-dedup on shingles of
five words (one document of each group stays), suffix-array dedup (bytes covered by a
100-byte string that also starts earlier go), mixing sources to target weights (a text
becomes the words that the mix takes), BPE encoding and decoding.  Each stage is written as
Parquet in the cluster's shared folder and read again, so a lost executor costs no more
than part of one stage; what a stage wrote on its way is removed when its result is written.
All but the last return the columns of documents.

Defined results: a null text has no words, so the quality rules reject it; a null doc_id is
kept, is no copy of another and comes first in the order of repeats; a null lang is a stratum
and a null source a source of its own; rows that are equal count as one document for
near-dedup (one stays); different texts under one doc_id are documents of their own but
for near-dedup, where any of them links all; columns besides those of documents, whatever
their names, are carried by all stages but the last; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quizloom.llm import bpe, mixing, neardup, quality, suffixes
from quizloom.llm.common import forget, scratch, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that neither the base rule nor a risk-controlled cutoff rejects."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    return neardup.one_of_each(docs)


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents less the bytes that also start earlier."""
    return suffixes.without_repeats(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mixing.mix_documents(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document."""
    return bpe.round_trip(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", repeat_dedup),
    ("mixing sources to target weights", mixing_sources),
    ("BPE encoding and decoding", bpe_encoding),
]

#: Trained cutoffs, draws and a vocabulary's merges aren't for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before = docs
        with scratch() as keep:
            docs = keep(written(stage(spark, before, sf_dir)))
        if hasattr(before, "written_to"):
            forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)

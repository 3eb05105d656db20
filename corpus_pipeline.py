"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, source mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. run() writes each
stage's result as Parquet to the shared folder and reads it again as the next one's docs. As a stage's result is written before
the next stage begins, each stage first clears the intermediate tables of the one before.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from studyloom.llm import bpe, jaccard_join, line_dedup, mixing, quality
from studyloom.llm.common import Scratch, made, read, release

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality.stage(spark, docs)


def line_chunks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated multi-line chunks."""
    return line_dedup.stage(spark, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its five-word shingles."""
    return jaccard_join.stage(spark, docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.stage(spark, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document of the mix."""
    return bpe.encode_decode(docs, bpe.byte_bpe())


_before: list[str] = []


def _alone(stage: Stage) -> Stage:
    """The stage, which first clears the tables that the stage before has made."""

    @functools.wraps(stage)
    def work(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(_before)
        there = made()
        out = stage(spark, docs, sf_dir)
        _before[:] = [root for root in made() if root not in there]
        return out

    return work


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", _alone(quality_rules)),
    ("line_dedup", _alone(line_chunks)),
    ("ngram_jaccard_join", _alone(near_duplicates)),
    ("mixing_sources", _alone(source_mix)),
    ("bpe_encode_decode", _alone(encode)),
]

#: The quality fit, the rolling hashes and the tokenizer have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep, docs = Scratch(spark), read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep.save(stage(spark, docs, sf_dir), name)
    return docs

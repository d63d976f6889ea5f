"""The corpus pipeline: stages in order over documents, each an operator of gyrolake.llm."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gyrolake.llm.mixing import mix
from gyrolake.llm.near_copies import drop_near_copies
from gyrolake.llm.packing import pack
from gyrolake.llm.quality_rules import keep_good
from gyrolake.llm.templates import drop_recurring_lines
from gyrolake.plans.staging import staged

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SHINGLE, RADIUS, SIMILAR = 5, 4, 0.8
BOILERPLATE_DOCS = 10  # documents of a line from which it is boilerplate; copies of fewer documents are left whole for near_dedup
MIX_SEED = 11


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed and the certified rules keep; the others go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines whose template recurs in BOILERPLATE_DOCS documents, this not the first of them."""
    return drop_recurring_lines(docs, min_docs=BOILERPLATE_DOCS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: fingerprints and minima of five-word shingles propose, an exact similarity decides."""
    return drop_near_copies(docs, SHINGLE, RADIUS, SIMILAR)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated so that all sources have like shares of as many rows as came in."""
    return mix(docs, seed=MIX_SEED)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences, with their ids."""
    return pack(docs, TOKENIZER, with_ids=True)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: SQL cannot express the fingerprints and token ids; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each reading what the one before it wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = staged(docs, name) if k < len(STAGES) - 1 else docs
    return docs

"""A corpus pipeline of five stages; each is written as Parquet and read again before the next.

Defined cases, for every stage: null, empty or wordless texts fail the quality rules and come no further, but a stage
that is given such rows handles them (near duplicates and decontamination keep them, the mix takes them as often as their
source's place in its order says, the token output has their end id alone). Null languages and sources are values of
their own. Rows that repeat are judged alike, kept together and each written; rows of one doc_id and different texts are
one node for near duplicates. A null doc_id is linked with nothing. Ties go to the least doc_id. An empty
table gives an empty result, and columns beyond those of documents, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sourcelake.llm import decontam, jaccard, mixing, quality, tokens
from sourcelake.llm.entry import table, tokenizer_path
from sourcelake.llm.shared import Workspace


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken."""
    return mixing.mix_rows(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and per row of the mix its place in them."""
    return tokens.token_table(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source mix", source_mix),
    ("token output", token_output),
]

#: The quality, Jaccard, decontamination and token stages are no SQL; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = space.keep(stage(spark, docs, sf_dir), f"stage{i}")
    return docs

"""The corpus pipeline: five stages over ``documents``. Each takes (spark, docs, sf_dir) and works on what the one before has kept.

All stages but the last return the columns of documents, extra ones too, whatever their names. A stage says what becomes of nulls, empty and very long texts, ties and
repeated rows; texts are read whole in all of them, and an empty table gives an empty result.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from nestflow.llm import decontam, mixing, neardup, token_store, toxicity
from nestflow.llm.common import Workspace


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below one half.

    A null text counts as an empty one; a document without an id or a label is scored like others; equal texts get equal scores, so repeated rows stay or go together. Without both kinds of labels
    the score is the share of toxic ones.
    """
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, on shingles of five words at a similarity of 0.8 or more: the one with the least id.

    A document without an id, or with a null or blank text, stays. Of rows with equal id and text one stays; rows that share an id but not a text are judged apart.
    """
    return neardup.dedup(docs, width=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item.

    A null or blank text has no window and stays. Rows are judged by their texts, so repeated rows stay or go together, with an id or without.
    """
    return decontam.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, that is not at all, once or twice.

    A null source is a source of its own; a blank text has size 0 and is taken by its hash like others. Rows with equal id, source and text are taken or left together.
    """
    return mixing.apply_mix(docs)


def store_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns what they hold of each document: doc_id, start, n_tokens, ids_crc32.

    A null text is the end id alone; documents without an id come first; rows with one id stand in the order of hashes of their texts.
    """
    return token_store.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("source_mix", mix_sources),
    ("token_store", store_tokens),
]

#: SQL cannot train the classifier; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written as Parquet and read again."""
    ws, docs = Workspace(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, ws.keep(stage(spark, docs, sf_dir))
        ws.drop(before)
    return docs

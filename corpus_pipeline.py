"""The corpus pipeline: language ID, near-dedup, mixing to target weights, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the docs of
the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import tidewatch
from tidewatch.llm import common, language_id, mixing, near_dedup, packing


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no known language: texts that are null or hold no letter, and those the codes can't decide on.

    The model learns from the labelled documents that aren't held out. Without any label there is nothing to decide by:
    every text with a letter stays. Kept documents are unchanged, repeated rows and extra columns too, whatever their
    names; a null doc_id isn't held out. An empty table gives an empty one.
    """
    tidewatch.ship(spark)
    model = language_id.fit(docs.where(~language_id.held_out(docs["doc_id"])))
    if model is None:
        return docs.where(docs["text"].rlike(r"\p{L}"))
    labelled = language_id.predict(docs, model)
    return labelled.where("lang_pred <> 'und' AND NOT ambiguous").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates (five-word shingles, similarity 0.8).

    Null texts stay, empty texts are one group, of rows repeated whole one stays; null doc_ids come after all others where
    one of a group is chosen. Extra columns stay, whatever their names. An empty table gives an empty one.
    """
    tidewatch.ship(spark)
    return near_dedup.deduplicate(docs, threshold=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources share the words by weights 1, 2, 3, at most three times their own.

    A null source is a source of its own; null and empty texts have no words and are drawn at their source's rate.
    Repeated rows are drawn each for itself. Extra columns stay, whatever their names. An empty table gives an empty one.
    """
    tidewatch.ship(spark)
    return mixing.mix(docs, weights=(1, 2, 3), cap=3)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack whole documents into sequences of 2048 tokens; one row per piece.

    Null and empty texts are the end id alone. Repeated rows and null doc_ids are packed each for itself. Extra columns
    are ignored. An empty table gives an empty result.
    """
    tidewatch.ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048, held=50_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The language model, the sketches and the tokenizer have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

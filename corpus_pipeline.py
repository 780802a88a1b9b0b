"""The corpus pipeline: language ID, exact dedup, near dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from editpairs.llm.common import shared_dir, written
from editpairs.llm.exact_dedup import without_copies
from editpairs.llm.language_id import known_language
from editpairs.llm.mixing import mix, with_tree
from editpairs.llm.near_join import one_of_each
from editpairs.llm.packing import packed_sequences
from editpairs.llm.tokens import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models know, with docs' columns, whatever their names.

    Texts that are null or have no letter go, and so does what no learned language explains. Rows with a null
    doc_id, source or lang are judged by their text alike; repeated rows fare alike; an empty table, or one
    without a labelled text, gives an empty one.
    """
    return known_language(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for A-Z's case the row with the largest doc_id, with docs' columns.

    A null text is empty; a null doc_id counts as the smallest; of rows that repeat both, one stays; an empty
    table gives an empty one.
    """
    return without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of similar texts, the one of the least doc_id, with docs' columns.

    A text without a word is similar to none and stays; a null doc_id counts as the least; among equal ids the
    least hash of the text decides; an empty table gives an empty one.
    """
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, to the target weights; a document of a short source comes once an epoch, with docs' columns.

    Null lang and source count as names of their own; a text without a token (null, empty) is never taken;
    repeated rows count each; an empty table gives an empty one.
    """
    return mix(written(with_tree(docs, tokenizer_path("word_bpe_49k.json")), "token-counts")).select("doc.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences; a null or empty text is its end id, rows that repeat an id are packed each, an empty table gives no piece."""
    return packed_sequences(docs, tokenizer_path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL can't express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    path = shared_dir(spark, f"stage-{STAGES[-1][0]}")
    STAGES[-1][1](spark, docs, sf_dir).write.parquet(path)
    return spark.read.parquet(path)

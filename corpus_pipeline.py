"""The corpus pipeline: language ID, line dedup, near dedup, mixing to target weights, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept, written as Parquet and read again.
All stages but the last return the columns of documents; the last adds the ids of each text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plethora.llm import bpe, language_id, line_dedup, minhash, mixing
from plethora.llm.common import settled, table

#: Similarity of shingle sets, in percent, from which the near_dedup stage takes texts for copies.
NEAR = 80


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which the classifier, trained on the labelled rows, finds a language; texts without letters and rejected ones go.

    Null, empty and letterless texts go; without any labelled row all documents go. Repeated rows and rows with null or equal
    ids are judged one by one. Columns of any name pass through; an empty table stays empty.
    """
    return language_id.accepted(docs, language_id.fit(docs))


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents share; such a line stays in the document with the largest id.

    A null text stays null and an empty one empty; a document that loses all its lines stays with an empty text. Repeated rows
    count as documents of their own, rows that tie on the largest id all keep the line, a null id is below all others. Columns
    of any name pass through; an empty table stays empty.
    """
    return line_dedup.drop_lines(docs)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, of ties the first in the table.

    Null, empty and wordless texts are copies of nothing and all stay. Repeated rows are copies; null ids come last. Columns of
    any name pass through; an empty table stays empty.
    """
    return minhash.one_of_each(docs, percent=NEAR)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources come near their target shares, in a global shuffle.

    A null source is a source of its own; a source without any text keeps each document once. Rows with equal ids get equal
    numbers of copies, rows without an id those of their text. Columns of any name pass through; an empty table stays empty.
    """
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents and ids, the tokens of each whole text, which are decoded again and held against it.

    Null and empty texts have no ids. Ids, ties and repeated rows have no effect; a column named ids is replaced, others pass
    through; an empty table stays empty. The job fails on a text that its ids don't give back.
    """
    return bpe.encode_column(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, verify=True)


STAGES = [
    ("language_id", known_language),
    ("line_dedup", distinct_lines),
    ("near_dedup", distinct_texts),
    ("mixing", mixed_sources),
    ("bpe", encoded),
]

#: SQL can't express the classifier, the signatures or the merges; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def _after(spark: SparkSession, sf_dir: str, stages: list) -> DataFrame:
    """What these stages leave, as a table; what they wrote on the way is deleted."""
    if not stages:
        return table(spark, sf_dir, "documents")
    *before, (name, stage) = stages
    return settled(spark, name, lambda: stage(spark, _after(spark, sf_dir, before), sf_dir))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    *before, (_, last) = STAGES
    return last(spark, _after(spark, sf_dir, before), sf_dir)

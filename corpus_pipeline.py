"""A corpus pipeline of four stages: language ID, line dedup, near-dedup and packing.

run() applies the stages in turn; each one's rows are written as Parquet in the shared folder and
read again as the next one's documents. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framestride.llm import language_id, line_dedup, near_dedup, packing, shared
from framestride.session import reachable


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known, as they are; those that are rejected go.

    A null or empty text, or one without letters, says nothing of a language, so it is rejected. Very
    long texts are judged whole; rows that repeat one another stay or go together; ties go to the
    first language of the alphabet; columns of any name stay; an empty table stays empty.
    """
    reachable(spark)
    return language_id.known(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; those of which nothing is left go.

    A null or empty text loses nothing and stays. Very long texts are documents like any other; rows
    equal in doc_id and text get the same result; of equal doc_ids the text of larger MD5 is later, and
    a null doc_id is last. n_chars follows the text; columns of any name stay; an empty table stays empty.
    """
    reachable(spark)
    return line_dedup.cleaned(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that with the smallest doc_id.

    A null text is a class of its own; empty texts are one class; very long texts are compared whole;
    of rows equal in doc_id and text one stays; a null doc_id is larger than any; columns of any name
    stay; an empty table stays empty.
    """
    reachable(spark)
    return near_dedup.dedup(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its place in a sequence.

    A null or empty text is the end mark alone; very long texts are cut into full windows; repeated
    rows and equal or null ids are documents of their own; other columns are not read; no documents
    give no pieces.
    """
    import public_tokenizers

    reachable(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", identify_language), ("line_dedup", dedup_lines), ("near_dedup", dedup_documents), ("packing", pack_sequences)]

#: The stages' models, alignments and hashes have no SQL; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = shared.cut(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)

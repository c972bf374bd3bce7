"""A corpus pipeline of the training-data operators: identify, remove repeated lines, deduplicate, decontaminate, encode.

Each stage takes the documents that the one before kept. All but the last return the columns of documents.

In every stage an empty table gives an empty one, texts count whole however long they are, rows with the same id are one
document, and other columns than doc_id and text pass unread (n_chars follows the text, where there is one).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernel.llm import bpe, decontaminate, jaccard, language_id, line_dedup
from quernel.llm.shared import table, written

#: Near duplicates here: five-word shingles, a similarity of 0.8 or more.
NEAR = jaccard.Params(shingle=5, num=80)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the learned languages go: no text, no letter in it, or without evidence for any of them.

    A null lang teaches nothing; a null id is learned from like others. Repeated rows are judged alike.
    """
    return language_id.keep_identified(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later near copies of lines, and exact ones of short lines, go; so do documents that have lost all their words by it.

    The place of a line is its document's id (null first) and its number; equal places do not drop each other. Null and
    blank texts stay as they are.
    """
    return line_dedup.without_repeats(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; null and blank texts have no duplicates.

    Rows with a null id go if a document with an id is linked to them.
    """
    return jaccard.one_of_each(docs, NEAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go, all rows of their id; null texts and items hold nothing."""
    return decontaminate.without_overlaps(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of what they decode to, for every row; null text counts as empty."""
    return bpe.encode_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: The classifier and the rank file have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

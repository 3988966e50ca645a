"""A corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the
last return the columns of documents; the last returns the pieces and their places.

In every stage a null text counts as empty, texts of any length are taken whole, a null id is a
document's like any other, ties are decided by id or content, and an empty table gives an empty one;
further columns, whatever their names, stay as they are. What rows equal in all columns mean differs:
see each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm import language_id, line_dedup, near_dedup, packing, quality_rules
from sylva.llm.common import stored, table
from sylva.llm.queries import vocabulary
from sylva.storage import release, scope


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; texts without words go. Equal rows stay or go together."""
    return quality_rules.keep(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, by profiles learned from the documents given.

    Texts without letters, and texts far from the profiles of all languages, go; if no document has a
    language, all go. Of languages that are equally near the first by name counts. Equal rows stay or
    go together.
    """
    return language_id.keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many of them share; n_chars counts what is left, null for a null text.

    Rows with one id are one document, and so are rows without an id.
    """
    return line_dedup.dedup(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, and of equal texts without words, such as those whose lines are all gone.

    The one with the least id stays, null ids last; of rows equal in id and text one stays.
    """
    return near_dedup.keep(docs, wordless=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens; equal rows give pieces each."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", rules),
    ("language_id", language),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("packing", packed),
]

#: Language profiles, components and packing are not expressible in SQL; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's tables, and its predecessor's documents, are deleted when it is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scope(spark) as kept:
            after = stored(stage(spark, docs, sf_dir), name)
            kept.append(after)
        release(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)

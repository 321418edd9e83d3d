"""A training corpus from documents: quality, near-duplicates, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)``, works on every row of ``docs`` and
returns a DataFrame that is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of ``documents``.

Every stage takes nulls in any column, very long texts, repeated rows, columns that
clash with its own names (they pass through) and an empty table (no rows).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from junctura.llm import packing, pii, quality, simhash
from junctura.plans.session import stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts.

    A null or empty text is judged by its site and its lack of words, a null source is
    the site "", repeated rows stay or go together, and a tie with the threshold stays.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, that of the smallest id.

    Texts without words (null, empty, blank) are one component; repeated rows leave one;
    rows without an id stay only where their component has no id, one of them.
    """
    return simhash.keep_one(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with surrogates in place of personal data.

    Null and empty texts and null ids stay as they are; repeated rows are replaced alike;
    equal entities have equal surrogates over all texts, and n_chars follows the text.
    """
    return pii.replaced(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their ids and places in sequences.

    A null or empty text is its end token alone; texts over a sequence are cut; repeated
    rows are packed each; pieces of one length go in any order.
    """
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", dedup_stage),
    ("pii surrogates", pii_stage),
    ("best-fit packing", packing_stage),
]
#: Training, fingerprints, keyed surrogates and packing aren't SQL; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

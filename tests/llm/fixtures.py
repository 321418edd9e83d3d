"""Odd rows that every operator on texts has to take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LONG = "The quick brown fox, 12 of them! " * 6000 + "1" * 3000 + " \n\t " + "é" * 2000
ROWS = [
    (1, "Hello World again, hello world"),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (5, LONG),
    (6, "Hello World again, hello world"),
    (6, "Hello World again, hello world"),
    (7, "naïve Ünïcode ǰ J̌ 漢字かな 😀  two  spaces\x1cseparator wide"),
    (8, "one"),
    (9, "one two"),
    (None, "a row without an id"),
    (10, "don't we'll I'm 'tis <|endoftext|> x" * 30),
]


def docs(spark: SparkSession, rows: list | None = None) -> DataFrame:
    """``documents`` with columns that clash with names the operators make."""
    rows = ROWS if rows is None else rows
    full = [(i, t, "en", f"src{k % 3}", len(t) if t is not None else None, "b", 0.5, k, "x") for k, (i, t) in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, block string, score double, fp int, shard string"
    return spark.createDataFrame(full, schema).repartition(3)

"""Registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
VIEWS = {"aln": fixtures.ALN, "feat": fixtures.FEAT, "reads": fixtures.READS, "lib": fixtures.LIB, "seqs": fixtures.SEQS, "split": fixtures.SPLIT}


def query(name: str, views: str = "", sql: str | None = None) -> Callable:
    """Register a query; ``views`` are the derived tables that ``sql`` reads."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            names = views.split()
            if "split" in names and "aln" not in names:
                names.insert(0, "aln")
            ORACLE[name] = (fixtures.ctes(**{n: VIEWS[n] for n in names}) if names else "") + fixtures.oracle(sql)
        return f

    return register

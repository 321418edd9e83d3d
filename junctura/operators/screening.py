"""Screening of a contig's alignments: ranks, score-relative paring, roles within groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import overlap_fraction
from .components import connected_components


def screen_top_n(aln: DataFrame, n: int = 500, min_identity: float = 40.0, best: int | None = None, unique: bool = False, min_query_len: int | None = None, min_match: float | None = None) -> DataFrame:
    """At most ``n`` alignments of a query by falling score that have the identity.

    ``best`` keeps so many ranks of distinct scores; ``unique`` drops queries whose
    two best scores tie. Ties are ordered by aln_no.
    """
    by = Window.partitionBy("query")
    a = aln if min_query_len is None else aln.where(F.col("query_len") >= min_query_len)
    a = a.withColumn("score_rank", F.dense_rank().over(by.orderBy(F.desc("score"))))
    if unique:
        a = a.withColumn("__ties", F.sum((F.col("score_rank") == 1).cast("int")).over(by)).where("__ties = 1").drop("__ties")
    if best is not None:
        a = a.where(F.col("score_rank") <= best)
    if min_match is not None:
        a = a.where((F.col("qend") - F.col("qstart") + 1) / F.col("query_len") >= min_match)
    a = a.where(F.col("identity_x10") / 10.0 >= min_identity)
    a = a.withColumn("kept_no", F.row_number().over(by.orderBy(F.desc("score"), "aln_no")))
    return a.where(F.col("kept_no") <= n)


def explained_contigs(aln: DataFrame, min_fraction: float = 0.999, min_match: float = 0.949) -> DataFrame:
    """query, perfect, single of contigs that one alignment explains: whole at identity 100, or nearly whole with enough matches."""
    size = F.col("qend") - F.col("qstart") + 1
    fraction = size / F.col("query_len")
    perfect = (size == F.col("query_len")) & (F.col("identity_x10") == 1000)
    single = (fraction >= min_fraction) & ((size - F.col("mismatch")) / F.col("query_len") >= min_match)
    return aln.groupBy("query").agg(F.bool_or(perfect).alias("perfect"), F.bool_or(single).alias("single")).where("perfect or single")


def without_explained(aln: DataFrame, **how: float) -> DataFrame:
    return aln.join(explained_contigs(aln, **how), "query", "left_anti")


def group_alignments(aln: DataFrame, min_overlap: float = 0.8) -> DataFrame:
    """``aln`` with group_no, the smallest aln_no of its group.

    A group is a connected component of alignments of a contig whose contig spans
    overlap by ``min_overlap`` of the shorter, so it does not depend on row order.
    """
    # Any type of contig name; a contig's alignments stay together, as their numbers are compared within it.
    node = F.struct("query", "aln_no")
    a = aln.select(node.alias("u"), "query", "qstart", "qend")
    b = a.select(F.col("u").alias("v"), "query", F.col("qstart").alias("s2"), F.col("qend").alias("e2"))
    edges = a.join(b, "query").where((F.col("u.aln_no") < F.col("v.aln_no")) & (overlap_fraction("qstart", "qend", "s2", "e2") >= min_overlap)).select("u", "v")
    of = connected_components(edges).select(F.col("node.query").alias("query"), F.col("node.aln_no").alias("aln_no"), F.col("component.aln_no").alias("__first"))
    return aln.join(of, ["query", "aln_no"], "left").withColumn("group_no", F.coalesce("__first", "aln_no").cast("int")).drop("__first")


def pare_by_score(grouped: DataFrame, keys: list[str], best: float = 0.85, multi: float = 0.8) -> DataFrame:
    """role: best within ``best`` of the group's highest score, multi within ``multi``, else dropped."""
    ratio = F.col("score") / F.max("score").over(Window.partitionBy(*keys))
    return grouped.withColumn("role", F.when(ratio >= best, "best").when(ratio >= multi, "multi").otherwise("dropped"))


def pare_by_identity(grouped: DataFrame, keys: list[str], best: float = 0.5, multi: float = 1.0) -> DataFrame:
    """The same by the difference to the group's highest identity; a difference that reaches a bound is too large."""
    below = (F.max("identity_x10").over(Window.partitionBy(*keys)) - F.col("identity_x10")) / 10.0
    return grouped.withColumn("role", F.when(below < best, "best").when(below < multi, "multi").otherwise("dropped"))


def prefer(grouped: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """If any alignment of a group has the flag (spliced, in exons), those without it are demoted."""
    any_ = F.bool_or(F.col(flag)).over(Window.partitionBy(*keys))
    return grouped.withColumn("role", F.when(any_ & ~F.col(flag), "multi").otherwise("best"))


def mark_multi_mapped(grouped: DataFrame, keys: list[str]) -> DataFrame:
    """multi_mapped: more than one best or multi-map alignment in the group."""
    n = F.sum((F.col("role") != "dropped").cast("int")).over(Window.partitionBy(*keys))
    return grouped.withColumn("multi_mapped", n > 1)


def pick_one_group(in_groups: DataFrame, keys: list[str], group: str) -> DataFrame:
    """An alignment that is in several groups stays in the first."""
    w = Window.partitionBy(*keys).orderBy(group)
    return in_groups.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def quick_best(aln: DataFrame, min_overlap: float = 0.8, min_ratio: float = 0.85) -> DataFrame:
    """Alignments without one of the same contig that overlaps them and scores so much more."""
    better = aln.select("query", F.col("aln_no").alias("n2"), F.col("qstart").alias("s2"), F.col("qend").alias("e2"), F.col("score").alias("score2"))
    a, b = aln.alias("a"), better.alias("b")
    worse = (F.col("a.query") == F.col("b.query")) & (F.col("aln_no") != F.col("n2")) & (overlap_fraction("qstart", "qend", "s2", "e2") >= min_overlap) & (F.col("score") < min_ratio * F.col("score2"))
    return a.join(b, worse, "left_anti")

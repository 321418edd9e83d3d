"""Split candidates: ordered pairs of alignments of a contig, their metrics, topology and breakpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions.scalars import chrom_order, interval_overlap, is_standard_chrom, normalize_chrom, overlap_fraction

LOCAL, END_DUPLICATION = 5000, 0.8


def _topology(local: int, min_end_dup: float) -> Column:
    far = F.col("bp_distance") > local
    forward = F.when(F.col("strand1") == "+", F.col("tstart1") < F.col("tstart2")).otherwise(F.col("tstart1") > F.col("tstart2"))
    same_strand = (
        F.when(F.col("subset_fraction") > min_end_dup, "end-duplication")
        .when(~forward, F.when(far, "intrachr-non-colinear").otherwise("junction-duplication"))
        .otherwise(F.when(far, "intrachr-same-strand").otherwise("read-through"))
    )
    return (
        F.when(F.col("chrom1") != F.col("chrom2"), "interchr")
        .when(F.col("strand1") == F.col("strand2"), same_strand)
        .otherwise(F.when(far, "intrachr-opp-strand").otherwise("local-inversion"))
    )


def _numbered(df: DataFrame, column: str) -> bool:
    """Whether chromosomes are whole numbers, which need no reading as names."""
    return isinstance(df.schema[column].dataType, IntegralType)


def pair_alignments(aln: DataFrame, max_overlap: float = 0.8, min_represented: float = 0.85, group: str | None = None) -> DataFrame:
    """Pairs of one contig, by contig position, that overlap less and together represent enough of it.

    Alignments to other than the standard chromosomes, and to M, are left out. One
    equi-join on the contig, so screen its alignments first (``screen_top_n``);
    with ``group`` the two must be of different groups.
    """
    name = F.col("chrom").cast("string")
    aln = aln.where(F.col("chrom") > 0 if _numbered(aln, "chrom") else is_standard_chrom(name) & (normalize_chrom(name) != "M"))
    sides = []
    names = {"aln_no": "no", "chrom": "chrom", "strand": "strand", "qstart": "qs", "qend": "qe", "tstart": "tstart", "tend": "tend", "tleft": "tleft", "tright": "tright", "identity_x10": "pid"}
    for k in (1, 2):
        cols = [F.col(a).alias(f"{b}{k}") for a, b in names.items()]
        extra = [F.col(group).alias(f"group{k}")] if group else []
        sides.append(aln.select(F.col("query").alias("contig"), F.col("query_len").alias(f"__len{k}"), *cols, *extra))
    before = (F.col("qs1") < F.col("qs2")) | ((F.col("qs1") == F.col("qs2")) & (F.col("no1") < F.col("no2")))
    # Both sides read the same columns, so that they share one shuffle of the alignments (and none is broadcast by file size); a contig has one length.
    p = sides[0].join(sides[1].hint("merge"), "contig").withColumn("ctg_len", F.coalesce("__len1", "__len2")).drop("__len1", "__len2").where(before & (overlap_fraction("qs1", "qe1", "qs2", "qe2") < max_overlap))
    if group:
        p = p.where("group1 <> group2")
    return p.where(represented() >= min_represented)


def represented() -> Column:
    both = (F.col("qe1") - F.col("qs1") + 1) + (F.col("qe2") - F.col("qs2") + 1) - F.greatest(F.lit(0), interval_overlap("qs1", "qe1", "qs2", "qe2"))
    return both.cast("double") / F.col("ctg_len")


def split_metrics(pairs: DataFrame) -> DataFrame:
    """ctg_overlap, represented, bp_distance, target_distance (between the two ranges, below zero where they overlap) and subset_fraction; the latter three null over chromosomes."""
    same = F.col("chrom1") == F.col("chrom2")
    shared = F.when(F.col("tleft1") < F.col("tleft2"), F.col("tright1") - F.col("tleft2") + 1).otherwise(F.col("tright2") - F.col("tleft1") + 1)
    shorter = F.least(F.col("tright1") - F.col("tleft1") + 1, F.col("tright2") - F.col("tleft2") + 1)
    return pairs.select(
        "*",
        interval_overlap("qs1", "qe1", "qs2", "qe2").alias("ctg_overlap"),
        represented().alias("represented"),
        F.when(same, F.abs(F.col("tend1") - F.col("tstart2"))).alias("bp_distance"),
        F.when(same, F.when(F.col("tleft1") < F.col("tleft2"), F.col("tleft2") - F.col("tright1")).otherwise(F.col("tleft1") - F.col("tright2"))).alias("target_distance"),
        F.when(same, shared.cast("double") / shorter).alias("subset_fraction"),
    )


def topology(metrics: DataFrame, local: int = LOCAL, min_end_dup: float = END_DUPLICATION) -> DataFrame:
    return metrics.withColumn("topology", _topology(local, min_end_dup))


def split_candidates(aln: DataFrame, max_overlap: float = 0.8, min_represented: float = 0.85) -> DataFrame:
    return topology(split_metrics(pair_alignments(aln, max_overlap, min_represented)))


def breakpoints(split: DataFrame) -> DataFrame:
    """bp_a and bp_b as struct(chrom, coord, dir), by chromosome (M, Y, X, then numbers; others last by name), coordinate, then up before down."""
    one = F.struct(F.col("chrom1").alias("chrom"), F.col("tend1").alias("coord"), F.when(F.col("strand1") == "+", "up").otherwise("down").alias("dir"))
    two = F.struct(F.col("chrom2").alias("chrom"), F.col("tstart2").alias("coord"), F.when(F.col("strand2") == "+", "down").otherwise("up").alias("dir"))
    number = (lambda c: F.when(c >= 0, c)) if _numbered(split, "chrom1") and _numbered(split, "chrom2") else (lambda c: chrom_order(c.cast("string")))
    order = lambda b: F.coalesce(number(b["chrom"]), F.lit(1 << 30))
    key = lambda b: F.struct(order(b), b["chrom"], b["coord"], F.when(b["dir"] == "up", 0).otherwise(1))
    # Exploding the order of one row keeps it from being repeated in every use of a field and in joins below.
    ordered = split.select("*", F.explode(F.array(key(one) <= key(two))).alias("__first"))
    first = F.col("__first")
    return ordered.withColumn("bp_a", F.when(first, one).otherwise(two)).withColumn("bp_b", F.when(first, two).otherwise(one)).drop("__first")


def drop_contiguous(pairs: DataFrame) -> DataFrame:
    """Without pairs whose junctions touch on one chromosome, up then down: they are no event."""
    a, b = F.col("bp_a"), F.col("bp_b")
    touching = (a["chrom"] == b["chrom"]) & (F.abs(a["coord"] - b["coord"]) < 2) & (a["dir"] == "up") & (b["dir"] == "down")
    return pairs.where(~touching)

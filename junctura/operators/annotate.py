"""Gene features and what candidates overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import overlap_join, overlap_outer


def gene_features(transcripts: DataFrame) -> DataFrame:
    """transcript, gene, chrom, fs, fe, feature, num from exons array<struct<s,e>>, cds_s, cds_e and strand.

    Exons are cut at the coding ends into utr and exon; without a coding range
    (cds_s >= cds_e) the gene is named ``.non_coding``. Introns lie between exons.
    Each kind is numbered along the strand.
    """
    coding = F.col("cds_s") < F.col("cds_e")
    t = transcripts.withColumn("gene", F.when(coding, F.col("gene")).otherwise(F.concat("gene", F.lit(".non_coding"))))
    ex = t.select("*", F.posexplode(F.array_sort("exons")).alias("k", "x"))
    s, e = F.col("x")["s"], F.col("x")["e"]
    piece = lambda kind, lo, hi: F.when(lo <= hi, F.struct(F.lit(kind).alias("feature"), lo.alias("fs"), hi.alias("fe")))
    parts = F.when(
        coding,
        F.array(piece("utr", s, F.least(e, F.col("cds_s") - 1)), piece("exon", F.greatest(s, F.col("cds_s")), F.least(e, F.col("cds_e"))), piece("utr", F.greatest(s, F.col("cds_e") + 1), e)),
    ).otherwise(F.array(piece("exon", s, e)))
    following = F.lead("x").over(Window.partitionBy("transcript").orderBy("k"))["s"]
    intron = piece("intron", e + 1, following - 1)
    rows = ex.withColumn("parts", F.filter(F.concat(parts, F.array(intron)), lambda p: p.isNotNull()))
    flat = rows.select("transcript", "gene", "chrom", "strand", F.explode("parts").alias("p")).select("transcript", "gene", "chrom", "strand", "p.*")
    along = F.when(F.col("strand") == "+", F.col("fs")).otherwise(-F.col("fs"))
    return flat.withColumn("num", F.row_number().over(Window.partitionBy("transcript", "feature").orderBy(along))).drop("strand")


def gene_directions(transcripts: DataFrame, key: str = "gene") -> DataFrame:
    """The strand of each gene or transcript, * on conflict."""
    return transcripts.groupBy(key).agg(F.when(F.min("strand") == F.max("strand"), F.min("strand")).otherwise("*").alias("direction"))


def gene_overlap_agg(aln: DataFrame, features: DataFrame, key: list[str], buffer: int = 10, least: int = 5, by: list[str] | None = None, **how: object) -> DataFrame:
    """Genes of each range whose total overlap is over the best less ``buffer``, with their features of more than ``least`` bases (else all).

    ``by`` names what overlaps are summed by: the gene, or gene and transcript.
    """
    by = by or ["gene"]
    hits = overlap_join(aln, features, **how)
    per = hits.groupBy(*key, *by).agg(
        F.sum("amount").alias("amount"),
        F.collect_set(F.when(F.col("amount") > least, F.col("feature"))).alias("__main"),
        F.collect_set("feature").alias("__low"),
    )
    best = F.max("amount").over(Window.partitionBy(*key))
    kept = per.withColumn("__best", best).where(F.col("amount") > F.col("__best") - buffer)
    parts = F.array_sort(F.when(F.size("__main") > 0, F.col("__main")).otherwise(F.col("__low")))
    return kept.select(*key, *by, "amount", parts.alias("features"))


def nearby_genes(aln: DataFrame, features: DataFrame, key: list[str], buffer: int = 10, within: int = 1000, by: list[str] | None = None, **how: object) -> DataFrame:
    """For ranges that overlap no feature, the genes (or ``by``) less than ``buffer`` further than the nearest, which is under ``within`` away."""
    by = by or ["gene"]
    lone = overlap_outer(aln, features, key, only_unmatched=True, **how).drop("matched")
    wide = lone.withColumn("__s", F.col("s") - within).withColumn("__e", F.col("e") + within)
    near = overlap_join(wide, features, lr=("__s", "__e"), **how)
    away = F.when(F.col("fs") > F.col("e"), F.col("fs") - F.col("e")).otherwise(F.col("s") - F.col("fe"))
    per = near.withColumn("__d", away).where(F.col("__d") < within).groupBy(*key, *by).agg(F.min("__d").alias("distance"))
    return per.withColumn("__best", F.min("distance").over(Window.partitionBy(*key))).where(F.col("distance") < F.col("__best") + buffer).drop("__best")


def exon_edges(features: DataFrame, by: tuple[str, ...] = ("gene",)) -> DataFrame:
    """chrom, edge, side (left, right) of exons, but for the outer edges of each gene.

    With ``by`` of a transcript's columns the outer edges of each transcript are left out, so an
    end of a short transcript counts where it is within an exon chain of a longer one.
    """
    x = features.where("feature = 'exon'")
    w = Window.partitionBy(*by, "chrom")
    x = x.withColumn("__lo", F.min("fs").over(w)).withColumn("__hi", F.max("fe").over(w))
    left = x.where("fs > __lo").select("chrom", F.col("fs").alias("edge"), F.lit("left").alias("side"))
    right = x.where("fe < __hi").select("chrom", F.col("fe").alias("edge"), F.lit("right").alias("side"))
    return left.unionByName(right).distinct()


def breakpoint_genes(points: DataFrame, features: DataFrame, main: DataFrame, key: list[str], buffer: int = 5, **how: object) -> DataFrame:
    """Features within ``buffer`` of a breakpoint, if gene and feature are main ones of the member (``main``)."""
    around = points.withColumn("s", F.col("coord") - buffer).withColumn("e", F.col("coord") + buffer)
    hits = overlap_join(around, features, **how).select(*key, "gene", "feature").distinct()
    return hits.join(main.select(*key, "gene", "feature").distinct(), [*key, "gene", "feature"], "left_semi")


def repeat_join(regions: DataFrame, repeats: DataFrame, key: list[str], label: str = "name", **how: object) -> DataFrame:
    """The sorted repeat labels that each region (exploded blocks s, e) overlaps."""
    hits = overlap_join(regions, repeats, **how)
    return hits.groupBy(*key).agg(F.array_sort(F.collect_set(label)).alias("repeats"))


def flag_structural_rna(labelled: DataFrame, column: str = "repeats") -> DataFrame:
    """rna: some label is of an RNA class."""
    return labelled.withColumn("rna", F.exists(column, lambda x: x.rlike(r"(^|_)(r|sc|sn|srp|t)?RNA(_[0-9]+)?$")))

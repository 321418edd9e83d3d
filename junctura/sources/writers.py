"""Text outputs: groups, VCF, BED, FASTA, coordinates. Each makes lines as a column; writing is Spark's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_lines(events: DataFrame, members: DataFrame, key: str = "group_id") -> DataFrame:
    """One ``value`` a group: its ``line``, its members' ``line``s by member_no, and an empty line."""
    m = members.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("member_no", "line"))).alias("m"))
    text = F.concat_ws("\n", F.col("line"), F.transform("m", lambda x: x["line"]), F.lit(""))
    return events.join(m, key).select(key, text.alias("value"))


def write_groups(events: DataFrame, members: DataFrame, path: str, key: str = "group_id") -> None:
    group_lines(events, members, key).select("value").write.text(path)


def write_split_outputs(groups: DataFrame, path: str) -> None:
    """pass and fail, and below them a folder per topology, ``multi`` where a group has several (``topologies``)."""
    one = F.when(F.size("topologies") > 1, "multi").otherwise(F.col("topologies")[0])
    groups.withColumn("topology", one).select("value", "status", "topology").write.partitionBy("status", "topology").text(path)


def _alt(dir_a: Column, dir_b: Column, base: Column, chrom: Column, pos: Column, first: bool, by_reference: bool) -> Column:
    """Breakend ALT: after the base where the sequence to its left is kept (up), else before it.

    The bracket faces the way that the mate's kept sequence runs. ``by_reference`` gives the older form with brackets turned.
    """
    place = F.concat(chrom, F.lit(":"), pos.cast("string"))
    own, mate = (dir_a, dir_b) if first else (dir_b, dir_a)
    inward, outward = ("]", "[") if not by_reference else ("[", "]")
    mark = F.when(mate == "up", inward).otherwise(outward)
    mated = F.concat(mark, place, mark)
    return F.when(own == "up", F.concat(base, mated)).otherwise(F.concat(mated, base))


def to_vcf_fusion(events: DataFrame, by_reference: bool = False) -> DataFrame:
    """Two breakend rows an event: chrom, pos, id, ref, alt, qual, filter, info.

    ``events`` has group_id, chrom_a, coord_a, dir_a, the same for b, ctg_overlap, support and contigs (array).
    Down sides move back by a positive overlap. ref is ref_a and ref_b, the genome's bases at the
    positions (``reference_lookup``), where ``events`` has them, else N.
    """
    over = F.greatest(F.lit(0), F.col("ctg_overlap"))
    pos = {s: F.col(f"coord_{s}") + F.when(F.col(f"dir_{s}") == "down", -over).otherwise(0) for s in "ab"}
    chrom = {s: F.col(f"chrom_{s}").cast("string") for s in "ab"}
    ref = {s: F.coalesce(F.col(f"ref_{s}"), F.lit("N")) if f"ref_{s}" in events.columns else F.lit("N") for s in "ab"}
    info = lambda mate: F.concat(F.lit("SVTYPE=FND;MATEID="), F.col("group_id").cast("string"), F.lit(mate), F.when(over > 0, F.concat(F.lit(";CIPOS=0,"), over.cast("string"))).otherwise(""), F.lit(";SR="), F.col("support").cast("string"), F.lit(";CTG="), F.array_join("contigs", ","))
    row = lambda s, o, first: F.struct(chrom[s].alias("chrom"), pos[s].alias("pos"), F.concat(F.col("group_id").cast("string"), F.lit(s)).alias("id"), ref[s].alias("ref"), _alt(F.col("dir_a"), F.col("dir_b"), ref[s], chrom[o], pos[o], first, by_reference).alias("alt"), F.lit(".").alias("qual"), F.lit("PASS").alias("filter"), info(o).alias("info"))
    return events.select(F.explode(F.array(row("a", "b", True), row("b", "a", False))).alias("r")).select("r.*")


def to_vcf_dup(events: DataFrame) -> DataFrame:
    """One tandem duplication row: an ITD ends with its sequence, a PTD starts at the down side and ends at the other."""
    itd = F.col("event_type") == "itd"
    down_a = F.col("dir_a") == "down"
    start = F.when(itd, F.col("coord_a")).otherwise(F.when(down_a, F.col("coord_a")).otherwise(F.col("coord_b")))
    end = F.when(itd, F.col("coord_a") + F.length("event_seq") - 1).otherwise(F.when(down_a, F.col("coord_b")).otherwise(F.col("coord_a")))
    return events.select(F.col("chrom_a").cast("string").alias("chrom"), start.alias("pos"), F.col("group_id").cast("string").alias("id"), F.lit("N").alias("ref"), F.lit("<DUP:TANDEM>").alias("alt"), F.concat(F.lit("SVTYPE=DUP;END="), end.cast("string"), F.lit(";SR="), F.col("support").cast("string")).alias("info"))


def to_bed12(rows: DataFrame, colour: str = "0,0,0") -> DataFrame:
    """BED lines of ``chrom``, ``name``, ``strand`` and ascending ``blocks``."""
    start, end = F.col("blocks")[0]["s"] - 1, F.element_at("blocks", -1)["e"]
    sizes = F.array_join(F.transform("blocks", lambda b: (b["e"] - b["s"] + 1).cast("string")), ",")
    starts = F.array_join(F.transform("blocks", lambda b: (b["s"] - 1 - start).cast("string")), ",")
    text = [F.col("chrom").cast("string"), start.cast("string"), end.cast("string"), F.col("name"), F.lit("0"), F.col("strand"), start.cast("string"), end.cast("string"), F.lit(colour), F.size("blocks").cast("string"), sizes, starts]
    return rows.select("name", F.concat_ws("\t", *text).alias("value"))


def event_coords(events: DataFrame) -> DataFrame:
    """group_id, chrom, s, e: two rows of a fusion, one from least to greatest of a duplication."""
    point = lambda s: F.struct(F.col(f"chrom_{s}").alias("chrom"), F.col(f"coord_{s}").alias("s"), F.col(f"coord_{s}").alias("e"))
    span = F.struct(F.col("chrom_a").alias("chrom"), F.least("coord_a", "coord_b").alias("s"), F.greatest("coord_a", "coord_b").alias("e"))
    rows = F.when(F.col("event_type") == "fusion", F.array(point("a"), point("b"))).otherwise(F.array(span))
    return events.select("group_id", F.explode(rows).alias("r")).select("group_id", "r.*")


def contig_fasta(sequences: DataFrame, passing: DataFrame, width: int = 60) -> DataFrame:
    """FASTA records (``value``) of the contigs of passing groups."""
    folded = F.regexp_replace(F.regexp_replace("sequence", f"(.{{{width}}})", "$1\n"), "\n$", "")
    return sequences.join(passing.select("id").distinct(), "id", "left_semi").select("id", F.concat(F.lit(">"), F.col("id"), F.lit("\n"), folded).alias("value"))


def write_contigs_fasta(sequences: DataFrame, passing: DataFrame, path: str) -> None:
    contig_fasta(sequences, passing).select("value").write.text(path)

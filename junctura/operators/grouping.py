"""Events: candidates that share chromosomes, directions and near junctions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import cut, stored
from .components import connected_components

KEYS = ["chrom_a", "dir_a", "chrom_b", "dir_b"]


def group_events(junctions: DataFrame, read_length: int = 75, node: str = "node") -> DataFrame:
    """``junctions`` with group_key, the smallest node of its event.

    Two candidates are linked if chromosomes and directions are the same and both
    junctions, widened by half a read, overlap; events are the connected
    components, so row order does not matter.

    Cells are one base wider than a link reaches, so all places of a cell are linked
    and only cells are compared: with the next one along either junction by their
    extremes, with the two diagonal ones by a sweep along the first junction that
    keeps the nearest second one. No pair of places is ever made. Cells without
    another next to them, most where junctions are sparse, are told by a hash of
    their place and take no part in that.
    """
    reach = 2 * math.ceil(read_length / 2)
    cell = lambda c: F.floor(F.col(c) / (reach + 1))
    at = [*KEYS, "__ca", "__cb"]
    # Read several times below; a node has one place.
    placed = stored(junctions.withColumn("__ca", cell("coord_a")).withColumn("__cb", cell("coord_b")), "placed")
    cells = placed.groupBy(*at).agg(F.count(F.lit(1)).alias("n"), F.min(node).alias("u"), F.min("coord_a").alias("a0"), F.max("coord_a").alias("a1"), F.min("coord_b").alias("b0"), F.max("coord_b").alias("b1"))
    cells = stored(cells, "cells")
    place = lambda da, db: F.xxhash64(*KEYS, F.col("__ca") + da, F.col("__cb") + db)
    look = cells.select("u", F.explode(F.array(*[place(*x) for x in ((1, 0), (0, 1), (1, 1), (1, -1))])).alias("h"))
    met = look.join(cells.select(F.col("u").alias("v"), place(0, 0).alias("h")).hint("merge"), "h").select(F.explode(F.array("u", "v")).alias("u")).distinct()
    near = stored(cells.join(met, "u", "left_semi"), "near")
    # One row a cell and place along the first junction: at most reach + 1 in a cell.
    steps = placed.join(near.select(*at), at, "left_semi").groupBy(*at, "coord_a").agg(F.min("coord_b").alias("lo"), F.max("coord_b").alias("hi"))
    steps = stored(steps, "steps")
    ahead = lambda da, db: near.select(*KEYS, (F.col("__ca") - da).alias("__ca"), (F.col("__cb") - db).alias("__cb"), F.col("u").alias("v"), F.col("a0").alias("next_a"), F.col("b0").alias("next_b"))
    edges = near.join(ahead(1, 0), at).where(F.col("next_a") - F.col("a1") <= reach).select("u", "v")
    edges = edges.unionByName(near.join(ahead(0, 1), at).where(F.col("next_b") - F.col("b1") <= reach).select("u", "v"))
    for turn in (1, -1):  # the diagonal cell above, and the one below with the second junction mirrored
        b = lambda lo, hi: F.col(hi if turn > 0 else lo) * turn
        here = steps.select(*at, (F.col("coord_a") + reach).alias("pos"), F.lit(1).alias("kind"), b("lo", "hi").alias("b"))
        there = steps.select(*KEYS, (F.col("__ca") - 1).alias("__ca"), (F.col("__cb") - turn).alias("__cb"), F.col("coord_a").alias("pos"), F.lit(0).alias("kind"), b("hi", "lo").alias("b"))
        sweep = Window.partitionBy(*at).orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        nearest = F.min(F.when(F.col("kind") == 0, F.col("b"))).over(sweep)
        linked = here.unionByName(there).withColumn("near", nearest).where((F.col("kind") == 1) & (F.col("near") - F.col("b") <= reach)).select(*at).distinct()
        edges = edges.unionByName(linked.join(near.select(*at, "u"), at).join(ahead(1, turn), at).select("u", "v"))
    comp = connected_components(edges).withColumnRenamed("node", "u")
    # A lone junction is its own event.
    named = cells.join(comp, "u", "left").where("n > 1 OR component IS NOT NULL").select(*at, F.coalesce("component", "u").alias("group_key"))
    out = placed.join(stored(named, "named"), at, "left").withColumn("group_key", F.coalesce("group_key", node))
    return out.select(*junctions.columns, "group_key")


def group_summary(members: DataFrame) -> DataFrame:
    """One row an event: regions, topologies, contig lengths, and the member of the longest contig."""
    longest = F.max_by(F.struct("contig", "no1", "no2"), F.struct(F.col("ctg_len"), -F.col("contig"), -F.col("no1"), -F.col("no2")))
    return members.groupBy("group_key").agg(
        F.count(F.lit(1)).alias("n_members"),
        F.countDistinct("contig").alias("n_contigs"),
        F.min("coord_a").alias("a_min"), F.max("coord_a").alias("a_max"),
        F.min("coord_b").alias("b_min"), F.max("coord_b").alias("b_max"),
        F.array_sort(F.collect_set("topology")).alias("topologies"),
        F.array_sort(F.collect_set("ctg_len")).alias("ctg_lengths"),
        F.max("ctg_len").alias("longest"),
        longest.alias("lead"),
    )


def group_ids(summary: DataFrame) -> DataFrame:
    """group_id by falling longest contig, then key.

    Events are ranged by Spark over tasks and sorted there; the rows before a range
    are added to a row's number in it. Only the ranges' sizes meet in one place.
    """
    order = [F.desc("longest"), F.asc("group_key")]
    ranged = summary.select("group_key", "longest").repartitionByRange(*order).sortWithinPartitions(*order)
    rows = cut(ranged.withColumn("__no", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__no", 33))
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    within = F.col("__no").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(F.broadcast(before), "__part").select("group_key", (F.col("__before") + within).alias("group_id"))


def member_letters(members: DataFrame) -> DataFrame:
    """member_no in order of contig length (falling), contig and pair, within the event."""
    w = Window.partitionBy("group_key").orderBy(F.desc("ctg_len"), "contig", "no1", "no2")
    return members.withColumn("member_no", F.row_number().over(w))


def locality(summary: DataFrame, near: int = 100_000) -> DataFrame:
    """neighbour (close on one chromosome), samechr or diffchr."""
    gap = F.greatest(F.col("a_min"), F.col("b_min")) - F.least(F.col("a_max"), F.col("b_max"))
    return summary.withColumn("locality", F.when(F.col("chrom_a") != F.col("chrom_b"), "diffchr").when(gap <= near, "neighbour").otherwise("samechr"))


def groups_per_contig(members: DataFrame) -> DataFrame:
    n = members.groupBy("contig").agg(F.countDistinct("group_key").alias("num_groups"))
    return members.join(n, "contig")


def gene_sets(member_gene: DataFrame) -> DataFrame:
    """genes_a and genes_b of each event, sorted; a member whose sets fit better swapped counts swapped.

    The first member (smallest member_no) sets the sides; each later one is compared with it.
    """
    sides = member_gene.groupBy("group_key", "member_no").agg(
        F.array_sort(F.collect_set(F.when(F.col("region") == "A", F.col("gene")))).alias("a"), F.array_sort(F.collect_set(F.when(F.col("region") == "B", F.col("gene")))).alias("b")
    )
    lead = sides.groupBy("group_key").agg(F.min_by(F.struct("a", "b"), "member_no").alias("lead"))
    both = lambda x, y: F.size(F.array_intersect(x, y))
    j = sides.join(lead, "group_key")
    straight = both(F.col("a"), F.col("lead.a")) + both(F.col("b"), F.col("lead.b"))
    turned = both(F.col("a"), F.col("lead.b")) + both(F.col("b"), F.col("lead.a"))
    swap = turned > straight
    j = j.select("group_key", F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"))
    return j.groupBy("group_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("a")))).alias("genes_a"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("b")))).alias("genes_b"))

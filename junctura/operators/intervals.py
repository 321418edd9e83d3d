"""Interval joins on closed ranges within a chromosome, by bins.

Each range goes to the bins that it touches, so a range join becomes one equi-join
on (chromosome, kind, bin) with the overlap as a residual, and a pair is kept in
its first common bin alone. Ranges as long as ``SPAN`` bins or longer use bins
``WIDE`` times as wide, so that a range is a few rows whatever the width. The kind
says which of the two sides is wide, so two narrow ranges never meet in a wide bin: a
narrow range is there for narrow ones in its bins and for wide ones in its wide bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDE = 32
SPAN = 4
#: Bases of a bin of places (``near_ranges``).
PLACES = 500
MODES = ("any", "full", "full_rev", "half")


def _binned(df: DataFrame, s: str, e: str, width: int, left: bool, name: str) -> DataFrame:
    """``df`` with a row for each (kind, bin) that a range is in."""

    def bins(kind: int, w: int) -> Column:
        return F.transform(F.sequence(F.floor(F.col(s) / w), F.floor(F.col(e) / w)), lambda b: F.struct(F.lit(kind).alias("kind"), b.alias("bin")))

    own, other = (1, 2) if left else (2, 1)  # kinds where this side is the narrow one, the wide one
    coarse = width * WIDE
    wide = F.col(e) - F.col(s) >= width * SPAN
    keys = F.when(wide, F.concat(bins(other, coarse), bins(3, coarse))).otherwise(F.concat(bins(0, width), bins(own, coarse)))
    return df.withColumn(name, F.explode(keys)).withColumn(f"{name}k", F.col(name)["kind"]).withColumn(name, F.col(name)["bin"])


def _mode(mode: str, s1: str, e1: str, s2: str, e2: str) -> Column:
    shared = F.least(F.col(e1), F.col(e2)) - F.greatest(F.col(s1), F.col(s2)) + 1
    return {
        "any": shared >= 1,
        "full": (F.col(s2) <= F.col(s1)) & (F.col(e1) <= F.col(e2)),
        "full_rev": (F.col(s1) <= F.col(s2)) & (F.col(e2) <= F.col(e1)),
        "half": shared * 2 >= F.col(e1) - F.col(s1) + 1,
    }[mode] & (shared >= 1)


def overlap_join(left: DataFrame, right: DataFrame, mode: str = "any", width: int = 1000, chrom: str = "chrom", lr: tuple[str, str] = ("s", "e"), rr: tuple[str, str] = ("fs", "fe")) -> DataFrame:
    """Pairs of ranges on a chromosome, with the shared length as ``amount``.

    any: they overlap; full: the left one is inside; full_rev: the right one is
    inside; half: half of the left one or more is shared. Rows without bounds never match.
    Spark's sizes of the sides know nothing of the bins, so neither is broadcast by them.
    """
    r = right.withColumnRenamed(chrom, "__rc")
    (s1, e1), (s2, e2) = lr, rr
    a, b = _binned(left, s1, e1, width, True, "__lb"), _binned(r, s2, e2, width, False, "__rb")
    first = F.floor(F.greatest(F.col(s1), F.col(s2)) / F.when(F.col("__lbk") == 0, width).otherwise(width * WIDE))
    on = (F.col(chrom) == F.col("__rc")) & (F.col("__lbk") == F.col("__rbk")) & (F.col("__lb") == F.col("__rb"))
    out = a.join(b.hint("merge"), on).where((F.col("__lb") == first) & _mode(mode, s1, e1, s2, e2))
    # Length as its shorter side sees it: never more than either range.
    amount = F.least(F.col(e1) - F.greatest(F.col(s1), F.col(s2)), F.col(e2) - F.greatest(F.col(s1), F.col(s2)), F.col(e1) - F.col(s1), F.col(e2) - F.col(s2)) + 1
    return out.withColumn("amount", amount).drop("__rc", "__lb", "__rb", "__lbk", "__rbk")


def overlap_outer(left: DataFrame, right: DataFrame, key: list[str], only_unmatched: bool = False, **how: object) -> DataFrame:
    """Left rows that match nothing, and unless ``only_unmatched`` the matches too; ``matched`` tells them apart."""
    hits = overlap_join(left, right, **how)
    lone = left.join(hits.select(*key).distinct(), key, "left_anti").withColumn("matched", F.lit(False))
    return lone if only_unmatched else hits.withColumn("matched", F.lit(True)).unionByName(lone, allowMissingColumns=True)


def overlap_count(left: DataFrame, right: DataFrame, key: list[str], **how: object) -> DataFrame:
    """Matches of each left row, zero included."""
    n = overlap_join(left, right, **how).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return left.join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def expanded(left: DataFrame, n: int, start: str = "s", end: str = "e") -> DataFrame:
    """Ranges of ``n`` past their start."""
    return left.withColumn(end, F.col(start) + n)


def nearest_feature(left: DataFrame, right: DataFrame, key: list[str], label: str, within: int = 1000, **how: object) -> DataFrame:
    """For rows that overlap nothing, the feature whose end is nearest, under ``within`` away.

    ``distance`` is above zero where the feature lies to the right. Ties go to the
    smaller start, then label.
    """
    lone = overlap_outer(left, right, key, only_unmatched=True, **how).drop("matched")
    wide = lone.withColumn("__s", F.col("s") - within).withColumn("__e", F.col("e") + within)
    near = overlap_join(wide, right, lr=("__s", "__e"), **how)
    near = near.withColumn("distance", F.when(F.col("fs") > F.col("e"), F.col("fs") - F.col("e")).otherwise(F.col("fe") - F.col("s")))
    order = Window.partitionBy(*key).orderBy(F.abs("distance"), "fs", label)
    near = near.where(F.abs("distance") < within).withColumn("__n", F.row_number().over(order)).where("__n = 1")
    return near.withColumn("feature_size", F.col("fe") - F.col("fs") + 1).drop("__n", "__s", "__e", "amount")


def boundary_match(points: DataFrame, edges: DataFrame, buffer: int = 4, chrom: str = "chrom", coord: str = "coord") -> DataFrame:
    """Points with an edge at most ``buffer`` away on their chromosome and side: an equi-join over the few places."""
    near = points.withColumn("__at", F.explode(F.sequence(F.col(coord) - buffer, F.col(coord) + buffer)))
    e = edges.select(F.col(chrom).alias("__c"), F.col("edge").alias("__edge"), F.col("side").alias("__side")).distinct()
    hit = near.join(e, (F.col(chrom) == F.col("__c")) & (F.col("__at") == F.col("__edge")) & (F.col("side") == F.col("__side")), "left_semi")
    return hit.drop("__at").distinct()


def location_match(ours: DataFrame, theirs: DataFrame, buffer: int, key: str = "id", other: str = "id2") -> DataFrame:
    """Breakpoint pairs (chrom_a, coord_a, chrom_b, coord_b) of two callers with both ends at most ``buffer`` apart.

    Cells of eight times ``buffer`` on both ends; ours go to each cell that they are near, mostly one, theirs to their own.
    """
    w = max(1, 8 * buffer)
    cell = lambda c: F.floor(F.col(c) / w)
    near = lambda c: F.explode(F.sequence(F.floor((F.col(c) - buffer) / w), F.floor((F.col(c) + buffer) / w)))
    a = ours.withColumn("__a", near("coord_a")).withColumn("__b", near("coord_b"))
    b = theirs.select(F.col(other), *[F.col(c).alias(f"__{c}") for c in ("chrom_a", "coord_a", "chrom_b", "coord_b")], cell("coord_a").alias("__a2"), cell("coord_b").alias("__b2"))
    on = (F.col("chrom_a") == F.col("__chrom_a")) & (F.col("chrom_b") == F.col("__chrom_b")) & (F.col("__a") == F.col("__a2")) & (F.col("__b") == F.col("__b2"))
    far = F.greatest(F.abs(F.col("coord_a") - F.col("__coord_a")), F.abs(F.col("coord_b") - F.col("__coord_b")))
    return a.join(b.hint("merge"), on).where(far <= buffer).withColumn("distance", far).select(key, other, "distance")


def near_ranges(features: DataFrame, reaches: tuple[int, ...], width: int = PLACES, chrom: str = "chrom", fs: str = "fs", fe: str = "fe") -> DataFrame:
    """Ranges of places (chrom, bin, s, e; closed) with a row for each of ``features`` at most the last, largest, of ``reaches`` away.

    A range ends where a feature comes into one of ``reaches`` or leaves it, and with its bin of ``width``, so that every place of
    a range is near the same features by each of them. Places in no range are near none. Ranges grow with features, however many
    places are looked up in them.
    """
    lo, hi = F.col(fs) - max(reaches), F.col(fe) + max(reaches)
    first = F.col("bin") * width
    parts = features.where(lo <= hi).withColumn("bin", F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width))))
    ends = F.array(*[x for r in reaches for x in (F.greatest(F.col(fs) - r, first), F.col(fe) + r + 1)])
    cuts = parts.select(chrom, "bin", F.explode(ends).alias("s")).where((F.col("s") >= first) & (F.col("s") < first + width)).distinct()
    end = F.coalesce(F.lead("s").over(Window.partitionBy(chrom, "bin").orderBy("s")), first + width) - 1
    return cuts.withColumn("e", end).join(parts.hint("merge"), [chrom, "bin"]).where((lo <= F.col("s")) & (F.col("s") <= hi))


def sequence_join(wanted: DataFrame, sequences: DataFrame, key: str = "id", bases: str = "sequence") -> DataFrame:
    """``key``, ``bases`` and conflict of the sequences that are wanted; conflict: the key has several different ones, of which the least stays."""
    s = sequences.join(wanted.select(key).distinct(), key, "left_semi")
    return s.groupBy(key).agg(F.min(bases).alias(bases), (F.min(bases) != F.max(bases)).alias("conflict"))


def reference_lookup(ranges: DataFrame, reference: DataFrame, chunk: int, key: list[str]) -> DataFrame:
    """``bases`` of closed 1-based ranges (chrom, s, e) from reference(chrom, chunk_no, seq) of ``chunk`` bases each."""
    wanted = ranges.withColumn("chunk_no", F.explode(F.sequence(F.floor((F.col("s") - 1) / chunk), F.floor((F.col("e") - 1) / chunk))))
    got = wanted.join(reference, ["chrom", "chunk_no"])
    first = F.greatest(F.lit(1), F.col("s") - F.col("chunk_no") * chunk)
    last = F.least(F.lit(chunk), F.col("e") - F.col("chunk_no") * chunk)
    part = F.substring(F.col("seq"), first.cast("int"), (last - first + 1).cast("int"))
    return got.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", part.alias("p")))), lambda x: x["p"]), "").alias("bases"))

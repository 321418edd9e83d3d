"""Read support: reads over event windows, strong reads, mates over regions, coverage of regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import stored

#: Depths and reads of covered bins are broadcast up to this many in all.
FEW_DEPTHS = 1 << 20


def mate_join(mates: DataFrame) -> DataFrame:
    """The two mates of a pair side by side: an equi-join on pair_id and the number."""
    one, two = (mates.where(F.col("number") == k).select("pair_id", *[F.col(c).alias(f"{c}{k}") for c in mates.columns if c not in ("pair_id", "number")]) for k in (1, 2))
    return one.join(two, "pair_id")


def event_region(split: DataFrame, min_overlap: int = 5) -> DataFrame:
    """Contig range lo..hi between (or shared by) the two alignments, widened and kept off the contig's end bases."""
    lo = F.least(F.col("qe1"), F.col("qs2")) - min_overlap
    hi = F.greatest(F.col("qe1"), F.col("qs2")) + min_overlap
    inside = lambda x: F.greatest(F.lit(2), F.least(x, F.col("ctg_len") - 1))
    return split.withColumn("lo", inside(lo)).withColumn("hi", inside(hi))


def read_event_join(regions: DataFrame, reads: DataFrame, key: list[str], min_overlap: int = 5) -> DataFrame:
    """``key`` and read_id of the reads (contig, read_id, rleft, rright) that reach over a region's inner bases on their contig.

    An equi-join on the contig with the range as a residual; a hot contig is split by AQE.
    """
    size = 2 * min_overlap
    r = reads.select(F.col("contig").alias("__c"), "read_id", "rleft", "rright")
    on = (F.col("contig") == F.col("__c")) & (F.col("rleft") <= F.col("hi") - size) & (F.col("rright") >= F.col("lo") + size)
    return regions.join(r, on).select(*key, "read_id")


def windows(regions: DataFrame, min_overlap: int = 5) -> DataFrame:
    """Sliding windows ws..we of 2 min_overlap + 1 bases; a shorter region is one window."""
    size = 2 * min_overlap + 1
    last = F.greatest(F.col("lo"), F.col("hi") - size + 1)
    w = regions.withColumn("ws", F.explode(F.sequence(F.col("lo"), last)))
    return w.withColumn("we", F.least(F.col("hi"), F.col("ws") + size - 1))


def window_support(regions: DataFrame, reads: DataFrame, key: list[str], min_overlap: int = 5) -> DataFrame:
    """min and mean, over an event's sliding windows, of the reads (contig, rleft, rright, strong) that cover a window; windows without reads count.

    Equal reads are counted once before the join, and a read is two steps of the
    count along the windows, not a row for every window that it covers.
    """
    size = 2 * min_overlap + 1
    r = reads.groupBy(F.col("contig").alias("__c"), "rleft", "rright").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("strong"), 1)).alias("ns"))
    base = regions.select(*key, F.col("contig").alias("__contig"), "lo", "hi", F.greatest(F.col("lo"), F.col("hi") - size + 1).alias("__last"))
    base = base.withColumn("__size", F.least(F.lit(size), F.col("hi") - F.col("lo") + 1))
    j = base.join(r, (F.col("__contig") == F.col("__c")) & (F.col("rleft") <= F.col("__last")) & (F.col("rright") >= F.col("lo") + F.col("__size") - 1))
    first, end = F.greatest("lo", "rleft"), F.least(F.col("__last"), F.col("rright") - F.col("__size") + 1)
    steps = F.array(F.struct(first.alias("at"), F.col("n").alias("n"), F.col("ns").alias("ns")), F.struct((end + 1).alias("at"), (-F.col("n")).alias("n"), (-F.col("ns")).alias("ns")))
    at = [*key, "lo", "__last"]
    moves = j.where(first <= end).select(*at, F.explode(steps).alias("x")).select(*at, "x.*")
    zero = F.lit(0).cast("long")
    moves = moves.unionByName(base.select(*at, F.col("lo").alias("at"), zero.alias("n"), zero.alias("ns"))).groupBy(*at, "at").agg(F.sum("n").alias("n"), F.sum("ns").alias("ns"))
    w = Window.partitionBy(*at).orderBy("at")
    spans = moves.select(*at, "at", F.sum("n").over(w).alias("n"), F.sum("ns").over(w).alias("ns"), F.coalesce(F.lead("at").over(w), F.col("__last") + 1).alias("next")).where("at <= __last")
    length, windows_ = F.col("next") - F.col("at"), F.col("__last") - F.col("lo") + 1
    mean = lambda c: F.sum(F.col(c) * length) / F.max(windows_)
    return spans.groupBy(*key).agg(F.min("n").alias("min_all"), mean("n").alias("mean_all"), F.min("ns").alias("min_strong"), mean("ns").alias("mean_strong"))


def read_is_strong(hits: DataFrame, contig_sets: DataFrame) -> DataFrame:
    """strong for each (read_id, group): one best hit, or fewer than 2 contigs + 1 of which half or more are in the group.

    ``hits(read_id, contig)`` are best hits, ``contig_sets(group, contig)`` the contigs of a group.
    """
    total = hits.groupBy("read_id").agg(F.countDistinct("contig").alias("n_hits"))
    size = contig_sets.groupBy("group").agg(F.countDistinct("contig").alias("n_contigs"))
    shared = hits.join(contig_sets, "contig").groupBy("read_id", "group").agg(F.countDistinct("contig").alias("n_shared"))
    j = shared.join(total, "read_id").join(size, "group")
    many = (F.col("n_hits") < 2 * F.col("n_contigs") + 1) & (2 * F.col("n_shared") >= F.col("n_hits"))
    return j.select("read_id", "group", ((F.col("n_hits") == 1) | many).alias("strong"))


def alt_hits(reads: DataFrame) -> DataFrame:
    """Alternative hits (``xa``: contig,pos,cigar,nm;...) that are perfect, no worse, and on another contig; one per read and contig."""
    x = reads.select("read_id", "contig", "nm", F.explode(F.split("xa", ";")).alias("h")).where("h <> ''")
    f = F.split("h", ",")
    x = x.select("read_id", "contig", "nm", f[0].cast("long").alias("alt"), f[2].alias("cigar"), f[3].cast("int").alias("alt_nm"))
    return x.where("alt <> contig AND alt_nm <= nm AND cigar rlike '^[0-9]+M$'").select("read_id", F.col("alt").alias("contig")).distinct()


def pair_regions(split: DataFrame, fragment: int = 200) -> DataFrame:
    """For each side of a candidate the genomic range of 1.25 fragments (and the contig overlap) back from its breakpoint."""
    want = F.lit(int(1.25 * fragment)) + F.greatest(F.lit(0), F.col("ctg_overlap"))
    one = F.when(F.col("strand1") == "+", F.struct((F.col("tright1") - want + 1).alias("s"), F.col("tright1").alias("e"))).otherwise(F.struct(F.col("tleft1").alias("s"), (F.col("tleft1") + want - 1).alias("e")))
    two = F.when(F.col("strand2") == "+", F.struct(F.col("tleft2").alias("s"), (F.col("tleft2") + want - 1).alias("e"))).otherwise(F.struct((F.col("tright2") - want + 1).alias("s"), F.col("tright2").alias("e")))
    return split.withColumn("region1", one).withColumn("region2", two)


def eligible_pair(topology, chrom1, chrom2, orientation):
    """Whether a pair's orientation can come of the topology: mates point at each other unless strands or order changed."""
    return (
        F.when(topology == "interchr", chrom1 != chrom2)
        .when(chrom1 != chrom2, False)
        .when(topology.isin("intrachr-opp-strand", "local-inversion"), orientation.isin("FF", "RR"))
        .when(topology.isin("intrachr-non-colinear", "junction-duplication", "end-duplication"), orientation == "RF")
        .otherwise(orientation == "FR")
    )


def pair_support(regions: DataFrame, pairs: DataFrame, key: list[str], min_mapq: int = 10, width: int = 1000) -> DataFrame:
    """Distinct pairs with one mate in each region: all, and filtered (lower mapq strictly over ``min_mapq``).

    ``pairs`` has pair_id and for k = 1, 2 chromk, leftk, rightk, mapqk. Mates are
    matched to the first region by bins, the second is a residual. Where ``pairs`` has
    intronic (``exonic_fragment_length``), both are also counted without intronic pairs.
    """
    from .intervals import overlap_join

    if "intronic" not in pairs.columns:
        return pair_support(regions, pairs.withColumn("intronic", F.lit(False)), key, min_mapq, width).drop("pairs_exonic", "pairs_filtered_exonic")
    turned = pairs.select("pair_id", "intronic", *[F.col(f"{c}{3 - k}").alias(f"{c}{k}") for k in (1, 2) for c in ("chrom", "left", "right", "mapq")])
    both = pairs.select("pair_id", "intronic", *[f"{c}{k}" for k in (1, 2) for c in ("chrom", "left", "right", "mapq")]).unionByName(turned)
    p = both.select("pair_id", "intronic", F.col("chrom1").alias("chrom"), F.col("left1").alias("fs"), F.col("right1").alias("fe"), F.col("chrom2").alias("pc2"), F.col("left2").alias("pl2"), F.col("right2").alias("pr2"), F.least("mapq1", "mapq2").alias("low"))
    r = regions.select(*key, F.col("chrom1").alias("chrom"), F.col("region1.s").alias("s"), F.col("region1.e").alias("e"), F.col("chrom2").alias("rc2"), F.col("region2.s").alias("s2"), F.col("region2.e").alias("e2"))
    hit = overlap_join(r, p, mode="full_rev", width=width).where("pc2 = rc2 AND pl2 >= s2 AND pr2 <= e2")
    per = hit.groupBy(*key, "pair_id").agg(F.min("low").alias("low"), F.bool_or("intronic").alias("intronic"))
    good, exonic = F.col("low") > min_mapq, ~F.col("intronic")
    return per.groupBy(*key).agg(F.count(F.lit(1)).alias("pairs_all"), F.count(F.when(good, 1)).alias("pairs_filtered"), F.count(F.when(exonic, 1)).alias("pairs_exonic"), F.count(F.when(good & exonic, 1)).alias("pairs_filtered_exonic"))


def support_type(event_type: str, s, e, bp1, bp2, chrom=None, chrom1=None, chrom2=None):
    """DW, T1 or T2 of a read s..e by what it strictly contains; a fusion's breakpoint counts only on the read's chromosome, where these are given."""
    if event_type == "fusion":
        one, two = (s < bp1) & (e > bp1), (s < bp2) & (e > bp2)
        if chrom is not None:
            one, two = one & (chrom == chrom1), two & (chrom == chrom2)
        return F.when(F.coalesce(one, F.lit(False)) | F.coalesce(two, F.lit(False)), "DW").otherwise("T1")
    lo, hi = F.least(bp1, bp2), F.greatest(bp1, bp2)
    return F.when((s < lo) & (e > hi), "DW").when((lo < s) & (hi > e), "T2").otherwise("T1")


def coverage_steps(regions: DataFrame, reads: DataFrame, key: list[str], trim: int = 5, width: int = 1000, keep: list[str] | None = None) -> DataFrame:
    """Reads by support type (DW, T1, T2) where these change along a region (chrom, s, e), its start included, read ends trimmed.

    ``reads`` has chrom, fs, fe; ``regions`` has event_type, bp1, bp2 too. Starts and ends are summed per
    place and added up along the region, so deep coverage is one row per read end, not per base and read. Equal reads
    are counted before they meet regions, and lie together in bins of ``width``, which a region looks up by those it touches: where
    bins are few nothing of the regions is moved, and their sums stay where they are if they lie by part of ``key``. ``keep``
    names columns of the region to return as well.
    """
    c = F.col
    bins = stored(read_bins(reads, trim, width), "reads")
    size = bins.agg(F.sum(F.size("reads")).alias("n")).first().n or 0
    bins = bins.select(c("chrom").alias("__c"), c("bin").alias("__b"), "reads")
    bins = F.broadcast(bins) if size <= FEW_DEPTHS else bins.hint("merge")
    at = regions.withColumn("__bin", F.explode_outer(F.when(c("s") <= c("e"), F.sequence(F.floor(c("s") / width), F.floor(c("e") / width)))))
    j = at.join(bins, (c("chrom") == c("__c")) & (c("__bin") == c("__b")), "left")
    # A read is taken in the first bin that it shares with the region.
    here = F.filter("reads", lambda r: (r["fs"] <= c("e")) & (r["fe"] >= c("s")) & (F.floor(F.greatest(c("s"), r["fs"]) / width) == c("__bin")))

    def kind(r):
        whole = (r["fs"] - trim, r["fe"] + trim, c("bp1"), c("bp2"))
        return F.when(c("event_type") == "fusion", support_type("fusion", *whole)).otherwise(support_type("itd", *whole))

    step = lambda at, kind, d: F.struct(at.alias("at"), kind.alias("kind"), d.alias("d"))
    ends = F.flatten(F.transform(here, lambda r: F.array(step(F.greatest(c("s"), r["fs"]), kind(r), r["n"]), step(F.least(c("e"), r["fe"]) + 1, kind(r), -r["n"]))))
    none = F.array(step(c("s"), F.lit("T1"), F.lit(0).cast("long")))
    start = F.when(c("__bin").isNull() | (c("__bin") == F.floor(c("s") / width)), none).otherwise(F.slice(none, 1, 0))
    keep = keep or []
    moves = j.select(*key, *keep, c("e").alias("__e"), F.explode(F.concat(F.coalesce(ends, F.slice(none, 1, 0)), start)).alias("x"))
    moves = moves.where((c("x.at") <= c("__e")) | (c("x.d") == 0)).select(*key, *keep, "x.*")
    types = ("DW", "T1", "T2")
    sums = moves.groupBy(*key, *keep, "at").agg(*[F.sum(F.when(F.col("kind") == k, F.col("d")).otherwise(0)).alias(f"d{k}") for k in types])
    w = Window.partitionBy(*key).orderBy("at")
    return sums.select(*key, *keep, "at", *[F.sum(f"d{k}").over(w).alias(k) for k in types])


def base_coverage(regions: DataFrame, reads: DataFrame, key: list[str], trim: int = 5, width: int = 1000) -> DataFrame:
    """``coverage_steps`` at each base ``at`` of a region; bases without reads are there with zeros."""
    steps = coverage_steps(regions, reads, key, trim, width, keep=["e"])
    following = F.lead("at").over(Window.partitionBy(*key).orderBy("at")) - 1
    spans = steps.withColumn("__to", F.coalesce(following, F.col("e"))).where("at <= __to")
    return spans.select(*key, F.explode(F.sequence("at", "__to")).alias("at"), "DW", "T1", "T2")


def read_bins(reads: DataFrame, trim: int = 5, width: int = 1000) -> DataFrame:
    """Bins of ``width`` bases that trimmed reads (chrom, fs, fe) touch: chrom, bin, reads (different ones: fs and fe trimmed, n)."""
    trimmed = reads.withColumn("fs", F.col("fs") + trim).withColumn("fe", F.col("fe") - trim).where("fs <= fe AND chrom IS NOT NULL")
    one = trimmed.groupBy("chrom", "fs", "fe").agg(F.count(F.lit(1)).alias("n"))
    placed = one.withColumn("bin", F.explode(F.sequence(F.floor(F.col("fs") / width), F.floor(F.col("fe") / width))))
    return placed.groupBy("chrom", "bin").agg(F.collect_list(F.struct("fs", "fe", "n")).alias("reads"))


def coverage_bins(reads: DataFrame, trim: int = 5, width: int = 240) -> DataFrame:
    """Bins of ``width`` bases that trimmed reads (chrom, fs, fe) touch: chrom, bin, depth (of each base), reads (different ones, fs and fe trimmed)."""
    trimmed = reads.withColumn("fs", F.col("fs") + trim).withColumn("fe", F.col("fe") - trim).where("fs <= fe AND chrom IS NOT NULL")
    one = trimmed.groupBy("chrom", "fs", "fe").agg(F.count(F.lit(1)).alias("n"))
    placed = one.withColumn("bin", F.explode(F.sequence(F.floor(F.col("fs") / width), F.floor(F.col("fe") / width))))
    first, end = F.col("bin") * width, (F.col("bin") + 1) * width
    ends = F.array(F.struct(F.greatest("fs", first).alias("at"), F.col("n").alias("d")), F.struct((F.col("fe") + 1).alias("at"), (-F.col("n")).alias("d")), F.struct(first.alias("at"), F.lit(0).cast("long").alias("d")))
    moves = placed.select("chrom", "bin", F.explode(ends).alias("x")).select("chrom", "bin", "x.*").where(F.col("at") < end).groupBy("chrom", "bin", "at").agg(F.sum("d").alias("d"))
    w = Window.partitionBy("chrom", "bin").orderBy("at")
    spans = moves.select("chrom", "bin", "at", F.sum("d").over(w).alias("depth"), F.coalesce(F.lead("at").over(w), end).alias("to"))
    in_order = F.array_sort(F.collect_list(F.struct("at", "depth", "to")))
    depth = spans.groupBy("chrom", "bin").agg(F.flatten(F.transform(in_order, lambda x: F.array_repeat(x["depth"], (x["to"] - x["at"]).cast("int")))).alias("depth"))
    return depth.join(placed.groupBy("chrom", "bin").agg(F.collect_list(F.struct("fs", "fe")).alias("reads")), ["chrom", "bin"])


def peak_coverage(regions: DataFrame, reads: DataFrame, member: list[str], trim: int = 5, width: int = 240, region: str = "region") -> DataFrame:
    """Per ``member`` the most reads at a base of its regions A and B: plain_a and plain_b of bases without T2 reads, inner_a and inner_b of those with some.

    ``regions`` (``member``, region, chrom, s, e, event_type, bp1, bp2) and ``reads`` as in ``coverage_steps``. Depths are worked
    out once for bins of the genome, and a region looks into the one or two that it touches, so no row is made for a region and
    a read. Only where a region is no fusion's are reads looked at one by one, in its row. A base without T2 reads
    is there in each region that no read reaches; inner is null where there is no base of its kind, and so is plain.
    """
    bins = stored(coverage_bins(reads, trim, width), "depths")
    size = bins.agg(F.sum(F.size("depth") + F.size("reads")).alias("n")).first().n or 0
    bins = bins.select(F.col("chrom").alias("__c"), F.col("bin").alias("__b"), "depth", "reads")
    bins = F.broadcast(bins) if size <= FEW_DEPTHS else bins.hint("merge")
    c = F.col
    at = regions.withColumn("__bin", F.explode_outer(F.when(c("s") <= c("e"), F.sequence(F.floor(c("s") / width), F.floor(c("e") / width)))))
    j = at.join(bins, (c("chrom") == c("__c")) & (c("__bin") == c("__b")), "left")
    first, last = F.greatest("s", c("__bin") * width), F.least(c("e"), (c("__bin") + 1) * width - 1)
    lo, hi = F.least("bp1", "bp2"), F.greatest("bp1", "bp2")
    depths = F.slice("depth", (first - c("__bin") * width + 1).cast("int"), (last - first + 1).cast("int"))
    within = F.filter("reads", lambda r: (r["fs"] - trim > lo) & (r["fe"] + trim < hi) & (r["fs"] <= last) & (r["fe"] >= first))
    inside = F.when((c("event_type") == "fusion") | (hi - lo < 2), None).otherwise(within)
    j = j.select(*member, region, depths.alias("depths"), inside.alias("inside"), first.alias("first"), last.alias("last"))
    flags = F.transform(F.sequence("first", "last"), lambda p: F.exists("inside", lambda r: (r["fs"] <= p) & (r["fe"] >= p)))
    j = j.select(*member, region, "depths", F.when(F.size("inside") > 0, flags).alias("flags"))
    some = c("flags").isNotNull()
    plain = F.when(some, F.array_max(F.zip_with("depths", "flags", lambda d, f: F.when(~f, d)))).otherwise(F.coalesce(F.array_max("depths"), F.lit(0).cast("long")))
    inner = F.when(some, F.array_max(F.zip_with("depths", "flags", lambda d, f: F.when(f, d))))
    j = j.select(*member, region, plain.alias("plain"), inner.alias("inner"))
    return j.groupBy(*member).agg(*_sides(region))


def _sides(region: str) -> list:
    return [F.max(F.when(F.col(region) == r, F.col(k))).alias(f"{k}_{r.lower()}") for r in "AB" for k in ("plain", "inner")]


def relative_coverage(coverage: DataFrame, reads_on_contig: DataFrame | None, member: list[str], region: str = "region") -> DataFrame:
    """Per member W and T of both regions and the ratios of its contig's reads C to them.

    ``coverage`` are bases, steps (both serve, as only the highest count) or what ``peak_coverage`` returns; without
    ``reads_on_contig`` it has C itself. T adds the three types; W is T - C, and 2 C less again where T2 reads are. The
    base of the highest W (of several, the highest T) stands for a region; a ratio
    whose divisor is not above zero is 999999.
    """
    c = F.col
    if "plain_a" not in coverage.columns:
        t = c("DW") + c("T1") + c("T2")
        high = coverage.withColumn("plain", F.when(c("T2") > 0, None).otherwise(t)).withColumn("inner", F.when(c("T2") > 0, t))
        coverage = high.groupBy(*member, *([] if reads_on_contig is not None else ["C"])).agg(*_sides(region))
    wide = coverage if reads_on_contig is None else coverage.join(reads_on_contig, member)
    for r in "ab":
        plain, inner = c(f"plain_{r}"), c(f"inner_{r}")
        # Of two bases of one W that with T2 reads has the higher T.
        taken = inner.isNotNull() & (plain.isNull() | (inner - 3 * c("C") >= plain - c("C")))
        wide = wide.withColumn(f"W_{r}", F.when(taken, inner - 3 * c("C")).otherwise(plain - c("C"))).withColumn(f"T_{r}", F.when(taken, inner).otherwise(plain))
    wide = wide.select(*member, "C", "W_a", "T_a", "W_b", "T_b")
    for name, f in (("min", F.least), ("max", F.greatest), ("avg", lambda a, b: (F.col(a) + F.col(b)) / 2.0)):
        for x in "WT":
            wide = wide.withColumn(f"{x}_{name}", f(f"{x}_a", f"{x}_b"))
    for name in ("a", "b", "min", "max", "avg"):
        for x in "WT":
            v = F.col(f"{x}_{name}")
            wide = wide.withColumn(f"C_{x}_{name}", F.when(v > 0, F.col("C") / v).otherwise(999999.0))
    return wide


def event_coverage(members: DataFrame, key: str) -> DataFrame:
    """Least, greatest and mean of every ratio of ``relative_coverage`` over an event's members."""
    ratios = [c for c in members.columns if c.startswith("C_")]
    return members.groupBy(key).agg(*[f(c).alias(f"{name}_{c}") for c in ratios for name, f in (("min", F.min), ("max", F.max), ("mean", F.avg))])


def exonic_fragment_length(blocks, left, right, mate_left, mate_right):
    """struct(length, intronic): bases between the outer ends of two mates that lie on ``blocks``; intronic where a mate's own bases partly don't."""
    lo, hi = F.least(left, mate_left), F.greatest(right, mate_right)
    on = lambda s, e: F.aggregate(blocks, F.lit(0).cast("long"), lambda a, b: a + F.greatest(F.lit(0), F.least(e, b["e"]) - F.greatest(s, b["s"]) + 1))
    off = (on(left, right) < right - left + 1) | (on(mate_left, mate_right) < mate_right - mate_left + 1)
    return F.struct(on(lo, hi).alias("length"), off.alias("intronic"))


def gap_pair_rule(topology, length, orientation, beyond_left, beyond_right, fragment: int = 200, fract: float = 0.1):
    """Whether a pair supports a gapped event: short fragments span a duplication, long or turned-about ones a distant
    copy, mates of one strand an inversion (for an inner one, if they reach beyond the region on their side)."""
    short, long_ = F.abs(length) <= (1 - fract) * fragment, F.abs(length) > (1 + fract) * fragment
    return (
        F.when(topology == "gap-tandem-duplication", short)
        .when(topology == "gap-nontandem-duplication", short | long_ | (orientation == "RF"))
        .when(topology.contains("inverted_duplication"), short | orientation.isin("FF", "RR"))
        .when(topology == "gap-internal_inversion", ((orientation == "RR") & beyond_right) | ((orientation == "FF") & beyond_left))
        .otherwise(False)
    )


def coverage_regions(split: DataFrame, read_length: int = 75) -> DataFrame:
    """region1 and region2: two read lengths (and the contig overlap) of each side back from its breakpoint."""
    return pair_regions(split, fragment=int(2 * read_length / 1.25))

"""Filters over events and their members.

A member filter is met by an event if any one member passes it, and different
members may meet different filters; NO_GOOD_MEMBERS fails an event of which no
single member passes all. Group filters fail the whole event.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_homopolymer, is_run_soft, normalize_chrom


@dataclass(frozen=True)
class Options:
    strong: int = 5
    all_reads: int = 100
    require_strong: bool = False
    pairs: int = 1
    pairs_filtered: int = 0
    ignore_introns: bool = True
    aligners: int = 2
    max_groups: int = 3
    min_identity: float = 99.0
    mismatches: int = 1
    max_overlap: int = 75
    min_represented: float = 0.90
    ignored: tuple[str, ...] = ("end-duplication",)


def adjusted_identity(span: Column, o: Options) -> Column:
    """The identity asked for, lowered so far that so many mismatches pass in short alignments."""
    allowed = F.floor(1000.0 * F.greatest(F.lit(1), span - o.mismatches) / span) / 10.0
    return F.least(allowed, F.lit(o.min_identity))


def gap_adjusted_identity(limit: Column, q_span: Column, t_span: Column, aligned: Column, internal: Column, o: Options) -> Column:
    inserts = F.when(internal, 1).otherwise(0)
    bad = 1000.0 * (o.mismatches + inserts + F.round(3 * F.log1p(F.greatest(F.lit(0), q_span - t_span).cast("double")))) / aligned
    return F.least(F.floor((100.0 - bad * 0.1) * 10) / 10.0, limit)


def member_filters(o: Options = Options()) -> dict[str, Column]:
    """What a member must be, by the reason that its event fails for if none is."""
    c = F.col
    reads = c("strong") >= o.strong
    limit_a = adjusted_identity(c("span_a"), o)
    gap_a = gap_adjusted_identity(limit_a, c("span_a"), c("tspan_a"), c("aligned_a"), ~c("edge_gap"), o)
    return {
        "READS_TO_CONTIG": reads if o.require_strong else reads | (c("reads_all") >= o.all_reads),
        "TOO_MANY_GROUPS": c("num_groups") <= o.max_groups,
        "PERCENT_IDENTITY": (c("pid_a") >= F.when(c("gap"), gap_a).otherwise(limit_a)) & (c("pid_b") >= adjusted_identity(c("span_b"), o)),
        "GAP_RUN": ~c("gap") | ~is_run_soft("event_seq"),
        "CONTIG_OVERLAP": c("gap") | (c("ctg_overlap") <= o.max_overlap),
        "CONTIG_REPRESENTED": c("represented") >= o.min_represented,
        "MULTI_MAPS": c("multi_mapped") == 0,
        "POLY_A": ~(c("gap") & c("edge_gap") & is_homopolymer("event_seq")),
        "IGNORED_TOPOLOGY": ~c("topology").isin(*o.ignored),
    }


def group_filters(o: Options = Options()) -> dict[str, Column]:
    """Aggregates that are true where the whole event fails; SINGLE_ALIGN and REPEAT_SEQ are off unless named."""
    kind = "_exonic" if o.ignore_introns else ""
    return {
        "PAIR_SUPPORT": (F.max(f"pairs{kind}") < o.pairs) | (F.max(f"pairs_filtered{kind}") < o.pairs_filtered),
        "RNA_REPEAT": F.bool_or("rna"),
        "MITOCHONDRIAL": F.bool_or(mitochondrial("chrom1") | mitochondrial("chrom2")),
        "REPEAT_SEQ": F.bool_or("has_repeat"),
        "SINGLE_ALIGN": (F.max("num_aligners") < o.aligners) & ~F.bool_or("gap"),
    }


def mitochondrial(chrom: str) -> Column:
    """The chromosome is M, however it is written."""
    return F.coalesce(normalize_chrom(F.col(chrom).cast("string")) == "M", F.lit(False))


def gap_represented() -> Column:
    """Represented share of a gapped member's contig.

    What its alignment (ctg_s..ctg_e) covers before and after the gap (gap_s..gap_e),
    and what the gap's own alignment (part_s..part_e) covers inside the gap; where that
    lies outside, a duplication counts by its copy's place (dup_s..dup_e).
    """
    c = F.col
    one_side = lambda s, e: F.when(e <= s, 0).otherwise(e - s + 1)
    inside = lambda s, e: F.least(c("gap_e"), c(e)) - F.greatest(c("gap_s"), c(s)) + 1
    own, copy = inside("part_s", "part_e"), inside("dup_s", "dup_e")
    gap = F.when((own < 1) & c("topology").contains("dup"), copy).otherwise(own)
    return (one_side(c("ctg_s"), c("gap_s") - 1) + one_side(c("gap_e") + 1, c("ctg_e")) + F.greatest(F.lit(0), gap)).cast("double") / c("ctg_len")


def filter_groups(members: DataFrame, o: Options = Options(), key: str = "group_id", group_reasons: tuple[str, ...] = ("PAIR_SUPPORT", "RNA_REPEAT", "MITOCHONDRIAL")) -> DataFrame:
    """``key``, status and fail_reasons (sorted, comma-joined) of each event: one aggregation."""
    one = {k: F.coalesce(v, F.lit(False)) for k, v in member_filters(o).items()}
    whole = None
    for v in one.values():
        whole = v if whole is None else whole & v
    tests = {k: ~F.bool_or(v) for k, v in one.items()} | {k: v for k, v in group_filters(o).items() if k in group_reasons} | {"NO_GOOD_MEMBERS": ~F.bool_or(whole)}
    g = members.groupBy(key).agg(*[v.alias(k) for k, v in tests.items()])
    reasons = F.array_sort(F.filter(F.array(*[F.when(F.coalesce(F.col(k), F.lit(False)), F.lit(k)) for k in tests]), lambda x: x.isNotNull()))
    return g.select(key, F.when(F.size(reasons) == 0, "pass").otherwise("fail").alias("status"), F.array_join(reasons, ",").alias("fail_reasons"))


def prune_members(members: DataFrame, o: Options = Options()) -> DataFrame:
    """``members`` with kept: passes every member filter."""
    ok = None
    for v in member_filters(o).values():
        v = F.coalesce(v, F.lit(False))
        ok = v if ok is None else ok & v
    return members.withColumn("kept", ok)


def rebuilt(pruned: DataFrame, key: str = "group_id") -> DataFrame:
    """Member counts and topologies of events over the kept members."""
    return pruned.where("kept").groupBy(key).agg(F.count(F.lit(1)).alias("n_members"), F.array_sort(F.collect_set("topology")).alias("topologies"))


def low_score_members(members: DataFrame, score: str, least: float, key: str = "group_id") -> DataFrame:
    """Event sizes without the members under a score."""
    return members.where(F.col(score) >= least).groupBy(key).agg(F.count(F.lit(1)).alias("n_members"))


def restrict_genes(genes: DataFrame, names: DataFrame, column: str = "gene") -> DataFrame:
    """Member genes that are in a list of names."""
    return genes.join(names.select(column).distinct(), column, "left_semi")


def sort_groups(members: DataFrame, key: str = "group_id") -> DataFrame:
    """Events by falling strong support, then id."""
    return members.groupBy(key).agg(F.max("strong").alias("support")).orderBy(F.desc("support"), key)


def check_events(members: DataFrame) -> DataFrame:
    """``members`` with problems, the messages of the rules that a row breaks, and good (none).

    Rules on columns that ``members`` lacks are left out. Gapped rows have ctg_strand and
    event_strand (those of the two alignments), gap_s and gap_e, bg_s and ag_s (null: the
    contig's alignment does not reach before, past the gap), dup_s and dup_e (null: none)
    and dist, the bases between the event (qs2..qe2) and its copy.
    """
    c = F.col
    between = F.when(c("qs2") <= c("dup_s"), c("dup_s") - c("qe2") - 1).otherwise(c("qs2") - c("dup_e") - 1)
    rules = {
        "bad group id": c("group_id").isNull() | (c("group_id") < 0),
        "bad counts": (c("strong") < 0) | (c("strong") > c("reads_all")),
        "bad strand": ~c("strand1").isin("+", "-") | ~c("strand2").isin("+", "-"),
        "contig order": c("qs1") > c("qs2"),
        "gap without sequence": c("gap") & (F.length("event_seq") == 0),
    }
    gapped = {
        "exon bounds": (["exon_bounds"], ~c("exon_bounds").isin(0, 1, 2)),
        "contig strand": (["ctg_strand"], c("gap") & (c("ctg_strand") != c("strand1"))),
        "event strand": (["event_strand"], c("gap") & (c("event_strand") != c("strand2"))),
        "gap order": (["gap_s", "gap_e"], c("gap") & (c("gap_s") >= c("gap_e"))),
        "no bases before gap": (["bg_s", "gap_e"], c("gap") & c("bg_s").isNull() & (c("gap_e") >= c("qs1"))),
        "no bases after gap": (["ag_s", "gap_s", "qe1"], c("gap") & c("ag_s").isNull() & (c("gap_s") <= c("qe1"))),
        "copy order": (["dup_s", "dup_e"], c("gap") & (c("dup_s") >= c("dup_e"))),
        "copy distance": (["dist", "dup_s", "dup_e", "qe2"], c("gap") & (c("dist") != between)),
    }
    rules |= {k: test for k, (needs, test) in gapped.items() if {*needs} <= {*members.columns}}
    found = F.filter(F.array(*[F.when(v, F.lit(k)) for k, v in rules.items()]), lambda x: x.isNotNull())
    return members.withColumn("problems", found).withColumn("good", F.size("problems") == 0)

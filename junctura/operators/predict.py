"""Event prediction: fusions, partial and internal tandem duplications."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import contains_but_edge, is_homopolymer, most_copies, reverse_complement, shares_run
from .intervals import PLACES

#: Genes with the lengths of their duplicates are broadcast up to this many.
FEW_GENES = 100_000
#: Bytes of sequences that are compared with themselves at once; a longer sequence is taken whole.
PIECE = 1 << 20


def overlaps_gene(member_gene: DataFrame, keys: list[str], introns: bool = False, utr: bool = True) -> DataFrame:
    """Keys (with region) that have an accepted gene part."""
    parts = ["exon"] + ["intron"] * introns + ["utr"] * utr
    return member_gene.where(F.col("feature").isin(*parts)).select(*keys).distinct()


def side_genes(member_gene: DataFrame, keys: list[str]) -> DataFrame:
    """genes_a, genes_b (exon or utr if a side has any, else intron ones), coding_a, coding_b of each member."""
    exon = F.col("feature") != "intron"
    out = []
    for r in "AB":
        here = F.col("region") == r
        out += [F.collect_set(F.when(here & exon, F.col("gene"))).alias(f"x{r}"), F.collect_set(F.when(here, F.col("gene"))).alias(f"all{r}"), F.collect_set(F.when(here & (F.col("feature") == "exon"), F.col("gene"))).alias(f"coding_{r.lower()}")]
    g = member_gene.groupBy(*keys).agg(*out)
    best = lambda r: F.array_sort(F.when(F.size(f"x{r}") > 0, F.col(f"x{r}")).otherwise(F.col(f"all{r}")))
    return g.select(*keys, best("A").alias("genes_a"), best("B").alias("genes_b"), F.array_sort("coding_a").alias("coding_a"), F.array_sort("coding_b").alias("coding_b"))


def gene_sets_overlap(sides: DataFrame) -> DataFrame:
    """shared: a gene on both sides, with those nearby (``nearby_a``, ``nearby_b``) where ``sides`` has them."""
    both = lambda r: F.array_union(f"genes_{r}", F.coalesce(f"nearby_{r}", F.array().cast("array<string>"))) if f"nearby_{r}" in sides.columns else F.col(f"genes_{r}")
    return sides.withColumn("shared", F.arrays_overlap(both("a"), both("b")))


def preferred_genes(found: DataFrame, keys: list[str]) -> DataFrame:
    """Of each member's region the genes of the least ``source`` that has any: 0 at the breakpoint, 1 of the region, 2 nearby.

    Genes nearby overlap nothing, so an intron among them is no lesser part: their feature is nearby.
    """
    least = F.min("source").over(Window.partitionBy(*keys, "region"))
    kept = found.withColumn("__least", least).where(F.col("source") == F.col("__least"))
    return kept.withColumn("feature", F.when(F.col("source") == 2, "nearby").otherwise(F.col("feature"))).drop("__least", "source").distinct()


def orientation(member_gene: DataFrame, directions: DataFrame, keys: list[str]) -> DataFrame:
    """Per member and region +, -, * (genes disagree) or ? (none) of its genes' directions relative to the alignment's ``strand``.

    Where a region has genes by more than an intron, those of introns alone don't count.
    """
    more = F.max(F.col("feature") != "intron").over(Window.partitionBy(*keys, "region"))
    d = member_gene.withColumn("__more", more).where(~F.col("__more") | (F.col("feature") != "intron")).join(directions, "gene", "left")
    same = F.when(F.col("direction") == "*", "*").when(F.col("direction") == F.col("strand"), "+").when(F.col("direction").isNotNull(), "-")
    o = d.groupBy(*keys, "region").agg(F.collect_set(same).alias("o"))
    one = F.when(F.size("o") == 0, "?").when((F.size("o") == 1), F.col("o")[0]).otherwise("*")
    return o.groupBy(*keys).agg(*[F.coalesce(F.max(F.when(F.col("region") == r, one)), F.lit("?")).alias(f"orient_{r.lower()}") for r in "AB"])


def _direction(*bits):
    """The one direction of the first of ``bits`` (1: +, 2: -, 4: *, 8: none known) that is there: +, -, * (genes disagree) or ? (none)."""
    known = F.coalesce(*bits).bitwiseAND(F.lit(7))
    return F.when(known == 0, "?").when(known == 1, "+").when(known == 2, "-").otherwise("*")


def _bits(direction):
    return F.when(direction == "+", 1).when(direction == "-", 2).when(direction == "*", 4).otherwise(8)


def place_genes(hits: DataFrame, at: tuple[str, ...] = ("chrom", "coord")) -> DataFrame:
    """Per place its genes (exon or utr if it has any, else intron ones), coding genes, and direction.

    ``hits(chrom, coord, gene, feature, direction)``: features around a place. A place is worked out once for all members that
    have a breakpoint there; ``at_places`` brings it to them, with the results of ``side_genes`` and ``orientation``.
    """
    exon, bits = F.col("feature") != "intron", _bits(F.col("direction"))
    g = hits.groupBy(*at).agg(
        F.collect_set(F.when(exon, F.col("gene"))).alias("__more"), F.collect_set("gene").alias("__all"), F.array_sort(F.collect_set(F.when(F.col("feature") == "exon", F.col("gene")))).alias("coding"),
        F.bit_or(F.when(exon, bits)).alias("__x"), F.bit_or(bits).alias("__b"),
    )
    return g.select(*at, F.array_sort(F.when(F.size("__more") > 0, F.col("__more")).otherwise(F.col("__all"))).alias("genes"), "coding", _direction(F.col("__x"), F.col("__b")).alias("direction"))


def place_directions(hits: DataFrame, at: tuple[str, ...] = ("chrom", "coord")) -> DataFrame:
    """Per place the direction of its ``preferred_genes``: those of the least ``source`` (0, 1, 2: nearby), by more than an intron where there are any."""
    exon, bits = F.col("feature") != "intron", _bits(F.col("direction"))
    kinds = [when for k in (0, 1) for when in ((F.col("source") == k) & exon, F.col("source") == k)] + [F.col("source") == 2]
    g = hits.groupBy(*at).agg(*[F.bit_or(F.when(w, bits)).alias(f"__{i}") for i, w in enumerate(kinds)])
    return g.select(*at, _direction(*[F.col(f"__{i}") for i in range(len(kinds))]).alias("direction"))


def at_places(members: DataFrame, places: DataFrame, how: str = "left", width: int = PLACES) -> DataFrame:
    """``members`` (chrom_a, coord_a, chrom_b, coord_b, strand1, strand2) with what ``places`` has of both sides, and orient_a, orient_b from the directions.

    ``places`` are of one coord each, or of ranges (bin, s, e) in bins of ``width`` (``near_ranges``), which then are looked up by bin.
    Sides without a place have empty sets and the orientation ?; ``how='inner'`` leaves out members with such a side.
    Sets of genes are many times as large in memory as in a file, so ``places`` are not broadcast by file size.
    """
    at = ["chrom", "bin", "s", "e"] if "bin" in places.columns else ["chrom", "coord"]
    names = [c for c in places.columns if c not in at]
    for r, strand in (("a", "strand1"), ("b", "strand2")):
        coord = F.col(f"coord_{r}")
        p = places.select(*[F.col(c).alias(f"__{c}") for c in at], *[F.col(c).alias(f"{c}_{r}") for c in names]).hint("merge")
        on = F.col(f"chrom_{r}") == F.col("__chrom")
        on &= coord == F.col("__coord") if "coord" in at else (F.floor(coord / width) == F.col("__bin")) & coord.between(F.col("__s"), F.col("__e"))
        members = members.join(p, on, how).drop(*[f"__{c}" for c in at])
        if how == "left":
            members = members.withColumns({f"{c}_{r}": F.coalesce(f"{c}_{r}", F.lit("?") if c == "direction" else F.array().cast("array<string>")) for c in names})
        d = F.col(f"direction_{r}")
        members = members.withColumn(f"orient_{r}", F.when(d.isin("?", "*"), d).when(d == F.col(strand), "+").otherwise("-")).drop(f"direction_{r}")
    return members


def predict_fusion(members: DataFrame, min_unique: int = 5, min_exon_bounds: int = 0) -> DataFrame:
    """Members that can be fusions.

    Not gapped, no duplication, ranges apart and no gene on both sides unless on two
    chromosomes, genes of known direction on both sides, enough bases of its own on each
    side (a space between the alignments adds to them), and ``exon_bounds`` junctions on
    exon bounds where any are asked for.
    """
    c = F.col
    shared = ((c("tleft1") <= c("tleft2")) & (c("tleft2") < c("tright1"))) | ((c("tleft2") < c("tleft1")) & (c("tleft1") < c("tright2")))
    apart = (c("chrom1") != c("chrom2")) | ~shared
    own = F.least(c("qe1") - c("qs1"), c("qe2") - c("qs2")) + 1 - c("ctg_overlap")
    ok = ~c("gap") & apart & ~c("topology").isin("end-duplication", "junction-duplication") & (F.size("genes_a") > 0) & (F.size("genes_b") > 0)
    if min_exon_bounds > 0:
        ok &= c("exon_bounds") >= min_exon_bounds
    other = (c("topology") == "interchr") | ~F.arrays_overlap("genes_a", "genes_b")
    return members.where(ok & (own >= min_unique) & other & (c("orient_a") != "?") & (c("orient_b") != "?"))


def fusion_ends(members: DataFrame) -> DataFrame:
    """end_a and end_b: which of 5' and 3' of the fusion each side's genes give."""
    a, b = F.col("orient_a"), F.col("orient_b")
    pair = F.when(a.isin("+", "*") & b.isin("+", "*"), F.lit("53")).when(a.isin("-", "*") & b.isin("-", "*"), F.lit("35")).when((a == "+") & (b == "-"), F.lit("55")).when((a == "-") & (b == "+"), F.lit("33"))
    return members.withColumn("end_a", F.substring(pair, 1, 1)).withColumn("end_b", F.substring(pair, 2, 1))


def route_fusions(fusions: DataFrame, key: str, order: list[str], read_through: int = 50_000) -> DataFrame:
    """``key``, route and n_members of each event.

    The first member, by ``order``, that is near and colinear (read_through), or joins
    copies of a gene on two chromosomes (duplicate_gene), decides. Else an event is
    mixed_sense if both ends are alike in all its members, and main otherwise.
    """
    c = F.col
    near = c("topology").isin("read-through", "intrachr-same-strand") & (c("target_distance") < read_through)
    copies = (c("topology") == "interchr") & F.arrays_overlap("genes_a", "genes_b")
    special = F.when(near, "read_through").when(copies, "duplicate_gene")
    mixed = F.coalesce(c("end_a") == c("end_b"), F.lit(False))
    first = F.min(F.when(special.isNotNull(), F.struct(*order, special.alias("special")))).alias("__first")
    g = fusions.groupBy(key).agg(first, F.bool_and(mixed).alias("__mixed"), F.count(F.lit(1)).alias("n_members"))
    return g.select(key, F.coalesce(F.col("__first.special"), F.when(F.col("__mixed"), "mixed_sense").otherwise("main")).alias("route"), "n_members")


def predict_ptd(members: DataFrame) -> DataFrame:
    """Partial tandem duplications: both junctions on exon bounds, and a coding gene on both sides."""
    return members.where(F.col("topology").isin("junction-duplication", "end-duplication", "intrachr-non-colinear") & (F.col("exon_bounds") == 2) & F.arrays_overlap("coding_a", "coding_b"))


def predict_itd(members: DataFrame, topologies: tuple[str, ...] = ("gap-tandem-duplication", "gap-nontandem-duplication"), min_edge: float = 0.8, allow_non_gap: bool = False) -> DataFrame:
    """Internal tandem duplications: not both ends on exon bounds, no repeat, a coding gene at the breakpoint.

    Of an edge gap ``aligned_span`` must be ``min_edge`` of ``gap_span``. With
    ``allow_non_gap`` split members of a duplication's topology count too, if both sides
    have a coding gene and share a gene.
    """
    c = F.col
    gapped = c("topology").isin(*topologies) & (~c("edge_gap") | (c("aligned_span").cast("double") / c("gap_span") >= min_edge)) & (F.size("coding_a") > 0)
    kind = c("gap") & gapped
    if allow_non_gap:
        split = c("topology").isin("end-duplication", "intrachr-non-colinear", "junction-duplication") & (F.size("coding_a") > 0) & (F.size("coding_b") > 0) & F.arrays_overlap("genes_a", "genes_b")
        kind = kind | (~c("gap") & split)
    return members.where(kind & (c("exon_bounds") != 2) & ~c("has_repeat"))


def route_itds(itds: DataFrame, key: str, order: list[str], full: float = 0.25) -> DataFrame:
    """``key`` and route of each event.

    The first edge gap by ``order`` decides: full where ``full`` of the contig or more is
    aligned on both sides, else edge; without one it is internal. _multi_exon follows
    where a member up to there (or any, of an internal event) has several exons.
    """
    at = F.struct(*order)
    edge = F.min(F.when(F.col("edge_gap"), F.struct(at.alias("at"), (F.least("fraction_a", "fraction_b") >= full).alias("full")))).alias("__edge")
    g = itds.groupBy(key).agg(edge, F.min(F.when(F.col("n_exons") > 1, at)).alias("__many"))
    kind = F.when(F.col("__edge").isNull(), "internal").when(F.col("__edge.full"), "full").otherwise("edge")
    many = F.col("__many").isNotNull() & (F.col("__edge").isNull() | (F.col("__many") <= F.col("__edge.at")))
    return g.select(key, F.concat(kind, F.when(many, "_multi_exon").otherwise("")).alias("route"))


def process_groups(predicted: dict[str, DataFrame], key: str = "group_id") -> DataFrame:
    """Events by predicted type with the good members alone; one event may have several types."""
    out = None
    for name, d in predicted.items():
        g = d.groupBy(key).agg(F.count(F.lit(1)).alias("n_members")).withColumn("event_type", F.lit(name))
        out = g if out is None else out.unionByName(g)
    return out


def best_contig_alignment(aln: DataFrame, edge: int = 5) -> DataFrame:
    """Per contig the alignment of the most matches; perfect: fewer than ``edge`` bases unmatched; starts, ends: one near each end."""
    m = F.col("qend") - F.col("qstart") + 1 - F.col("mismatch")
    return aln.groupBy("query").agg(
        F.max_by("aln_no", F.struct(m, -F.col("aln_no"))).alias("best_no"),
        F.max(m).alias("matches"),
        (F.max(m) > F.max("query_len") - edge).alias("perfect"),
        F.bool_or(F.col("qstart") - 1 < edge).alias("starts"),
        F.bool_or(F.col("query_len") - F.col("qend") < edge).alias("ends"),
    )


def region_gene_sets(hits: DataFrame, keys: list[str], min_overlap: float = 0.70, within: int = 10) -> DataFrame:
    """Transcripts that cover over ``min_overlap`` of a side and match within ``within`` of the best."""
    h = hits.where(F.col("fraction") > min_overlap)
    best = F.max("match").over(Window.partitionBy(*keys))
    return h.withColumn("__b", best).where(F.col("match") >= F.col("__b") - within).groupBy(*keys).agg(F.array_sort(F.collect_set("gene")).alias("genes"))


def recheck_fusion(
    fusions: DataFrame,
    best: DataFrame,
    times: float = 1.5,
    sequences: DataFrame | None = None,
    hits: DataFrame | None = None,
    transcripts: DataFrame | None = None,
    keys: tuple[str, ...] = ("contig", "no1", "no2"),
    min_overlap: float = 0.70,
    within: int = 10,
) -> DataFrame:
    """Without contigs that one alignment explains: perfect, or matching over ``times`` the longer side.

    With ``sequences`` (contig, seq) also without those whose rest past the first side is
    a poly-A tail (or poly-T before the second), and those whose rest, but for its first or
    last base, repeats the aligned side. With ``hits`` (contig, target, qstart, qend, match) also without
    those whose sides align to one transcript. Side A runs from the contig's start to ``qe1``, B from ``qs2`` to its end; a hit counts
    if it shares over ``min_overlap`` of the shorter of both and its matches are less than ``within`` below the best that does, and of
    equal matches the smallest target is best. With ``transcripts`` (target, seq) without
    those whose rest past (or before) the best hit of a side is repeated in that hit, or is in its transcript,
    on either strand and but for its first or last base. Contigs without a sequence and hits without a
    transcript's sequence drop nothing. All joins are equi-joins, by contig, ``keys`` (unique) and target.
    """
    longer = F.greatest(F.col("qe1") - F.col("qs1"), F.col("qe2") - F.col("qs2")) + 1
    j = fusions.join(best.select(F.col("query").alias("contig"), "matches", "perfect"), "contig", "left")
    j = j.where(~F.coalesce("perfect", F.lit(False)) & ~F.coalesce(F.col("matches") > times * longer, F.lit(False))).drop("matches", "perfect")
    if sequences is None:
        return j
    part = lambda s, e: F.substring("__seq", s.cast("int"), F.greatest(F.lit(0), e - s + 1).cast("int"))
    s = sequences.select("contig", F.lower("seq").alias("__seq"))
    n, one = F.length("__seq"), F.lit(1)
    after, before = part(F.col("qe1") + 1, n), part(one, F.col("qs2") - 1)
    tail = after.rlike("^.?a*$") | before.rlike("^t*.?$")
    again = contains_but_edge(part(F.col("qs1"), F.col("qe1")), after) | contains_but_edge(part(F.col("qs2"), F.col("qe2")), before)
    j = j.join(s, "contig", "left").where(~F.coalesce(tail | again, F.lit(False)))
    if hits is None:
        return j.drop("__seq")
    # A contig's hits go to its members as one array, and what both sides show is seen in the member's row: nothing is joined back.
    keys, c = list(keys), F.col
    j = j.join(hits.groupBy("contig").agg(F.collect_list(F.struct("match", "target", "qstart", "qend")).alias("__hits")), "contig", "left")

    def on_side(s, e):
        shared = lambda h: F.least(e, h["qend"]) - F.greatest(s, h["qstart"]) + 1
        return F.filter("__hits", lambda h: shared(h).cast("double") / F.least(e - s + 1, h["qend"] - h["qstart"] + 1) > min_overlap)

    j = j.withColumns({"__a": on_side(one, c("qe1")), "__b": on_side(c("qs2"), c("ctg_len"))})
    near = lambda r: F.filter(f"__{r}", lambda h: h["match"] > F.array_max(F.transform(f"__{r}", lambda g: g["match"])) - within)
    j = j.withColumns({"__a": near("a"), "__b": near("b")}).drop("__hits")
    best_of = lambda r: F.array_min(F.transform(f"__{r}", lambda h: F.struct((-h["match"]).alias("m"), h["target"].alias("target"), h["qstart"].alias("s"), h["qend"].alias("e"))))
    targets = lambda r: F.transform(f"__{r}", lambda h: h["target"])
    # Exploded, as one row, so that what is asked of it below doesn't work it out again.
    seen = F.struct(F.coalesce(F.arrays_overlap(targets("a"), targets("b")), F.lit(False)).alias("one"), best_of("a").alias("a"), best_of("b").alias("b"))
    j = j.select(*fusions.columns, "__seq", F.explode(F.array(seen)).alias("__x")).where("NOT __x.one")
    if transcripts is not None:
        a, b = c("__x.a"), c("__x.b")
        rests = {"a": part(a["e"] + 1, n), "b": part(one, b["s"] - 1)}
        again = [F.coalesce(contains_but_edge(part(c(f"__x.{r}.s"), c(f"__x.{r}.e")), rest), F.lit(False)) for r, rest in rests.items()]
        j = j.where(~(again[0] | again[1]))
        x = j.where("__seq IS NOT NULL").select(*keys, F.explode(F.array(*[F.struct(c(f"__x.{r}.target").alias("target"), rest.alias("rest")) for r, rest in rests.items()])).alias("x"))
        x = x.select(*keys, "x.target", F.col("x.rest").alias("__rest")).where("target IS NOT NULL AND __rest IS NOT NULL").join(transcripts.select("target", F.lower("seq").alias("__t")), "target")
        inside = contains_but_edge("__t", "__rest") | contains_but_edge("__t", reverse_complement("__rest"))
        j = j.join(x.where(inside).select(*keys).distinct(), keys, "left_anti")
    return j.select(*fusions.columns)


def recheck_ptd(ptds: DataFrame, best: DataFrame, times: float = 1.5) -> DataFrame:
    """Without contigs that one alignment explains."""
    return recheck_fusion(ptds, best, times)


def _twice(text: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Where in ``text``, UTF-8 of sequences up to ``ends``, ``n`` bytes come twice over within one of them, at letters."""
    if len(text) < 2 * n:
        return np.zeros(0, np.int64)
    same, have = text[:-n] == text[n:], 1
    while have < n:
        more = min(have, n - have)
        same, have = same[:-more] & same[more:], have + more
    at = np.flatnonzero(same)
    at = at[(text[at] & 0xC0) != 0x80]
    return at[at + 2 * n <= ends[np.searchsorted(ends, at, "right")]]


def doubled_parts(rows: DataFrame) -> DataFrame:
    """gene and dup_seq, distinct: all that ``rows`` (gene, seq, lengths) have twice over, of any of ``lengths`` in bytes.

    Sequences lie side by side, and all of them are compared with themselves ``n`` further on; runs of ``n`` come of halves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            gene, seq, lengths = batch.column(0), batch.column(1).cast(pa.large_binary()), batch.column(2)
            data = seq.buffers()[2]
            bounds = np.frombuffer(seq.buffers()[1], np.int64)[seq.offset : seq.offset + len(seq) + 1]
            text = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            n_of, row_of = pc.list_flatten(lengths).to_numpy(zero_copy_only=False), pc.list_parent_indices(lengths).to_numpy(zero_copy_only=False)
            wanted = [(int(n), np.bincount(row_of[n_of == n], minlength=len(seq)) > 0) for n in np.unique(n_of)]
            owners, parts, sizes = [], [], []
            first = 0
            while first < len(seq):
                last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + PIECE, "right")) - 1)
                size = np.diff(bounds[first : last + 1])
                piece = text[bounds[first] : bounds[last]]
                for n, rows_ in wanted:
                    want = rows_[first:last]
                    if not want.any():
                        continue
                    t = piece if want.all() else piece[np.repeat(want, size)]
                    ends = np.cumsum(size[want])
                    at = _twice(t, ends, n)
                    owners.append(first + np.flatnonzero(want)[np.searchsorted(ends, at, "right")])
                    parts.append(t[at[:, None] + np.arange(n)].ravel())
                    sizes.append(np.full(len(at), n, np.int64))
                first = last
            if not owners or not sum(map(len, owners)):
                continue
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            dup = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(parts))]).cast(pa.string())
            found = pa.table({"gene": gene.take(pa.array(np.concatenate(owners))), "dup_seq": dup}).group_by(["gene", "dup_seq"]).aggregate([])
            yield from found.select(["gene", "dup_seq"]).to_batches()

    kind = rows.schema["gene"].dataType.simpleString()
    return rows.select("gene", "seq", "lengths").mapInArrow(run, f"gene {kind}, dup_seq string").distinct()


def recheck_itd(itds: DataFrame, sequences: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Without events whose duplicated sequence, twice over, is in a transcript of the gene, or is one base.

    ``itds(contig, dup_seq, gene)``, read twice, ``transcripts(gene, seq)``. What a
    transcript has twice over, of the lengths of its gene's duplicates, is found within its row for all lengths and many
    transcripts at once (``doubled_parts``); the join is an equi-join by gene and sequence, and no
    row is made for an event and a transcript. What contigs' alignments to transcripts show is in ``itd_outcomes``.
    """
    lengths = itds.groupBy("gene").agg(F.collect_set(F.when(F.octet_length("dup_seq") > 0, F.octet_length("dup_seq"))).alias("lengths")).where("size(lengths) > 0")
    if lengths.count() <= FEW_GENES:
        lengths = F.broadcast(lengths)
    known = doubled_parts(transcripts.where("seq IS NOT NULL").select("gene", "seq").join(lengths, "gene"))
    return itds.where(~F.col("dup_seq").rlike(r"^(.)\1*$")).join(known, ["dup_seq", "gene"], "left_anti").select(*itds.columns)


def itd_outcomes(
    itds: DataFrame,
    best: DataFrame,
    hits: DataFrame,
    sequences: DataFrame,
    transcripts: DataFrame,
    keys: tuple[str, ...] = ("contig",),
    min_dup: int = 4,
    big: int = 15,
    share: float = 0.8,
    turned_within: int = 50,
    near: int = 5,
    read_length: int = 0,
    whole_big: bool = False,
) -> DataFrame:
    """``itds`` with outcome, after what their contigs' alignments to transcripts show, and good.

    ``itds`` (``keys``, unique; contig, gap, gap_s, gap_e, dup_s, dup_e, b_s, b_e, event_seq; b is the aligned copy),
    ``best`` (contig, target, strand, qstart, qend, perfect, n_gaps, blocks of s and e): the contig's best alignment,
    ``hits`` (contig, target, strand, qstart, qend, n_gaps, match): all of them,
    ``sequences`` (contig, seq), ``transcripts`` (target, seq). The first that holds decides:

    - unaligned: no alignment (good)
    - known: gap and copies, with as many more copies as follow them in the contig, are in a transcript, on either
      strand, to which a hit of ``read_length`` matches or more aligns over all of them (inner gaps only)
    - perfect, ungapped: the alignment has all of the contig, or of an inner gap, without a gap
    - what lies before, after and within the best alignment, in this order, from ``min_dup`` bases on: turned, where a hit of the
      same transcript on the other strand reaches over it from that end of the contig (within the alignment only up to
      ``turned_within`` bases from an end); duplicated (good), where it repeats next to it: before and after, a run of
      ``share`` of the shorter of it and the alignment, within, a run of ``min_dup``. Parts of one base throughout, and those whose reverse is in contig or transcript
      (unless the part is the event itself), don't count. Over ``big`` bases an outer part counts at once
      if the aligned rest has it, but for a third of its multiples of ``big`` at either end. Where that third is 0
      (up to 44 bases), it counts whatever the rest is; ``whole_big`` asks for all of it then.
    - split: no gapped event (good); unrepeated: anything else

    Every join is an equi-join by contig, target or ``keys``; nothing is made for pairs of events and transcripts
    but hits over the whole duplication. Contigs without a sequence are unaligned.
    """
    c, keys = F.col, list(keys)
    seqs = sequences.select("contig", F.lower("seq").alias("__seq"))
    bases = transcripts.select("target", F.lower("seq").alias("__t"))
    x = itds.join(seqs, "contig", "left").withColumn("__n", F.length("__seq"))
    cut = lambda s, e: F.substring("__seq", s.cast("int"), F.greatest(F.lit(0), e - s + 1).cast("int"))
    inner = c("gap") & (c("gap_s") != 1) & (c("gap_e") != c("__n"))

    # Hits over gap and copies, and their transcripts.
    lo, hi = F.least("gap_s", "dup_s", "b_s"), F.greatest("gap_e", "dup_e", "b_e")
    whole = x.where(inner).select(*keys, *({"contig"} - set(keys)), lo.alias("__lo"), hi.alias("__hi"), cut(lo, hi).alias("__all"), cut(c("b_s"), c("b_e")).alias("__unit"), "__seq")
    whole = whole.withColumn("__all", F.concat("__all", F.repeat("__unit", most_copies("__seq", "__all", "__unit")))).drop("__seq", "__unit")
    over = hits.where(c("match") >= read_length).select("contig", "target", "qstart", "qend").distinct()
    over = whole.join(over, "contig").where("qstart <= __lo AND qend >= __hi").select(*keys, "target", "__all").distinct()
    within = c("__t").contains(c("__all")) | c("__t").contains(reverse_complement("__all"))
    known = over.join(bases, "target").where(within).select(*keys).distinct().withColumn("__known", F.lit(True))

    # The best alignment, and how far hits on the other strand reach from the contig's ends.
    b = best.select("contig", "target", "strand", "qstart", "qend", "perfect", "n_gaps", "blocks").toDF("contig", "__target", "__strand", "__s", "__e", "__perfect", "__gaps", "__blocks")
    turned = hits.where("n_gaps = 0").join(b.select("contig", "__target", "__strand"), "contig").where("target = __target AND strand <> __strand")
    lengths = seqs.select("contig", F.length("__seq").alias("__n"))
    ends = turned.join(lengths, "contig").groupBy("contig").agg(
        F.max(F.when(c("qstart") < near, c("qend"))).alias("__reach"), F.min(F.when(c("__n") - c("qend") < near, c("qstart"))).alias("__from")
    )
    # What is known meets the events before they carry sequences; these move once to their contig and once to their transcript.
    x = itds.join(known, keys, "left").join(seqs, "contig", "left").withColumn("__n", F.length("__seq"))
    x = x.join(b.join(ends, "contig", "left"), "contig", "left").join(bases.withColumnRenamed("target", "__target"), "__target", "left")
    x = x.withColumn("__t", F.when(c("__strand") == "-", reverse_complement("__t")).otherwise(c("__t")))

    # Parts to look at, in order: outer ones have the rest of the contig, inner ones both neighbours.
    def piece(part, before, after, rest, least, turned):
        fields = {"part": part, "before": before, "after": after, "rest": rest, "least": least.cast("int"), "turned": F.coalesce(turned, F.lit(False))}
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    none, one = F.lit(None).cast("string"), F.lit(1)
    least = lambda span: F.greatest(F.lit(min_dup), F.floor(F.least(span, c("__e") - c("__s") + 1).cast("double") * share))
    span, rest = c("__s") - 1, c("__n") - c("__e")
    ahead = piece(cut(one, span), none, cut(c("__s"), c("__s") + span - 1), cut(c("__s"), c("__n")), least(span), c("__reach") >= c("__s"))
    past = piece(cut(c("__e") + 1, c("__n")), cut(F.greatest(one, c("__e") - rest + 1), c("__e")), none, cut(one, c("__e")), least(rest), c("__from") <= c("__e"))

    def between(block, i):
        left, right = F.get(c("__blocks"), i)["e"], block["s"]
        size = right - left - 1
        reached = F.when(left < turned_within, c("__reach") >= right - 1).when(c("__n") - right + 1 < turned_within, c("__from") <= left)
        return piece(cut(left + 1, right - 1), cut(F.greatest(one, left - size + 1), left), cut(right, right + size - 1), none, F.lit(min_dup), reached)

    def verdict(p):
        part, size = p["part"], F.length(p["part"])
        third = F.floor(F.floor(size / big) / 3).cast("int")
        edge = F.when((third == 0) & ~F.lit(whole_big), F.lit(True)).otherwise(p["rest"].contains(F.substring(part, third + 1, size)) | p["rest"].contains(F.substring(part, one, size - third)))
        most = p["rest"].isNotNull() & (size > big) & (p["rest"].contains(part) | edge)
        back = reverse_complement(part)
        event = F.coalesce((part == F.lower("event_seq")) & (c("b_e") - c("b_s") == c("gap_e") - c("gap_s")), F.lit(False))
        skip = (~event & (c("__seq").contains(back) | F.coalesce(c("__t").contains(back), F.lit(False)))) | is_homopolymer(part)
        again = F.coalesce(shares_run(part, p["before"], p["least"]), F.lit(False)) | F.coalesce(shares_run(part, p["after"], p["least"]), F.lit(False))
        return F.when(size >= min_dup, F.when(p["turned"], "turned").when(F.coalesce(most | (~skip & again), F.lit(False)), "duplicated"))

    later = F.slice(c("__blocks"), F.lit(2), F.greatest(F.lit(0), F.size("__blocks") - 1))
    within_it = F.when(c("__gaps") > 0, F.transform(later, between))
    x = x.withColumn("__parts", F.concat(F.array(ahead, past), F.coalesce(within_it, F.slice(F.array(past), 1, 0))))
    x = x.withColumn("__found", F.get(F.filter(F.transform("__parts", verdict), lambda v: v.isNotNull()), F.lit(0)))
    outcome = (
        F.when(c("__s").isNull() | c("__seq").isNull(), "unaligned")
        .when(c("__known"), "known")
        .when(c("__perfect"), "perfect")
        .when(inner & (c("__gaps") == 0) & (c("__s") <= c("gap_s")) & (c("__e") >= c("gap_e")), "ungapped")
        .otherwise(F.coalesce("__found", F.when(c("gap"), "unrepeated").otherwise(F.lit("split"))))
    )
    return x.withColumn("outcome", outcome).select(*itds.columns, "outcome", c("outcome").isin("unaligned", "duplicated", "split").alias("good"))


def full_dup_alignments(events: DataFrame, transcript_hits: DataFrame) -> DataFrame:
    """Transcript alignments of the contig that contain the union of gap and duplication."""
    h = transcript_hits.select(F.col("contig").alias("__c"), "transcript", F.col("qstart").alias("__s"), F.col("qend").alias("__e"))
    lo, hi = F.least("gap_s", "dup_s"), F.greatest("gap_e", "dup_e")
    return events.join(h, (F.col("contig") == F.col("__c")) & (F.col("__s") <= lo) & (F.col("__e") >= hi)).drop("__c", "__s", "__e")

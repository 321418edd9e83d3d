"""Column functions for coordinates, alignments, sequences and labels. No UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- chromosomes -------------------------------------------------------------


def normalize_chrom(c: Column | str, use_chr: bool = False) -> Column:
    """Upper case without the CHR prefix, MT as M; with ``use_chr`` a chr prefix again."""
    bare = F.regexp_replace(F.upper(col(c)), "^CHR", "")
    name = F.when(bare == "MT", "M").otherwise(bare)
    return F.concat(F.lit("chr"), name) if use_chr else name


def is_standard_chrom(c: Column | str) -> Column:
    return normalize_chrom(c).rlike("^([1-9][0-9]*|X|Y|M)$")


def chrom_order(c: Column | str) -> Column:
    """The number; X is 0, Y is -1, M is -2; others are null."""
    name = normalize_chrom(c)
    return F.when(name == "X", 0).when(name == "Y", -1).when(name == "M", -2).when(name.rlike("^[0-9]+$"), name.cast("int"))


# --- alignments --------------------------------------------------------------


def psl_score(match, mismatch, q_inserts, t_inserts) -> Column:
    return col(match) - col(mismatch) - col(q_inserts) - col(t_inserts)


def _milli_bad(q_size, t_size, inserts, mismatch, total) -> Column:
    longer = F.greatest(F.lit(0), q_size - t_size)
    return 1000.0 * (mismatch + inserts + F.round(3 * F.log1p(longer.cast("double")))) / total


def percent_identity(qstart, qend, tstart, tend, q_inserts, mismatch, match_len) -> Column:
    """Identity from mismatches, insertions and the size difference, to one decimal; 0 for empty alignments."""
    q, t = col(qend) - col(qstart), F.abs(col(tend) - col(tstart))
    bad = _milli_bad(q, t, col(q_inserts), col(mismatch), col(match_len).cast("double"))
    return F.when(F.least(q, t) <= 0, 0.0).otherwise(F.round(100.0 - bad * 0.1, 1))


def pid_truncated(q_size, t_size, inserts, mismatch, total) -> Column:
    """The same with whole thousandths cut off, as for gapped members."""
    bad = F.floor(_milli_bad(col(q_size), col(t_size), col(inserts), col(mismatch), col(total).cast("double")))
    return 100.0 - bad * 0.1


def align_fraction(qstart, qend, query_len) -> Column:
    return (col(qend) - col(qstart) + 1).cast("double") / col(query_len)


def gapped_align_fraction(match, mismatch, rep_match, query_len) -> Column:
    """Aligned bases alone, as for alignments with gaps."""
    return (col(match) + col(mismatch) + col(rep_match)).cast("double") / col(query_len)


def interval_overlap(s1, e1, s2, e2) -> Column:
    """Shared positions of two closed intervals; below zero, the space between them."""
    return F.least(col(e1), col(e2)) - F.greatest(col(s1), col(s2)) + 1


def overlap_fraction(s1, e1, s2, e2) -> Column:
    """Overlap over the shorter interval."""
    shorter = F.least(col(e1) - col(s1) + 1, col(e2) - col(s2) + 1)
    return interval_overlap(s1, e1, s2, e2).cast("double") / shorter


def fix_align(strand, tleft, tright, q_inserts=0, t_inserts=0) -> Column:
    """struct(tstart, tend, qgap, spliced): starts after ends on the minus strand."""
    plus = col(strand) == "+"
    number = lambda c: F.lit(c) if isinstance(c, int) else col(c)
    return F.struct(
        F.when(plus, col(tleft)).otherwise(col(tright)).alias("tstart"),
        F.when(plus, col(tright)).otherwise(col(tleft)).alias("tend"),
        (number(q_inserts) > 0).alias("qgap"),
        (number(t_inserts) > 0).alias("spliced"),
    )


# --- sequences ---------------------------------------------------------------


def reverse_complement(s) -> Column:
    return F.reverse(F.translate(col(s), "ACGTNacgtn", "TGCANtgcan"))


def is_homopolymer(s) -> Column:
    return col(s).rlike(r"^(.)\1*$")


def is_poly_at(s) -> Column:
    return F.upper(col(s)).rlike("^(A+|T+)$")


def is_run_hard(s) -> Column:
    return F.upper(col(s)).rlike(r"^(.)\1*$")


def is_run_soft(s) -> Column:
    """One base throughout but for at most one other, inside or first."""
    return F.upper(col(s)).rlike(r"^(.)\1*(.\1+)?$|^.(.)\3*$")


def n_fraction(s) -> Column:
    length = F.length(col(s))
    return F.when(length > 0, (length - F.length(F.translate(F.upper(col(s)), "N", ""))).cast("double") / length)


def contains_but_edge(long, short) -> Column:
    """Whether ``short`` without its first or without its last base is within ``long``."""
    s, n = col(short), F.length(col(short))
    return col(long).contains(F.substring(s, F.lit(2), n)) | col(long).contains(F.substring(s, F.lit(1), n - 1))


def shares_run(a, b, least) -> Column:
    """Whether two texts have a run of ``least`` (1 or more) letters in common.

    Words of that length meet as 64-bit hashes, so memory grows with the texts and not
    with their products. Null where a text is.
    """
    n = col(least) if isinstance(least, str) else least
    words = lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(s) - n + 1)), lambda i: F.xxhash64(F.substring(s, i, n)))
    return (F.length(col(a)) >= n) & (F.length(col(b)) >= n) & F.arrays_overlap(words(col(a)), words(col(b)))


def most_copies(text, start, unit) -> Column:
    """How often ``unit`` can follow ``start`` somewhere in ``text``, which has ``start`` itself."""
    t, s, u = col(text), col(start), col(unit)
    room = F.floor((F.length(t) - F.length(s)) / F.greatest(F.lit(1), F.length(u))).cast("int")
    fits = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), room)), lambda k: t.contains(F.concat(s, F.repeat(u, k))))
    return F.when(F.length(u) > 0, F.coalesce(F.array_max(fits), F.lit(0))).otherwise(0)


# --- reads -------------------------------------------------------------------


def cigar_blocks(cigar, pos) -> Column:
    """Aligned closed blocks: M makes one, D and N advance, I, H, P and S do not; null for other letters."""
    ops = F.regexp_extract_all(col(cigar), F.lit("([0-9]+)([A-Z=])"), F.lit(0))

    def step(a: Column, op: Column) -> Column:
        n = F.regexp_extract(op, "^([0-9]+)", 1).cast("long")
        kind = F.substring(op, -1, 1)
        block = F.array(F.struct(a["at"].alias("s"), (a["at"] + n - 1).alias("e")))
        return F.struct(
            F.when(kind.isin("M", "D", "N"), a["at"] + n).otherwise(a["at"]).alias("at"),
            F.when(kind == "M", F.concat(a["blocks"], block)).otherwise(a["blocks"]).alias("blocks"),
        )

    start = F.struct(col(pos).cast("long").alias("at"), F.expr("cast(array() as array<struct<s:bigint,e:bigint>>)").alias("blocks"))
    return F.when(col(cigar).rlike("^([0-9]+[MDNIHPS])+$"), F.aggregate(ops, start, step, lambda a: a["blocks"]))


def is_perfect(cigar, read_len, nm, max_nm: int = 0) -> Column:
    """One M over the whole read with at most ``max_nm`` differences."""
    return (col(cigar) == F.concat(col(read_len).cast("string"), F.lit("M"))) & (col(nm) <= max_nm)


def is_perfect_softclipped(cigar, read_len, nm, max_nm: int = 0) -> Column:
    """Soft clips at the ends and one M between, together the whole read."""
    n = lambda pattern: F.coalesce(F.nullif(F.regexp_extract(col(cigar), pattern, 1), F.lit("")).cast("long"), F.lit(0))
    whole = n("^([0-9]+)S") + n("([0-9]+)M") + n("M([0-9]+)S$")
    return col(cigar).rlike("^([0-9]+S)?[0-9]+M([0-9]+S)?$") & (whole == col(read_len)) & (col(nm) <= max_nm)


def sam_flag_kept(flag, paired: bool) -> Column:
    """Neither unmapped, failed nor duplicate, nor (paired) with an unmapped mate or (single) secondary."""
    return col(flag).bitwiseAND(F.lit(0x4 | 0x200 | 0x400 | (0x8 if paired else 0x100))) == 0


def pair_orientation(left1, strand1, left2, strand2) -> Column:
    """FF, RR, FR or RF, read from the left mate."""
    first = col(left1) <= col(left2)
    a, b = F.when(first, col(strand1)).otherwise(col(strand2)), F.when(first, col(strand2)).otherwise(col(strand1))
    letter = lambda s: F.when(s == "+", "F").otherwise("R")
    return F.concat(letter(a), letter(b))


# --- intervals and blocks ----------------------------------------------------


def span(s, e) -> Column:
    return F.abs(col(e) - col(s)) + 1


def contains_strictly(s1, e1, s2, e2) -> Column:
    return (col(s1) < col(s2)) & (col(e1) > col(e2))


def union_interval(s1, e1, s2, e2) -> Column:
    return F.struct(F.least(col(s1), col(s2)).alias("s"), F.greatest(col(e1), col(e2)).alias("e"))


def intersect_interval(s1, e1, s2, e2) -> Column:
    """Null where the intervals share nothing."""
    s, e = F.greatest(col(s1), col(s2)), F.least(col(e1), col(e2))
    return F.when(s <= e, F.struct(s.alias("s"), e.alias("e")))


def shift_interval(s, e, by) -> Column:
    return F.struct((col(s) + by).alias("s"), (col(e) + by).alias("e"))


def between_interval(s1, e1, s2, e2) -> Column:
    """What lies between two intervals that do not touch, else null."""
    s, e = F.least(col(e1), col(e2)) + 1, F.greatest(col(s1), col(s2)) - 1
    return F.when(s <= e, F.struct(s.alias("s"), e.alias("e")))


_BLOCKS = "array<struct<s:bigint,e:bigint>>"


def cut_or_extend_blocks(blocks, length, from_left: bool = True, extend: bool = True) -> Column:
    """Blocks (ascending) from one side up to ``length`` bases; the last is cut, or reaches further if all are too short."""
    b = col(blocks) if from_left else F.reverse(col(blocks))
    want = F.lit(length) if isinstance(length, int) else col(length)

    def step(a: Column, x: Column) -> Column:
        n = F.least(a["rest"], x["e"] - x["s"] + 1)
        part = F.struct(F.when(F.lit(from_left), x["s"]).otherwise(x["e"] - n + 1).alias("s"), F.when(F.lit(from_left), x["s"] + n - 1).otherwise(x["e"]).alias("e"))
        return F.struct((a["rest"] - n).alias("rest"), F.when(a["rest"] > 0, F.concat(a["out"], F.array(part))).otherwise(a["out"]).alias("out"))

    def finish(a: Column) -> Column:
        last = F.element_at(a["out"], -1)
        longer = F.struct((last["s"] - F.when(F.lit(from_left), F.lit(0)).otherwise(a["rest"])).alias("s"), (last["e"] + F.when(F.lit(from_left), a["rest"]).otherwise(F.lit(0))).alias("e"))
        grown = F.concat(F.slice(a["out"], F.lit(1), F.size(a["out"]) - 1), F.array(longer))
        out = F.when((a["rest"] > 0) & (F.size(a["out"]) > 0), grown).otherwise(a["out"]) if extend else a["out"]
        return out if from_left else F.reverse(out)

    return F.aggregate(b, F.struct(want.cast("long").alias("rest"), F.expr(f"cast(array() as {_BLOCKS})").alias("out")), step, finish)


def merge_blocks(blocks, overlapping: bool = True) -> Column:
    """Sorted blocks that touch, and with ``overlapping`` those that overlap, joined."""

    def step(a: Column, x: Column) -> Column:
        last = F.element_at(a, -1)
        joins = (last["e"] >= x["s"] - 1) if overlapping else (last["e"] == x["s"] - 1)
        joined = F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when((F.size(a) > 0) & joins, joined).otherwise(F.concat(a, F.array(x)))

    return F.aggregate(F.array_sort(col(blocks)), F.expr(f"cast(array() as {_BLOCKS})"), step)


def query_to_target_pos(qblocks, tblocks, pos, strand, strict: bool = False) -> Column:
    """Target position of a query position through paired blocks; in a gap, that of the block end before it (strict: null)."""
    pairs = F.arrays_zip(col(qblocks).alias("q"), col(tblocks).alias("t"))
    p = col(pos)
    hit = F.filter(pairs, lambda x: (x["q"]["s"] <= p) & (x["q"]["e"] >= p))
    before = F.filter(pairs, lambda x: x["q"]["e"] < p)
    at = lambda x, d: F.when(col(strand) == "+", x["t"]["s"] + d).otherwise(x["t"]["e"] - d)
    inside = at(hit[0], p - hit[0]["q"]["s"])
    last = F.element_at(before, -1)
    edge = at(last, last["q"]["e"] - last["q"]["s"])
    return F.when(F.size(hit) > 0, inside) if strict else F.when(F.size(hit) > 0, inside).when(F.size(before) > 0, edge)


# --- labels ------------------------------------------------------------------


def k_form(length, k) -> Column:
    """Length as 2k+x."""
    x = col(length) - 2 * col(k)
    return F.concat(F.lit("2k"), F.when(x < 0, F.lit("-")).otherwise(F.lit("+")), F.abs(x).cast("string"))


def clean_contig_id(contig, lib) -> Column:
    """Without the library's prefix and without symbols."""
    bare = F.when(col(contig).startswith(col(lib)), F.substring(col(contig), F.length(col(lib)) + 1, F.length(col(contig)))).otherwise(col(contig))
    return F.regexp_replace(bare, "[^A-Za-z0-9]", "")


def gene_label(gene) -> Column:
    """struct(name, is_utr, is_non_coding): suffixes and an X<n>X infix stripped."""
    g = col(gene)
    name = F.regexp_replace(F.regexp_replace(g, r"(\.UTR|\.non_coding)+$", ""), "X[0-9]+X", "")
    return F.struct(name.alias("name"), g.contains(".UTR").alias("is_utr"), g.contains(".non_coding").alias("is_non_coding"))


def feature_from_descriptor(d) -> Column:
    """``transcript>gene~feature~num`` -> struct."""
    left, right = F.split(col(d), ">"), F.split(F.element_at(F.split(col(d), ">"), 2), "~")
    return F.struct(left[0].alias("transcript"), right[0].alias("gene"), right[1].alias("feature"), right[2].cast("int").alias("num"))


def member_region_ids(d) -> Column:
    """``12ab)A`` -> struct(group_id, member, region)."""
    part = lambda i: F.regexp_extract(col(d), r"^([0-9]+)([a-z]+)\)?([AB]?)", i)
    return F.struct(part(1).cast("long").alias("group_id"), part(2).alias("member"), part(3).alias("region"))

"""Gapped candidates: unaligned gaps of a contig that repeat or invert what is next to them.

The duplication search is ungapped: for a gap, an orientation and a diagonal the
best-scoring run (match +1, mismatch -1) is found by one pass over the bases
within the row, for many gaps at once. Only diagonals with a seed are scored, a
word that both sides have, as long as a run that counts must have without a
mismatch; they are told by comparing whole diagonals.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_poly_at, is_standard_chrom, normalize_chrom, reverse_complement


def gap_eligible(aln: DataFrame, max_alignments: int = 3, max_len: int = 50_000, min_span: float = 0.4, min_unaligned: int = 4) -> DataFrame:
    """Alignments whose contigs are worth a look at their gaps, on standard chromosomes other than M."""
    from pyspark.sql import Window

    w = Window.partitionBy("query")
    a = aln.withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__top", F.max("score").over(w))
    size = F.col("qend") - F.col("qstart") + 1
    ok = (F.col("__n") <= max_alignments) & (F.col("query_len") <= max_len) & (size / F.col("query_len") >= min_span) & (F.col("query_len") - size >= min_unaligned)
    name = F.col("chrom").cast("string")
    ok = ok & is_standard_chrom(name) & (normalize_chrom(name) != "M")
    return a.where(ok & (F.col("score") >= 0.85 * F.col("__top")) & (F.col("score") / F.col("query_len") >= 0.4) & (F.col("identity_x10") > 400)).drop("__n", "__top")


def explode_gaps(contigs: DataFrame, min_gap: int = 4) -> DataFrame:
    """gap_s, gap_e, gap_seq and edge of the stretches before, between and after ``blocks`` (s, e) of ``seq``.

    Edge gaps of A or T alone don't count.
    """
    n = F.length("seq").cast("long")
    bounds = F.concat(F.array(F.lit(0).cast("long")), F.flatten(F.transform("blocks", lambda b: F.array(b["s"].cast("long"), b["e"].cast("long")))), F.array(n + 1))
    k = F.size(bounds) / 2
    gaps = F.transform(F.sequence(F.lit(0), k.cast("int") - 1), lambda i: F.struct((F.element_at(bounds, 2 * i + 1) + 1).alias("s"), (F.element_at(bounds, 2 * i + 2) - 1).alias("e"), i.alias("i")))
    g = contigs.withColumn("__g", F.explode(gaps)).withColumn("gap_s", F.col("__g.s")).withColumn("gap_e", F.col("__g.e"))
    g = g.withColumn("edge", (F.col("__g.i") == 0) | (F.col("__g.i") == F.size("blocks"))).where(F.col("gap_e") - F.col("gap_s") + 1 >= min_gap)
    g = g.withColumn("gap_seq", F.substring("seq", F.col("gap_s").cast("int"), (F.col("gap_e") - F.col("gap_s") + 1).cast("int"))).drop("__g")
    return g.where(~(F.col("edge") & is_poly_at("gap_seq")))


def _seed_size(score: Column, min_ratio: float) -> Column:
    """Bases that every run of ``score`` or more and ``min_ratio`` of its length has in a row somewhere.

    A run without a mismatch is ``score`` long; one with m mismatches has 2m/(1 - min_ratio) bases or more, and
    the longest of its m + 1 stretches is shortest for m = 1.
    """
    if min_ratio >= 1:
        return score.cast("int")
    return F.least(score, F.lit(math.ceil(round(2 / (1 - min_ratio), 9)) // 2)).cast("int")


def _chars(texts: pd.Series, n: int) -> np.ndarray:
    """A column of ``n`` code points for each text."""
    whole = "".join(texts)
    try:
        flat = np.frombuffer(whole.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        flat = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    return np.ascontiguousarray(flat.reshape(len(texts), n).T)


def _diagonal_runs(gaps: pd.Series, windows: pd.Series, seed: pd.Series, least: pd.Series, ratio: float) -> Iterator[tuple]:
    """(row, d, score, s, e) of the best run of gap[i] against window[i + d], 1-based in the gap, of each diagonal that has a word of ``seed`` bases.

    Rows of one size are compared at once, each in a column, so that a diagonal of all of them is one block; of equal runs the
    first counts. A run has ``least`` or more, and ``ratio`` of its length.
    """
    sizes = [gaps.str.len().to_numpy(), windows.str.len().to_numpy(), seed.to_numpy()]
    for (n, m, q), at in pd.Series(range(len(gaps))).groupby(sizes):
        if q < 1 or min(n, m) < q:
            continue
        rows = max(1, 262_144 // n)
        for from_ in range(0, len(at), rows):
            part = at.to_numpy()[from_ : from_ + rows]
            g, w, enough = _chars(gaps.iloc[part], n), _chars(windows.iloc[part], m), least.to_numpy()[part]
            for d in range(q - n, m - q + 1):
                lo, hi = max(0, -d), min(n, m - d)
                word = same = g[lo:hi] == w[lo + d : hi + d]
                k = 1
                while k < q:  # word: k bases in a row
                    more = min(k, q - k)
                    word, k = word[more:] & word[:-more], k + more
                hit = np.flatnonzero(word.any(axis=0))
                if not len(hit):
                    continue
                c = np.where(same[:, hit], 1, -1).cumsum(axis=0, dtype=np.int32)
                now = c - np.minimum(np.minimum.accumulate(c, axis=0), 0)
                end, each = now.argmax(axis=0), np.arange(len(hit))
                top = now[end, each]
                since = np.maximum.accumulate(np.where(now == 0, np.arange(1, hi - lo + 1)[:, None], 0), axis=0)[end, each]
                for i in np.flatnonzero((top >= enough[hit]) & (top >= ratio * (end - since + 1))):
                    yield int(part[hit[i]]), d, int(top[i]), int(lo + since[i] + 1), int(lo + end[i] + 1)


def _with_runs(x: DataFrame, turns: list[tuple[bool, Column]], windows: list[Column], enough: Column, min_ratio: float) -> DataFrame:
    """``x`` with __runs (inverted, side, d, score, s, e): the best run of ``enough`` or more on each diagonal of a turn of the gap and a window.

    All of a gap is in its row, so no row is made for a word or a diagonal, and nothing is shuffled.
    """
    inverted = [t for t, _ in turns]

    @F.pandas_udf("array<struct<inverted:boolean,side:int,d:int,score:int,s:int,e:int>>")
    def runs(seed: pd.Series, least: pd.Series, *texts: pd.Series) -> pd.Series:
        out = [[] for _ in seed]
        texts = [t.fillna("") for t in texts]
        seed, least = seed.fillna(0).astype(int), least.fillna(0).astype(int)
        for turned, gap in zip(inverted, texts, strict=False):
            for side, window in enumerate(texts[len(inverted) :]):
                for row, d, score, s, e in _diagonal_runs(gap, window, seed, least, min_ratio):
                    out[row].append({"inverted": turned, "side": side, "d": d, "score": score, "s": s, "e": e})
        return pd.Series(out)

    return x.withColumn("__runs", runs(_seed_size(enough, min_ratio), enough.cast("int"), *[g for _, g in turns], *windows)).where(F.size("__runs") > 0)


def find_gap_duplication(
    gaps: DataFrame, key: list[str], min_gap: int = 4, min_share: float = 0.3, min_ratio: float = 0.95, inverted_only: bool = False, keep: list[str] | None = None
) -> DataFrame:
    """The best copy of each gap within two gap lengths on either side: dup_s, dup_e on the contig, gap range used, score, inverted.

    Score must reach max(min_gap, min_share of the gap) and ``min_ratio`` of the run's length. Ties go to the
    forward copy, then the nearer, then the left one. ``keep`` names columns of the gap to return as well (by default
    seq and blocks where there are any, as ``classify_tandem`` reads them).
    """
    keep = [c for c in ("seq", "blocks") if c in gaps.columns] if keep is None else keep
    size = (F.col("gap_e") - F.col("gap_s") + 1).cast("int")
    lo = F.greatest(F.lit(1), F.col("gap_s") - 2 * size)
    left = F.substring("seq", lo.cast("int"), (F.col("gap_s") - lo).cast("int"))
    right = F.substring("seq", (F.col("gap_e") + 1).cast("int"), 2 * size)
    turns = [(False, F.col("gap_seq")), (True, reverse_complement("gap_seq"))][int(inverted_only) :]
    enough = F.greatest(F.lit(min_gap), F.ceil(min_share * size))
    x = _with_runs(gaps, turns, [left, right], enough, min_ratio)

    def copy(r: Column) -> Column:
        n = r["e"] - r["s"] + 1
        dup_s = F.when(r["side"] == 0, lo).otherwise(F.col("gap_e") + 1) + r["d"] + r["s"] - 1
        used_s = F.when(r["inverted"], F.col("gap_e") - r["e"] + 1).otherwise(F.col("gap_s") + r["s"] - 1)
        dup_e, used_e = dup_s + n - 1, used_s + n - 1
        distance = F.when(dup_s > used_e, dup_s - used_e - 1).otherwise(used_s - dup_e - 1)
        fields = {"dup_s": dup_s, "dup_e": dup_e, "used_s": used_s, "used_e": used_e, "distance": distance, "score": r["score"], "inverted": r["inverted"]}
        return F.struct(r["score"].alias("best"), (~r["inverted"]).alias("forward"), (-distance).alias("near"), (-dup_s).alias("left"), F.struct(*[v.alias(k) for k, v in fields.items()]).alias("d"))

    x = x.withColumn("__best", F.array_max(F.transform("__runs", copy)))
    best = F.max_by(F.struct(*keep, "__best.d.*"), "__best")
    return x.groupBy(*key).agg(best.alias("d")).select(*key, "d.*")


def classify_tandem(dups: DataFrame, similar: int = 95, negligible: int = 2) -> DataFrame:
    """topology of a gapped event, tandem, how (the kind of tandem), border_s and border_e: the gap's copy with its borders moved.

    Needs seq, blocks, gap_s and gap_e beside the copies. Copies with a whole block between them aren't tandem, nor are those
    further apart than a copy's length (two, if inverted). Nearer ones are compared where each would go on towards the other,
    by edit distance (inverted: half the distance each, one turned). The distance is short up to 100 - ``similar`` percent of
    the gap (twice that, if inverted); then the copies are tandem whatever lies between. ``how``: TAN(Sh&Ir) no room on the
    contig, TAN(Sh&Neg) next to no distance, TAN(Sh&Mod) and TAN(Sh&NMod) similar and not, TAN(Mod) and TAN(NMod) beyond the
    short distance, where the copies are tandem only if they differ by max(``negligible``, the short distance) or less. Borders
    move to meet the other copy in the kinds Neg and Mod of tandem copies.
    """
    seq, inverted = F.col("seq"), F.col("inverted")
    n, gap, d = F.col("dup_e") - F.col("dup_s") + 1, F.col("gap_e") - F.col("gap_s") + 1, F.col("distance")
    after = F.col("dup_s") < F.col("used_s")
    turns = F.when(inverted, 2).otherwise(1)
    between_s, between_e = F.least("used_e", "dup_e") + 1, F.greatest("used_s", "dup_s") - 1
    apart = F.exists("blocks", lambda b: (b["s"] >= between_s) & (b["e"] <= between_e)) | (d > turns * n)
    step = F.when(inverted, F.floor(d / 2)).otherwise(d).cast("int")
    part = lambda at: F.substring(seq, at.cast("int"), step)
    no_room = ~inverted & ((F.col("dup_e") + d > F.length(seq)) | (F.col("dup_s") - d < 1))
    first = F.when(inverted, part(between_s)).otherwise(part(F.col("dup_e") + 1))
    second = F.when(inverted, reverse_complement(part(between_e + 1 - step))).otherwise(part(F.greatest(F.lit(1), F.col("dup_s") - d)))
    slack = 100 - similar
    alike, little = F.floor(3 * slack * d / 100), F.greatest(F.lit(negligible), F.floor(slack * gap / 100))
    short = d * 100 <= turns * slack * gap
    x = dups.withColumn("__diff", F.when(~apart & ~no_room, F.levenshtein(first, second)))
    mod = F.col("__diff") <= alike
    how = (
        F.when(F.coalesce(apart, F.lit(False)) | (no_room & ~short), "")
        .when(short & no_room, "TAN(Sh&Ir)")
        .when(short & (d <= turns * negligible), "TAN(Sh&Neg)")
        .otherwise(F.concat(F.lit("TAN("), F.when(short, "Sh&").otherwise(""), F.when(mod, "Mod)").otherwise("NMod)")))
    )
    x = x.withColumn("how", how).withColumn("tandem", (F.col("how") != "") & (short | (F.col("__diff") <= little)))
    moved = F.when(F.col("tandem") & F.col("how").isin("TAN(Sh&Neg)", "TAN(Sh&Mod)", "TAN(Mod)"), step.cast("long")).otherwise(F.lit(0).cast("long"))
    x = x.withColumn("border_s", F.col("used_s") - F.when(after, moved).otherwise(0)).withColumn("border_e", F.col("used_e") + F.when(after, 0).otherwise(moved))
    kind = F.when(inverted, "gap-inverted_duplication").when(F.col("tandem"), "gap-tandem-duplication").otherwise("gap-nontandem-duplication")
    return x.withColumn("topology", kind).drop("__diff")


def tandem_spanning_gap(dups: DataFrame, max_genome_gap: int = 5) -> DataFrame:
    """spanning: a forward copy that touches the gap's edge, with next to no gap in the genome."""
    touches = (F.col("dup_e") == F.col("gap_s") - 1) | (F.col("dup_s") == F.col("gap_e") + 1)
    return dups.withColumn("spanning", ~F.col("inverted") & touches & (F.col("genome_gap") <= max_genome_gap))


def gap_inversion(gaps: DataFrame, key: list[str], min_gap: int = 6, min_ratio: float = 0.95) -> DataFrame:
    """Internal gaps whose reverse complement is in the intron (``intron``, at least as long): at, the 1-based place of the best match, and score."""
    g = gaps.where(~F.col("edge") & (F.length("gap_seq") >= min_gap) & (F.length("intron") >= F.length("gap_seq")))
    enough = F.ceil(min_ratio * F.length("gap_seq"))
    x = _with_runs(g, [(True, reverse_complement("gap_seq"))], [F.col("intron")], enough, min_ratio)
    inside = F.filter("__runs", lambda r: (r["d"] >= 0) & (r["d"] <= F.length("intron") - F.length("gap_seq")))
    x = x.withColumn("__best", F.array_max(F.transform(inside, lambda r: F.struct(r["score"].alias("score"), (-r["d"]).alias("near"))))).where("__best IS NOT NULL")
    best = F.max("__best").alias("b")
    return x.groupBy(*key).agg(best).select(*key, (1 - F.col("b.near")).alias("at"), "b.score")


def formation_tags(dups: DataFrame) -> DataFrame:
    """tags: how the event's sequence came about; NOVEL_INS with the bases between the copies, TAN for tandem copies, TRIM for gap bases outside the copy. Not built: SWAP, NOVEL_INS(NC) and the GE tags (see README)."""
    n = F.col("used_e") - F.col("used_s") + 1
    trimmed = F.col("gap_e") - F.col("gap_s") + 1 - n
    tags = F.array(
        F.when(F.col("tandem"), F.concat(F.lit("TAN("), n.cast("string"), F.lit(")"))),
        F.when((F.col("distance") > 0) & F.col("tandem"), F.concat(F.lit("NOVEL_INS("), F.col("distance").cast("string"), F.lit(")"))),
        F.when(trimmed > 0, F.concat(F.lit("TRIM("), trimmed.cast("string"), F.lit(")"))),
    )
    return dups.withColumn("tags", F.array_join(F.filter(tags, lambda x: x.isNotNull()), ";"))


def gap_event_columns(dups: DataFrame) -> DataFrame:
    """event_s, event_e, event_seq (the gap's copy), dup_seq and ins_seq (between the copies) of ``seq``."""
    sub = lambda s, e: F.when(e >= s, F.substring("seq", s.cast("int"), (e - s + 1).cast("int"))).otherwise("")
    first_e, second_s = F.least("used_e", "dup_e"), F.greatest("used_s", "dup_s")
    return dups.withColumn("event_s", F.col("used_s")).withColumn("event_e", F.col("used_e")).withColumn("event_seq", sub(F.col("used_s"), F.col("used_e"))).withColumn("dup_seq", sub(F.col("dup_s"), F.col("dup_e"))).withColumn("ins_seq", sub(first_e + 1, second_s - 1))

"""Rules on rows made by hand, which tell them from near misses, and plans against brute force."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from junctura.operators import candidates as C
from junctura.operators import compare as X
from junctura.operators import filters as L
from junctura.operators import gaps as D
from junctura.operators import grouping as G
from junctura.operators import intervals as I
from junctura.operators import predict as E
from junctura.operators import screening as A
from junctura.operators import support as P
from junctura.sources import writers as W


def test_only_chromosome_m_is_mitochondrial(spark):
    rows = [(1, "4", "4"), (2, "chrM", "1"), (3, "2", "MT"), (4, "chrmt", None), (5, "chrM2", "X")]
    d = spark.createDataFrame(rows, "group_id long, chrom1 string, chrom2 string")
    got = {r.group_id: r.f for r in d.groupBy("group_id").agg(L.group_filters()["MITOCHONDRIAL"].alias("f")).collect()}
    assert got == {1: False, 2: True, 3: True, 4: True, 5: False}
    numbered = spark.createDataFrame([(1, 4, 4)], "group_id long, chrom1 long, chrom2 long")
    assert not numbered.groupBy("group_id").agg(L.group_filters()["MITOCHONDRIAL"].alias("f")).first().f


def test_pairs_count_by_kind(spark):
    d = spark.createDataFrame([(1, 5, 3, 0, 0), (2, 1, 1, 1, 1)], "group_id long, pairs long, pairs_filtered long, pairs_exonic long, pairs_filtered_exonic long")
    failed = lambda o: {r.group_id: r.f for r in d.groupBy("group_id").agg(L.group_filters(o)["PAIR_SUPPORT"].alias("f")).collect()}
    assert failed(L.Options()) == {1: True, 2: False}
    assert failed(L.Options(pairs=2, pairs_filtered=3, ignore_introns=False)) == {1: False, 2: True}
    assert failed(L.Options(pairs=0, pairs_filtered=2)) == {1: True, 2: True}


def test_represented_share_is_clipped_to_the_gap(spark):
    rows = [(45, 70, "gap-tandem-duplication"), (70, 80, "gap-tandem-duplication"), (70, 80, "gap-internal_inversion")]
    d = spark.createDataFrame([(1, 100, 41, 60, s, e, 50, 55, t, 100) for s, e, t in rows], "ctg_s long, ctg_e long, gap_s long, gap_e long, part_s long, part_e long, dup_s long, dup_e long, topology string, ctg_len long")
    assert [r[0] for r in d.select(L.gap_represented()).collect()] == [0.96, 0.86, 0.8]


def test_down_sides_of_breakends_move_back(spark):
    d = spark.createDataFrame([(7, "1", 1000, "down", "2", 2000, "up", 5, 3, ["c"], "A", "G"), (8, "1", 1000, "up", "2", 2000, "down", -4, 3, ["c"], None, None)], "group_id long, chrom_a string, coord_a long, dir_a string, chrom_b string, coord_b long, dir_b string, ctg_overlap long, support long, contigs array<string>, ref_a string, ref_b string")
    got = {r.id: (r.pos, r.ref, r.alt) for r in W.to_vcf_fusion(d).collect()}
    assert got["7a"] == (995, "A", "]2:2000]A") and got["7b"] == (2000, "G", "G[1:995[")
    assert got["8a"] == (1000, "N", "N[2:2000[") and got["8b"] == (2000, "N", "]1:1000]N")


def test_an_event_takes_the_route_of_its_first_special_member(spark):
    near, far = ("read-through", 100), ("intrachr-same-strand", 50_000)
    inter = ("interchr", None)
    rows = [
        (1, 1, *inter, "53", "g", "h"), (1, 2, *near, "53", "g", "h"), (2, 1, *inter, "53", "g", "g"), (3, 1, *far, "55", "g", "h"), (3, 2, *inter, "33", "g", "h"),
        (4, 1, *inter, "55", "g", "h"), (4, 2, *inter, "53", "g", "h"), (5, 1, *inter, "55", "g", "g"), (5, 2, *near, "53", "g", "h"), (6, 1, *far, "53", "g", "h"),
    ]
    d = spark.createDataFrame(rows, "group_id long, no long, topology string, target_distance long, ends string, a string, b string")
    d = d.select("group_id", "no", "topology", "target_distance", F.substring("ends", 1, 1).alias("end_a"), F.substring("ends", 2, 1).alias("end_b"), F.array("a").alias("genes_a"), F.array("b").alias("genes_b"))
    got = {r.group_id: r.route for r in E.route_fusions(d, "group_id", ["no"]).collect()}
    assert got == {1: "read_through", 2: "duplicate_gene", 3: "mixed_sense", 4: "main", 5: "duplicate_gene", 6: "main"}


def test_an_edge_gap_decides_where_a_duplication_goes(spark):
    rows = [(1, 1, True, 0.3, 0.25, 1), (2, 1, True, 0.3, 0.2, 1), (3, 1, False, 0.9, 0.9, 2), (3, 2, True, 0.3, 0.2, 1), (4, 1, True, 0.3, 0.2, 1), (4, 2, False, 0.9, 0.9, 2), (5, 1, False, 0.1, 0.1, 2), (6, 1, False, 0.1, 0.1, 1)]
    d = spark.createDataFrame(rows, "group_id long, no long, edge_gap boolean, fraction_a double, fraction_b double, n_exons int")
    got = {r.group_id: r.route for r in E.route_itds(d, "group_id", ["no"]).collect()}
    assert got == {1: "full", 2: "edge", 3: "edge_multi_exon", 4: "edge", 5: "internal_multi_exon", 6: "internal"}


def test_alignment_classes(spark):
    one = lambda q, t, n=0: [((q[0], q[1]), (t[0], t[1]))] if not n else [((q[0], q[0] + 40), (t[0], t[0] + 40)), ((q[0] + 41 + n, q[1]), (t[0] + 41, t[1]))]
    rows = {
        "full": (1, 200, 200, 0, 0, 1, 200, 900, one((1, 200), (1, 200))), "late": (3, 200, 200, 0, 0, 30, 227, 900, one((3, 200), (30, 227))),
        "whole": (50, 199, 300, 0, 0, 1, 150, 150, one((50, 199), (1, 150))), "part": (50, 199, 300, 0, 0, 30, 179, 400, one((50, 199), (30, 179))),
        "short": (81, 199, 300, 0, 0, 30, 148, 400, one((81, 199), (30, 148))), "short whole": (81, 199, 300, 0, 0, 1, 119, 119, one((81, 199), (1, 119))),
        "broken": (50, 199, 300, 5, 0, 30, 174, 400, one((50, 199), (30, 174), 5)), "nearly": (50, 199, 300, 4, 0, 30, 175, 400, one((50, 199), (30, 175), 4)),
    }
    data = [(k, *r[:8], [x[0] for x in r[8]], [x[1] for x in r[8]], 100) for k, r in rows.items()]
    d = spark.createDataFrame(data, "k string, qstart long, qend long, query_len long, q_insert long, t_insert long, t1 long, t_end long, target_len long, q_blocks array<struct<s:long,e:long>>, t_blocks array<struct<s:long,e:long>>, bp long")
    got = {r.k: (r.align_class, r.joined_before) for r in X.align_class(d).collect()}
    assert {k: v[0] for k, v in got.items()} == {"full": "full", "late": "part", "whole": "tfull", "part": "part", "short": "none", "short whole": "tfull", "broken": "none", "nearly": "part"}
    assert got["broken"][1] == 5 and got["nearly"][1] == 47


def test_breakpoints_go_by_chromosome_and_contigs_have_any_name(spark):
    rows = [("X", "2"), ("10", "2"), ("M", "X"), ("Y", "X"), ("2", "2")]
    d = spark.createDataFrame([(a, 5, "+", b, 9, "+") for a, b in rows], "chrom1 string, tend1 long, strand1 string, chrom2 string, tstart2 long, strand2 string")
    assert [r.bp_a.chrom for r in C.breakpoints(d).collect()] == ["X", "2", "M", "Y", "2"]
    aln = spark.createDataFrame([("k81:ctg_1", 1, 1, 100), ("k81:ctg_1", 200_000, 5, 100), ("k81:ctg_1", 3, 300, 400), ("b", 1, 1, 9)], "query string, aln_no int, qstart long, qend long")
    assert {(r.query, r.aln_no): r.group_no for r in A.group_alignments(aln).collect()} == {("k81:ctg_1", 1): 1, ("k81:ctg_1", 200_000): 1, ("k81:ctg_1", 3): 3, ("b", 1): 1}


def test_events_equal_linking_every_pair(spark):
    rng = random.Random(11)
    rows, spots = [], [(rng.randrange(3000), rng.randrange(3000)) for _ in range(12)]
    for i in range(500):
        a, b = spots[i % 12] if rng.random() < 0.7 else (rng.randrange(3000), rng.randrange(3000))
        rows.append((i, rng.choice("12"), a + rng.randrange(-60, 60), "up", "3", b + rng.randrange(-60, 60), rng.choice(["up", "down"])))
    rows += [(500 + i, "1", 77, "up", "3", 78, "up") for i in range(20)]
    parent = list(range(len(rows)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for reach, length in ((20, 20), (8, 7), (2, 1)):
        parent[:] = range(len(rows))
        for i, x in enumerate(rows):
            for y in rows[:i]:
                if (x[1], x[3], x[4], x[6]) == (y[1], y[3], y[4], y[6]) and abs(x[2] - y[2]) <= reach and abs(x[5] - y[5]) <= reach:
                    u, v = sorted((find(i), find(y[0])))
                    parent[v] = u
        d = spark.createDataFrame(rows, "node long, chrom_a string, coord_a long, dir_a string, chrom_b string, coord_b long, dir_b string")
        got = {r.node: r.group_key for r in G.group_events(d, read_length=length).collect()}
        assert got == {i: find(i) for i in range(len(rows))}


def test_event_numbers_are_by_length_then_key(spark):
    rng = random.Random(12)
    rows = [(k, rng.choice([200, 220, 240])) for k in rng.sample(range(10_000), 700)]
    got = {r.group_key: r.group_id for r in G.group_ids(spark.createDataFrame(rows, "group_key long, longest long").repartition(5)).collect()}
    assert got == {k: i for i, (k, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}


def test_window_support_equals_counting_every_window(spark):
    rng = random.Random(13)
    regions = [(c, k, lo := rng.randrange(2, 60), lo + rng.randrange(0, 40)) for c in range(4) for k in range(3)] + [(9, 0, 5, 30)]
    reads = [(c, rl := rng.randrange(1, 80), rl + rng.randrange(3, 60), rng.random() < 0.5) for c in range(4) for _ in range(60)]
    got = P.window_support(spark.createDataFrame(regions, "contig long, k long, lo long, hi long"), spark.createDataFrame(reads, "contig long, rleft long, rright long, strong boolean"), ["contig", "k"])
    got = {(r.contig, r.k): (r.min_all, round(r.mean_all, 9), r.min_strong, round(r.mean_strong, 9)) for r in got.collect()}
    want = {}
    for c, k, lo, hi in regions:
        n, strong = [], []
        for ws in range(lo, max(lo, hi - 10) + 1):
            over = [x for x in reads if x[0] == c and x[1] <= ws and x[2] >= min(hi, ws + 10)]
            n.append(len(over))
            strong.append(sum(x[3] for x in over))
        want[c, k] = (min(n), round(sum(n) / len(n), 9), min(strong), round(sum(strong) / len(n), 9))
    assert got == want


def test_overlap_join_evaluates_each_side_once(spark):
    a = spark.range(5).selectExpr("id", "'1' AS chrom", "id*10 AS s", "id*10+5000*id AS e")
    b = spark.range(5).selectExpr("id AS id2", "'1' AS chrom", "id*7 AS fs", "id*7+3 AS fe")
    plan = I.overlap_join(a, b, width=10)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 2 and plan.count("Join ") == 1


def test_gap_search_by_seeds_equals_every_diagonal(spark):
    rng = random.Random(14)
    turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    rows = []
    for i in range(60):
        gap = "".join(rng.choice("ACGT") for _ in range(rng.randrange(4, 60)))
        left, right = ("".join(rng.choice("ACGT") for _ in range(rng.randrange(130))) for _ in range(2))
        copy = gap if i % 3 else turn(gap)
        if len(copy) > 45 and i % 2:
            copy = copy[:20] + ("A" if copy[20] != "A" else "C") + copy[21:]
        at = rng.randrange(len(left) + 1)
        left = left[:at] + copy[rng.randrange(3) :] + left[at:] if i % 4 else left
        rows.append((i, left + gap + right, len(left) + 1, len(left) + len(gap), gap, False))
    d = spark.createDataFrame(rows, "id long, seq string, gap_s long, gap_e long, gap_seq string, edge boolean")
    columns = ["id", "score", "inverted", "dup_s", "dup_e", "used_s", "used_e", "distance"]
    got = sorted(tuple(r[c] for c in columns) for r in D.find_gap_duplication(d, ["id"]).collect())

    def best(i, seq, gs, ge, gap):
        size, found = len(gap), []
        lo = max(1, gs - 2 * size)
        for window, at in ((seq[lo - 1 : gs - 1], lo), (seq[ge : ge + 2 * size], ge + 1)):
            if len(window) < 4:
                continue
            for inverted in (False, True):
                g = turn(gap) if inverted else gap
                for shift in range(4 - size, len(window) - 3):
                    now, since, top = 0, 1, (0, 0, 0)
                    for k in range(1, size + 1):
                        j = k + shift
                        now += 1 if 1 <= j <= len(window) and g[k - 1] == window[j - 1] else -1
                        if now <= 0:
                            now, since = 0, k + 1
                        if now > top[0]:
                            top = (now, since, k)
                    score, s, e = top
                    n = e - s + 1
                    if score >= max(4, 0.3 * size) and score >= 0.95 * n:
                        ds = at + shift + s - 1
                        us = ge - e + 1 if inverted else gs + s - 1
                        dist = ds - (us + n - 1) - 1 if ds > us + n - 1 else us - (ds + n - 1) - 1
                        found.append(((score, not inverted, -dist, -ds), (i, score, inverted, ds, ds + n - 1, us, us + n - 1, dist)))
        return max(found)[1] if found else None

    want = sorted(x for r in rows if (x := best(*r[:5])))
    assert got == want and len(want) > 20


def test_conflicting_sequences_are_marked(spark):
    s = spark.createDataFrame([("a", "AC"), ("a", "AC"), ("b", "G"), ("b", "C"), ("c", "T")], "id string, sequence string")
    got = {r.id: (r.sequence, r.conflict) for r in I.sequence_join(spark.createDataFrame([("a",), ("b",), ("b",)], "id string"), s).collect()}
    assert got == {"a": ("AC", False), "b": ("C", True)}


def test_poly_a_tails_and_repeated_rests_are_no_fusions(spark):
    side = "ACGGTCATTGCAGGCTTACC"
    rows = {"good": side + "GTTGACCGATAGC", "tail": side + "G" + "A" * 12, "head": "T" * 12 + "C" + side, "again": side + side[4:16] + "T", "none": None}
    at = {"head": (14, 33, 14, 33)}
    data = [(k, *(at.get(k) or (1, 20, 21, 33))) for k in rows]
    d = spark.createDataFrame(data, "contig string, qs1 long, qe1 long, qs2 long, qe2 long")
    best = spark.createDataFrame([("good", 5, False)], "query string, matches long, perfect boolean")
    seqs = spark.createDataFrame([(k, v) for k, v in rows.items() if v], "contig string, seq string")
    assert {r.contig for r in E.recheck_fusion(d, best, sequences=seqs).collect()} == {"good", "none"}


def test_fusions_whose_sides_or_rests_are_in_transcripts_are_false(spark):
    side, other = "ACGGTCATTGCAGGCTTACC", "GTTGACCGATAGCATTCGGA"
    names = ["good", "shared", "rest", "turned", "lone"]
    d = spark.createDataFrame([(k, 1, 2, 40, 1, 20, 21, 40, 0) for k in names], "contig string, no1 int, no2 int, ctg_len long, qs1 long, qe1 long, qs2 long, qe2 long, part long")
    best = spark.createDataFrame([("good", 5, False)], "query string, matches long, perfect boolean")
    seqs = spark.createDataFrame([(k, side + other) for k in names], "contig string, seq string")
    back = other[::-1].translate(str.maketrans("ACGT", "TGCA"))
    texts = {"t1": side + "TT", "t2": "CC" + other, "t3": "AA" + side + "CC" + other[1:], "t4": "AA" + back[1:] + side, "t5": side}
    hits = [("good", "t1", 1, 20, 20), ("good", "t2", 21, 40, 20), ("good", "t5", 1, 10, 9), ("shared", "t5", 1, 20, 20), ("shared", "t5", 21, 38, 18), ("rest", "t3", 1, 20, 20), ("turned", "t4", 1, 20, 20)]
    hits = spark.createDataFrame(hits, "contig string, target string, qstart long, qend long, match long")
    targets = spark.createDataFrame(list(texts.items()), "target string, seq string")
    assert {r.contig for r in E.recheck_fusion(d, best, 1.5, seqs, hits).collect()} == {"good", "rest", "turned", "lone"}
    assert {r.contig for r in E.recheck_fusion(d, best, 1.5, seqs, hits, targets).collect()} == {"good", "lone"}
    assert E.recheck_fusion(d.limit(0), best, 1.5, seqs, hits, targets).columns == d.columns
    assert {r.contig for r in E.recheck_fusion(d, best, 1.5, seqs, hits.limit(0), targets.limit(0)).collect()} == set(names)


def test_duplications_after_the_contig_met_its_transcript(spark):
    a, b, dup = "ACGGTCATTGCAGGCTTACCGATTACAGGCATCC", "GTTGACCTATAGAATTCGCATGGTAACTCTGAGT", "GGCATCC"
    turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    inner = lambda ins, more=0: (a + ins + b, True, 35, 34 + len(ins), 28, 34, ins, ((1, 34), (35 + len(ins), 68 + len(ins))))
    rows = {
        "dup": inner(dup), "none": inner("TCTTAGA"), "one": inner("TTTTTTT"), "back": inner(turn("GACCTATAG")), "known": inner(dup),
        "thrice": (a + dup + dup + b, True, 35, 41, 28, 34, dup, ((1, 34), (49, 82))), "solid": (a + dup + b, True, 35, 41, 28, 34, dup, ((1, 75),)),
        "after": (a + dup, True, 35, 41, 28, 34, dup, ((1, 34),)), "before": (b[:7] + b, True, 1, 7, 8, 14, b[:7], ((8, 41),)),
        "unlike": (a + "TCTTAGA", True, 35, 41, 28, 34, "x", ((1, 34),)), "split": (a + "TCTTAGA", False, None, None, 28, 34, None, ((1, 34),)),
        "turned": (a + dup, True, 35, 41, 28, 34, dup, ((1, 34),)), "perfect": inner(dup), "no": inner(dup), "big": (a + "TCTTAGAGCAATCGTCCA", True, 35, 52, 28, 34, "x", ((1, 34),)),
        "short": (a + "TC", True, 35, 36, 33, 34, "TC", ((1, 34),)),
    }
    itds = spark.createDataFrame([(k, v[1], v[2], v[3], v[4], v[5], v[4], v[5], v[6]) for k, v in rows.items()], "contig string, gap boolean, gap_s long, gap_e long, dup_s long, dup_e long, b_s long, b_e long, event_seq string")
    best = [(k, f"t_{k}", "+", v[7][0][0], v[7][-1][1], k == "perfect", len(v[7]) - 1, list(v[7])) for k, v in rows.items() if k != "no"]
    best = spark.createDataFrame(best, "contig string, target string, strand string, qstart long, qend long, perfect boolean, n_gaps int, blocks array<struct<s: long, e: long>>")
    hits = [(k, f"u_{k}", "+", 1, 90, 1, 60) for k in ("known", "thrice", "dup")] + [("turned", "t_turned", "-", 30, 41, 0, 12), ("after", "t_other", "-", 30, 41, 0, 12), ("before", "t_before", "+", 1, 12, 0, 12)]
    hits = spark.createDataFrame(hits, "contig string, target string, strand string, qstart long, qend long, n_gaps int, match long")
    seqs = spark.createDataFrame([(k, v[0]) for k, v in rows.items()], "contig string, seq string")
    texts = [(f"t_{k}", a + b) for k in rows] + [("u_known", turn(a + dup + b)), ("u_thrice", a + dup + b), ("u_dup", a + b)]
    targets = spark.createDataFrame(texts, "target string, seq string")
    found = lambda **how: {r.contig: r.outcome for r in E.itd_outcomes(itds, best, hits, seqs, targets, **how).collect()}
    want = dict.fromkeys(["dup", "thrice", "after", "before", "big"], "duplicated") | dict.fromkeys(["none", "one", "back", "unlike", "short"], "unrepeated")
    want |= {"known": "known", "solid": "ungapped", "split": "split", "turned": "turned", "perfect": "perfect", "no": "unaligned"}
    assert found() == want
    assert found(whole_big=True)["big"] == "unrepeated" and found(read_length=61)["known"] == "duplicated"
    good = E.itd_outcomes(itds, best, hits, seqs, targets).where("good").select("contig").collect()
    assert {r.contig for r in good} == {k for k, v in want.items() if v in ("duplicated", "split", "unaligned")}
    assert E.itd_outcomes(itds.limit(0), best, hits, seqs, targets).count() == 0


def test_a_common_run_is_found_as_by_looking_at_all(spark):
    from junctura.functions.scalars import most_copies, shares_run

    draw = random.Random(5)
    text = lambda n: "".join(draw.choice("ACG") for _ in range(n))
    rows = [(text(draw.randrange(0, 30)), text(draw.randrange(0, 30)), draw.randrange(1, 9)) for _ in range(400)]
    d = spark.createDataFrame(rows, "a string, b string, n int").withColumn("got", shares_run("a", "b", "n"))
    got = [r.got for r in d.collect()]
    assert got == [any(a[i : i + n] in b for i in range(len(a) - n + 1)) for a, b, n in rows] and 50 < sum(got) < 350
    d = spark.createDataFrame([("xxabababab", "xab", "ab"), ("aab", "b", ""), ("ababcabab", "ab", "ab"), ("ab", "ab", "ab")], "t string, s string, u string")
    assert [r.k for r in d.select(most_copies("t", "s", "u").alias("k")).collect()] == [3, 0, 1, 0]


def test_outer_edges_are_of_transcripts(spark):
    from junctura.operators import annotate as N

    rows = [("g", "long", 100, 200), ("g", "long", 300, 400), ("g", "long", 500, 600), ("g", "short", 320, 400), ("g", "short", 500, 580)]
    f = spark.createDataFrame([("1", g, t, "exon", s, e) for g, t, s, e in rows] + [("1", "g", "short", "intron", 401, 499)], "chrom string, gene string, transcript string, feature string, fs long, fe long")
    edges = lambda *by: {(r.edge, r.side) for r in N.exon_edges(f, *by).collect()}
    inner = {(300, "left"), (500, "left"), (200, "right"), (400, "right")}
    assert edges(("gene", "transcript")) == inner and edges() == inner | {(320, "left"), (580, "right")}


def test_genes_at_the_breakpoint_come_first(spark):
    rows = [("a", "A", "g", "intron", 0), ("a", "A", "h", "exon", 1), ("a", "B", "k", "intron", 2), ("a", "B", "k", "exon", 2), ("b", "A", "h", "utr", 1), ("b", "A", "n", "exon", 2)]
    d = spark.createDataFrame(rows, "contig string, region string, gene string, feature string, source int")
    got = sorted(tuple(r) for r in E.preferred_genes(d, ["contig"]).collect())
    assert got == [("a", "A", "g", "intron"), ("a", "B", "k", "nearby"), ("b", "A", "h", "utr")]

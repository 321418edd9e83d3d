"""Hand-made rows of the gap filter, primary clusters and coverage steps."""

from __future__ import annotations

import random
import warnings

from junctura.operators import compare, gaps, support


def test_gap_filter_leaves_out_m_and_odd_chromosomes(spark):
    rows = [(f"q{i}", 1, c, 90, 1, 90, 100, 950) for i, c in enumerate(["1", "chrX", "M", "chrM", "MT", "6_hap1", "Un_random", "22", None])]
    aln = spark.createDataFrame(rows, "query string, aln_no int, chrom string, score int, qstart int, qend int, query_len int, identity_x10 int")
    assert sorted(r.chrom for r in gaps.gap_eligible(aln).collect()) == ["1", "22", "chrX"]


def marked(spark, rows):
    df = spark.createDataFrame(rows, "node int, contig int, multi boolean, other boolean, group_key int")
    return {r.group_key: r.primary for r in compare.primary_of_cluster(df).collect()}


def test_primary_belongs_to_the_cluster_and_moves(spark):
    rows = [
        (1, 10, False, False, 1), (2, 11, True, False, 1),  # a sure member; the first of contig 11
        (3, 11, True, False, 3), (4, 12, True, False, 4),  # not the first; the first of contig 12
        (5, 12, True, False, 5), (6, 90, True, True, 5),  # confirmed: takes over from 4
        (7, 91, False, True, 7),  # of the other caller alone
        (8, 13, True, False, 8), (9, 92, False, True, 8),  # confirmed, but the first already
    ]
    assert marked(spark, rows) == {1: True, 3: False, 4: False, 5: True, 7: True, 8: True}


def test_no_clusters(spark):
    assert marked(spark, [(1, 1, True, True, 1)][:0]) == {}


def test_steps_and_bases_equal_brute_force(spark):
    rng = random.Random(4)
    regions = [(i, "fusion" if i % 2 else "itd", i % 3, 100 + 7 * i, 160 + 5 * i, 120 + 3 * i, 140 + 6 * i) for i in range(20)]
    reads = [(rng.randrange(3), s, s + rng.randrange(5, 90)) for s in (rng.randrange(60, 330) for _ in range(300))]
    r = spark.createDataFrame(regions, "k int, event_type string, chrom int, s int, e int, bp1 int, bp2 int")
    d = spark.createDataFrame(reads, "chrom int, fs int, fe int")

    def kind(event, s, e, p, q):
        lo, hi = min(p, q), max(p, q)
        if event == "fusion":
            return "DW" if s < p < e or s < q < e else "T1"
        return "DW" if s < lo and e > hi else "T2" if lo < s and hi > e else "T1"

    want = {}
    for k, event, chrom, s, e, p, q in regions:
        for at in range(s, e + 1):
            found = [kind(event, a, b, p, q) for c, a, b in reads if c == chrom and a + 5 <= at <= b - 5]
            want[k, at] = tuple(found.count(x) for x in ("DW", "T1", "T2"))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        bases = {(x.k, x.at): (x.DW, x.T1, x.T2) for x in support.base_coverage(r, d, ["k"]).collect()}
        steps = {(x.k, x.at): (x.DW, x.T1, x.T2) for x in support.coverage_steps(r, d, ["k"]).collect()}
    assert bases == want and all(want[key] == v for key, v in steps.items()) and len(steps) < len(bases)

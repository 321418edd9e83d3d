"""Queries against their SQL, and properties that hold for any input."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from junctura.functions import scalars as S
from junctura.operators import candidates as C
from junctura.operators import gaps as D
from junctura.operators import intervals as I
from junctura.operators.components import connected_components
from junctura.plans import catalog

from .compare import connect, differences

#: One query of each family; the driver compares all of them.
CHOSEN = "c01_screen_top_n c03_group_alignments c12_topology_counts c13_breakpoints j01_overlap_any j05_nearest_feature g03_group_events g13_window_support p15_filter_groups e05_predict_fusion k03_vcf_fusion s01_read_psl".split()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_sql(spark, small, con, name):
    assert differences(catalog.QUERIES[name](spark, small), con, catalog.ORACLE[name]) == ""


def test_every_query_has_a_name_of_its_own():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES) and len(catalog.QUERIES) > 120


def test_entry_works_without_the_llm_parts(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_overlap_join_equals_brute_force_for_any_width(spark):
    rng = random.Random(1)
    ranges = lambda n, most: [(i, rng.choice("ab"), s := rng.randrange(2000), s + rng.randrange(most)) for i in range(n)]
    left, right = ranges(60, 900), ranges(60, 40)
    a = spark.createDataFrame(left, "id long, chrom string, s long, e long")
    b = spark.createDataFrame(right, "id2 long, chrom string, fs long, fe long")
    want = sorted((x[0], y[0]) for x in left for y in right if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])
    for width in (3, 50, 5000):
        assert sorted(map(tuple, I.overlap_join(a, b, width=width).select("id", "id2").collect())) == want


def test_components_do_not_depend_on_order(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(500, 500), (None, 1)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for u, v in edges:
        if u is not None and u != v:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_branches_that_the_tables_do_not_reach(spark):
    aln = spark.createDataFrame(
        [("q", 1, 200, 1, 110, 1, "+", 1000, 1109, 1000, 1109, 1000), ("q", 2, 200, 100, 200, 1, "+", 1005, 1105, 1005, 1105, 1000)],
        "query string, aln_no int, query_len long, qstart long, qend long, chrom long, strand string, tleft long, tright long, tstart long, tend long, identity_x10 int",
    )
    assert C.split_candidates(aln).first().topology == "end-duplication"
    r = one(
        spark, S.cigar_blocks(F.lit("3M2X"), F.lit(1)).alias("bad"), S.cigar_blocks(F.lit("2S3M1D4M5N2M1I1M"), F.lit(10)).alias("b"), S.is_run_soft(F.lit("AATAA")).alias("soft"),
        S.is_run_soft(F.lit("TAAA")).alias("first"), S.is_run_soft(F.lit("ACGT")).alias("none"), S.contains_strictly(F.lit(1), F.lit(9), F.lit(1), F.lit(5)).alias("edge"), S.n_fraction(F.lit("ANNA")).alias("n"),
        S.gene_label(F.lit("ABX2X.non_coding"))["name"].alias("g"), S.chrom_order(F.lit("chrMT")).alias("m"), S.is_standard_chrom(F.lit("chr6_hap")).alias("hap"),
    )
    assert r.bad is None and [(x.s, x.e) for x in r.b] == [(10, 12), (14, 17), (23, 24), (25, 25)]
    assert r.soft and r.first and not r.none and not r.edge and r.n == 0.5 and r.g == "AB" and r.m == -2 and not r.hap


def test_gap_duplications_of_hand_made_contigs(spark):
    head, dup = "ACGGTCATTGCAGGCTTACC", "TTGACCGATA"
    turned = dup[::-1].translate(str.maketrans("ACGT", "TGCA"))
    rows = [("tandem", head + dup, dup, head), ("far", "GG" + dup[4:] + "GTGTTGTG", dup, "GTGGTGTTGG"), ("inverted", head + turned, dup, head), ("none", head, "GTGTGTGTGT", head), ("poly", head, "A" * 10, "")]
    data = [(n, a + g + b, [(1, len(a))] + ([(len(a + g) + 1, len(a + g + b))] if b else [])) for n, a, g, b in rows]
    contigs = spark.createDataFrame(data, "name string, seq string, blocks array<struct<s:bigint,e:bigint>>")
    gaps = D.explode_gaps(contigs)
    assert {r.name for r in gaps.collect()} == {"tandem", "far", "inverted", "none"}
    found = {r.name: r for r in D.classify_tandem(D.find_gap_duplication(gaps, ["name", "gap_s", "gap_e"], min_share=0.6)).collect()}
    assert set(found) == {"tandem", "far", "inverted"}
    assert found["tandem"].topology == "gap-tandem-duplication" and found["tandem"].distance == 0 and found["tandem"].score == 10
    assert found["far"].topology == "gap-nontandem-duplication" and found["far"].distance == 12
    assert found["inverted"].inverted


def test_strands_mirror_topologies(spark, small):
    from junctura.plans.queries_candidates import aln

    a = aln(spark, small)
    turn = a.withColumn("strand", F.when(F.col("strand") == "+", "-").otherwise("+")).withColumn("x", F.col("tstart")).withColumn("tstart", F.col("tend")).withColumn("tend", F.col("x")).drop("x")
    counts = [{r.topology: r["count"] for r in C.topology(C.split_metrics(C.pair_alignments(d, min_represented=0.6))).groupBy("topology").count().collect()} for d in (a, turn)]
    assert counts[0]["interchr"] == counts[1]["interchr"]
    strands = lambda c: sum(c.get(k, 0) for k in ("intrachr-opp-strand", "local-inversion"))
    assert strands(counts[0]) == strands(counts[1])

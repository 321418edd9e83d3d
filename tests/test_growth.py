"""Steps that must not grow faster than their input."""

from __future__ import annotations

import itertools
import random
import re

from pyspark.sql import functions as F

from junctura.operators import intervals as I


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranges_are_few_rows_at_any_width_and_not_broadcast_by_file_size(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(2), s, s + rng.choice((0, 7, 60, 300, 5000))) for i, s in enumerate(rng.randrange(20000) for _ in range(300))]
    a = spark.createDataFrame(rows, "id long, chrom long, s long, e long")
    b = a.selectExpr("id AS fid", "chrom", "s + 13 AS fs", "e + 13 AS fe")
    assert I._binned(a.where("e - s = 300"), "s", "e", 8, True, "b").groupBy("id").count().agg(F.max("count")).first()[0] <= 6
    for width in (8, 40, 1000):
        hits = I.overlap_join(a, b, "half", width)
        assert "BroadcastHashJoin" not in plan(hits)
        want = sorted((i, j) for (i, c, s, e), (j, d, fs, fe) in itertools.product(rows, [(i, c, s + 13, e + 13) for i, c, s, e in rows]) if c == d and 2 * (min(e, fe) - max(s, fs) + 1) >= e - s + 1)
        assert sorted((r.id, r.fid) for r in hits.select("id", "fid").collect()) == want


def test_gene_pairs_match_without_gathering_what_matched(spark):
    from junctura.operators.compare import gene_partner_match

    ours = spark.createDataFrame([(1, ["a", "b"], ["b", "a"]), (2, ["a"], ["a"]), (3, ["c"], [])], "id long, genes_a array<string>, genes_b array<string>")
    theirs = spark.createDataFrame([(7, "a", "b"), (7, "a", "b"), (8, "b", "a"), (9, "a", "a"), (5, None, "a"), (6, "c", "a")], "id2 long, gene1 string, gene2 string")
    m = gene_partner_match(ours, theirs)
    assert sorted(map(tuple, m.collect())) == [(1, 7), (1, 8), (1, 9), (2, 9)]
    top = plan(m).split("Join")[0]
    assert "Aggregate" not in top and "Exchange" not in top


def test_keys_go_to_the_largest_key_that_contains_them(spark):
    from junctura.operators.recurrence import merged_keys

    rng = random.Random(3)
    names = ["a", "b", "b,c", "c", "d", "e", "f", "g"]
    keys = {("x" if rng.random() < 0.5 else "y", tuple(sorted(rng.sample(names, rng.randint(1, 6))))) for _ in range(60)}
    df = spark.createDataFrame([(t, list(k)) for t, k in keys], "event_type string, gene_key array<string>")
    want = {(t, k): min((b for u, b in keys if u == t and set(k) <= set(b)), key=lambda b: (-len(b), ",".join(b))) for t, k in keys}
    for most in (10, 3, 0):  # keys beyond ``most`` genes are looked up, the same way round
        got = {(r.event_type, tuple(r.gene_key)): tuple(r.key) for r in merged_keys(df, most).collect()}
        assert got == want


def test_fusions_are_rechecked_in_their_rows_without_joining_sequences_back(spark):
    from junctura.operators import predict as E

    bases = "ACGGTCATTGCAGGCTTACCGTTGACCGATAGCATTCGGA"
    d = spark.createDataFrame([(k, 1, 2, 40, 1, 20, 21, 40) for k in ("a", "b", "c", "d")], "contig string, no1 int, no2 int, ctg_len long, qs1 long, qe1 long, qs2 long, qe2 long")
    best = spark.createDataFrame([("a", 5, False)], "query string, matches long, perfect boolean")
    seqs = spark.createDataFrame([(k, bases) for k in "abcd"], "contig string, seq string")
    # a: the transcript that both sides share has 10 matches fewer than the best; b: 9 fewer; c: shares 14 of 20 bases; d: of two best hits the first by target has the rest.
    hits = [("a", "t1", 1, 20, 20), ("a", "t2", 1, 20, 10), ("a", "t2", 21, 40, 20), ("b", "t1", 1, 20, 20), ("b", "t2", 1, 20, 11), ("b", "t2", 21, 40, 20), ("c", "t1", 7, 26, 20), ("c", "t1", 21, 40, 20), ("d", "t3", 1, 20, 20), ("d", "t4", 1, 20, 20)]
    hits = spark.createDataFrame(hits, "contig string, target string, qstart long, qend long, match long")
    targets = spark.createDataFrame([("t3", bases), ("t4", "T")], "target string, seq string")
    for some, want in ((None, "acd"), (targets, "ac")):
        out = E.recheck_fusion(d, best, 1.5, seqs, hits, some)
        assert "Window" not in plan(out) and sorted(r.contig for r in out.collect()) == list(want)


def test_calls_are_compared_without_a_row_for_each_gene_set_or_neighbouring_cell(spark, small):
    from junctura.operators import compare as X
    from junctura.plans import queries_outcomes as Q

    rng = random.Random(4)
    ends = lambda n: [(i, rng.choice((1, 2)), rng.randrange(-900, 9000), rng.choice((1, None)), rng.randrange(900)) for i in range(n)]
    ours, theirs = ends(120), ends(120)
    cols = "{} long, chrom_a long, coord_a long, chrom_b long, coord_b long"
    a, b = spark.createDataFrame(ours, cols.format("id")), spark.createDataFrame(theirs, cols.format("id2"))
    for buffer in (0, 100, 1000):
        got = sorted(map(tuple, I.location_match(a, b, buffer).collect()))
        far = lambda x, y: max(abs(x[2] - y[2]), abs(x[4] - y[4]))
        assert got == sorted((x[0], y[0], far(x, y)) for x in ours for y in theirs if x[1] == y[1] and x[3] == y[3] == 1 and far(x, y) <= buffer)
        assert buffer < 1000 or got
    sets = spark.createDataFrame([(["a", "b"], ["b"]), (["a"], []), (["b"], ["a"])], "genes_a array<string>, genes_b array<string>")
    assert sorted(map(tuple, X.gene_partners(sets).collect())) == [("a", "b"), ("b", "a"), ("b", "b")]
    p = plan(Q.compared_calls(spark, small))
    # Of the given tables nothing is read or joined again once the members are there, and no set of genes is made a text.
    assert "BroadcastExchange" not in p and "to_json" not in p and "lineitem" not in p


def test_base_coverage_looks_reads_up_where_its_regions_are(spark, small, monkeypatch):
    from junctura.operators import support as P
    from junctura.plans import catalog

    rng = random.Random(6)
    reads = [(rng.choice((1, 2)), s, s + rng.choice((8, 9, 10, 30, 74, 200))) for s in (rng.randrange(-50, 400) for _ in range(80))] + [(1, 100, 174)] * 9 + [(None, 5, 90), (1, None, 40)]
    regions = [(i, rng.choice((1, 2, 3)), s, s + rng.choice((0, 59, 130)), rng.choice(("fusion", "itd")), p, rng.choice((None, p + 300, p - 80, s))) for i, s, p in ((i, rng.randrange(-90, 500), rng.randrange(-90, 500)) for i in range(50))]
    regions += [(50, 1, 80, 60, "itd", 0, 500), (51, 1, None, 60, "itd", 0, 500), (52, None, 100, 120, "fusion", 110, None)]

    def kind(r, s, e):
        p, q = r[5], r[6]
        if r[4] == "fusion":
            return "DW" if s < p < e or (q is not None and s < q < e) else "T1"
        if q is None:
            p, q = p, p
        lo, hi = min(p, q), max(p, q)
        return "DW" if s < lo and e > hi else "T2" if lo < s and hi > e else "T1"

    want = []
    for r in regions:
        for at in range(r[2], r[3] + 1) if r[2] is not None else ():
            n = {"DW": 0, "T1": 0, "T2": 0}
            for c, s, e in reads:
                if c == r[1] and c is not None and s is not None and s + 5 <= at <= e - 5:
                    n[kind(r, s, e)] += 1
            want.append((r[0], at, *n.values()))
    a = spark.createDataFrame(regions, "id long, chrom long, s long, e long, event_type string, bp1 long, bp2 long")
    d = spark.createDataFrame(reads, "chrom long, fs long, fe long")
    for few in (1 << 20, 0):
        monkeypatch.setattr(P, "FEW_DEPTHS", few)
        for width in (1000, 32):
            out = P.base_coverage(a, d, ["id"], width=width)
            assert ("BroadcastHashJoin" in plan(out)) == (few > 0)
            assert sorted(tuple(r) for r in out.select("id", "at", "DW", "T1", "T2").collect()) == sorted(want)
    monkeypatch.undo()
    # The alignments alone are shuffled, for either side of a pair (they share it when run); regions and sums stay.
    p = plan(catalog.QUERIES["g21_base_coverage"](spark, small))
    assert p.count("Exchange hashpartitioning") == 2 and p.count("Exchange") == 3 and "BroadcastExchange" in p


def test_calls_of_two_genes_are_made_without_a_broadcast_by_file_size(spark, small):
    from junctura.plans import catalog

    p = plan(catalog.QUERIES["j14_gene_partner_match"](spark, small))
    # Features are joined with features by shuffle.
    assert p.count("part.parquet") == 2 and "BroadcastHashJoin [id2" not in re.sub(r"#\d+L?", "", p)


def test_recurrence_does_not_broadcast_keys_by_file_size(spark):
    from junctura.operators import recurrence as R

    rows = [(1, "x", ["a"], "l"), (2, "x", ["a", "b"], "m"), (3, "x", ["a", "b"], "m"), (4, "x", ["c"], "l"), (5, "y", ["a"], "l"), (6, "x", list("abcdefghijkl"), None), (7, "x", ["k", "l"], "l")]
    keyed = spark.createDataFrame(rows, "event_id long, event_type string, gene_key array<string>, lib string")
    big = tuple("abcdefghijkl")
    got = R.recurrence(keyed)
    totals, split = R.recurrence_totals(keyed), R.split_recurrent(keyed)
    for df in (R.merged_keys(keyed), got, totals, split):
        assert "Broadcast" not in plan(df)
    assert {(r.event_type, tuple(r.key)): (r.libraries, r.n_events, r.recurrent) for r in got.collect()} == {("x", big): (["l", "m"], 6, True), ("y", ("a",)): (["l"], 1, False)}
    assert {r.event_id: r.recurrent for r in split.collect()} == {1: True, 2: True, 3: True, 4: True, 5: False, 6: True, 7: True}
    assert {(r.event_type, r.lib): (r.n_predictions, r.n_genes) for r in totals.collect()} == {("x", "l"): (3, 1), ("x", "m"): (1, 1), ("x", None): (5, 1), ("y", "l"): (1, 1), ("y", None): (1, 1)}


def test_events_evaluate_their_junctions_once(spark):
    from junctura.operators.grouping import group_events

    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    at = [(1, 100), (2, 190), (3, 5000), (4, 5000), (5, 400)]
    j = spark.createDataFrame([(n, 1, c, "up", 2, c, "down") for n, c in at], "node long, chrom_a long, coord_a long, dir_a string, chrom_b long, coord_b long, dir_b string")
    out = group_events(j.withColumn("coord_a", counted("coord_a")), read_length=200)
    assert {r.node: r.group_key for r in out.collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    assert seen.value == len(at)


def test_numbered_chromosomes_are_not_read_as_names(spark):
    from junctura.operators.candidates import breakpoints, split_candidates

    cols = "query long, aln_no int, query_len long, qstart long, qend long, chrom {}, strand string, tleft long, tright long, tstart long, tend long, identity_x10 int"
    rows = [(1, k, 200, 1 + 90 * k, 100 + 90 * k, c, "+", 50 * k, 50 * k + 99, 50 * k, 50 * k + 99, 1000) for k, c in enumerate((10, 9))] + [(2, k, 200, 1 + 90 * k, 100 + 90 * k, c, "+", 5, 9, 5, 9, 1000) for k, c in enumerate((0, 2))]
    found = {}
    for kind in ("long", "string"):
        a = spark.createDataFrame([(*r[:5], str(r[5]) if kind == "string" else r[5], *r[6:]) for r in rows], cols.format(kind))
        b = breakpoints(split_candidates(a, min_represented=0.6))
        found[kind] = [(r.contig, int(r.bp_a.chrom), r.bp_a.coord, int(r.bp_b.chrom)) for r in b.collect()]
        assert ("regexp_replace" in plan(b)) == (kind == "string")
    assert found["long"] == found["string"] == [(1, 9, 50, 10)]


def test_base_coverage_reads_its_regions_for_steps_alone_and_counts_equal_reads_once(spark):
    from junctura.operators.support import base_coverage

    regions = spark.createDataFrame([(1, 1, 10, 15, "fusion", 12, None), (2, 2, 5, 6, "fusion", None, 6)], "id long, chrom long, s long, e long, event_type string, bp1 long, bp2 long")
    reads = spark.createDataFrame([(1, 6, 18)] * 3 + [(1, 1, 4)], "chrom long, fs long, fe long")
    out = base_coverage(regions, reads, ["id"], trim=5)
    assert plan(out).count("SortMergeJoin") + plan(out).count("BroadcastHashJoin") == 1
    got = {(r.id, r.at): (r.DW, r.T1, r.T2) for r in out.collect()}
    assert got == {(1, p): ((3, 0, 0) if 11 <= p <= 13 else (0, 0, 0)) for p in range(10, 16)} | {(2, p): (0, 0, 0) for p in (5, 6)}


def test_genes_are_worked_out_by_place_as_by_member(spark):
    from junctura.operators import predict as E

    rng = random.Random(9)
    places = [(c, p) for c in (1, 2) for p in range(6)]
    hits = [(c, p, g, rng.choice(("exon", "utr", "intron")), rng.choice(("+", "-", "*", None)), rng.randrange(3)) for c, p in places[:-2] for g in rng.sample("abcd", rng.randint(0, 3))]
    around = spark.createDataFrame(hits, "chrom long, coord long, gene string, feature string, direction string, source int")
    members = [(i, *rng.choice(places), *rng.choice(places), rng.choice("+-"), rng.choice("+-")) for i in range(80)]
    m = spark.createDataFrame(members, "id long, chrom_a long, coord_a long, chrom_b long, coord_b long, strand1 string, strand2 string")
    each = m.selectExpr("id", "'A' AS region", "chrom_a AS chrom", "coord_a AS coord", "strand1 AS strand").unionByName(m.selectExpr("id", "'B' AS region", "chrom_b AS chrom", "coord_b AS coord", "strand2 AS strand")).join(around, ["chrom", "coord"])

    def oriented(found):
        # Each row has its direction: two genes of one name do not agree here by place alone.
        d = found.withColumn("gene", F.concat("gene", F.lit(":"), "chrom", F.lit(":"), "coord"))
        names = d.select("gene", "direction").distinct()
        return {r.id: (r.orient_a, r.orient_b) for r in E.orientation(d.drop("direction"), names, ["id"]).collect()}

    plain = {r.id: (r.genes_a, r.genes_b, r.coding_a, r.coding_b) for r in E.side_genes(each, ["id"]).collect()}
    got = E.at_places(m, E.place_genes(around))
    assert plan(got).count("Window") == 0
    rows = {r.id: r for r in got.where("size(genes_a) > 0 OR size(genes_b) > 0").collect()}
    assert {k: (r.genes_a, r.genes_b, r.coding_a, r.coding_b) for k, r in rows.items()} == plain
    assert {k: (r.orient_a, r.orient_b) for k, r in rows.items()} == oriented(each)
    kept = E.preferred_genes(each.select("id", "region", "strand", "chrom", "coord", "gene", "feature", "direction", "source"), ["id"])
    ends = {r.id: (r.orient_a, r.orient_b) for r in E.at_places(m, E.place_directions(around)).collect()}
    assert {k: v for k, v in ends.items() if k in rows} == oriented(kept)


def test_sets_of_genes_are_not_broadcast_by_file_size(spark):
    from junctura.operators import predict as E
    from junctura.plans.session import stored

    around = spark.createDataFrame([(1, 5, "g", "exon", "+"), (1, 5, "h", "intron", "-"), (2, 9, "k", "utr", "+")], "chrom long, coord long, gene string, feature string, direction string")
    members = stored(spark.createDataFrame([(1, 1, 5, 2, 9, "+", "-"), (2, 1, 5, 1, 6, "-", "-")], "id long, chrom_a long, coord_a long, chrom_b long, coord_b long, strand1 string, strand2 string"), "members")
    for how, n in (("left", 2), ("inner", 1)):
        got = E.at_places(members, stored(E.place_genes(around), "genes"), how)
        assert "BroadcastHashJoin" not in plan(got) and "BroadcastExchange" not in plan(got)
        rows = {r.id: (r.genes_a, r.genes_b, r.orient_a, r.orient_b) for r in got.collect()}
        assert len(rows) == n and rows[1] == (["g"], ["k"], "+", "-")
    assert E.at_places(members, stored(E.place_genes(around), "genes")).where("id = 2").first().genes_b == []


def test_genes_of_places_come_from_ranges_that_grow_with_features_alone(spark):
    from junctura.operators import predict as E

    rng = random.Random(12)
    rows = [(i, rng.choice((1, 2)), s, s + rng.choice((-9, 0, 3, 40, 40, 300)), rng.choice("abcde"), rng.choice(("exon", "utr", "intron")), rng.choice("+-*")) for i, s in enumerate(rng.randrange(-40, 600) for _ in range(40))]
    rows += [(40, None, 5, 9, "a", "exon", "+"), (41, 1, None, 9, "a", "exon", "+"), rows[3]]
    f = spark.createDataFrame(rows, "id long, chrom long, fs long, fe long, gene string, feature string, direction string")
    at, reaches = ("chrom", "bin", "s", "e"), (2, 20, 60)
    # Features near each place, by looking at all of them.
    near = {(c, x): {r for r in rows if r[1] == c and r[2] is not None and r[2] - 60 <= x <= r[3] + 60} for c in (1, 2) for x in range(-130, 1000)}
    for width in (500, 37):
        found = I.near_ranges(f, reaches, width)
        got = {}
        for r in found.collect():
            for x in range(r.s, r.e + 1):
                assert x // width == r.bin
                for k in reaches:  # the same for all places of the range
                    assert (r.fs - k <= x <= r.fe + k) == (r.fs - k <= r.s <= r.fe + k)
                got.setdefault((r.chrom, x), set()).add((r.id, r.chrom, r.fs, r.fe, r.gene, r.feature, r.direction))
        assert got == {k: v for k, v in near.items() if v}
        hits = [(c, x, *h[4:]) for (c, x), v in near.items() for h in v]
        each = spark.createDataFrame(hits, "chrom long, coord long, gene string, feature string, direction string")
        m = spark.createDataFrame([(i, rng.choice((1, 2, None)), rng.choice((rng.randrange(-140, 1010), None)), rng.choice((1, 2, 3)), rng.randrange(-140, 1010), rng.choice("+-"), rng.choice("+-")) for i in range(200)], "id long, chrom_a long, coord_a long, chrom_b long, coord_b long, strand1 string, strand2 string")
        names = ["id", "genes_a", "genes_b", "coding_a", "coding_b", "orient_a", "orient_b"]
        for how in ("left", "inner"):
            one, other = E.at_places(m, E.place_genes(found, at), how, width).select(names), E.at_places(m, E.place_genes(each), how).select(names)
            assert sorted(map(repr, one.collect())) == sorted(map(repr, other.collect()))
            assert 0 < one.count() <= 200


def test_pairs_of_alignments_share_one_shuffle(spark, small):
    from junctura.plans import queries_candidates as Q

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = Q.junctions(spark, small)
        d.collect()
        assert "ReusedExchange" in plan(d).split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pairs_of_alignments_stay_where_their_numbers_were_given(spark, small):
    from junctura.plans import queries_candidates as Q

    d = Q.junctions(spark, small)
    # Both sides are there in the plan that is not run yet; they share theirs.
    assert plan(d).count("Exchange hashpartitioning") == 2 and "BroadcastExchange" not in plan(d)
    d.collect()
    assert plan(d).split("Initial Plan")[0].count("ReusedExchange") == 1
    number = ["query", "aln_no", "tleft", "tright", "mismatch"]
    assert sorted(Q.aln(spark, small).select(number).collect()) == sorted(Q.aln(spark, small, in_place=False).select(number).collect())
    assert Q.aln(spark, small).schema.simpleString() == Q.aln(spark, small, in_place=False).schema.simpleString()


def test_events_are_counted_without_a_row_for_each_gene(spark):
    from junctura.operators.recurrence import counts

    rows = [(1, "x", "l", ["b", "a"]), (1, "x", "m", ["a"]), (2, "x", "l", ["c"]), (3, "x", None, ["d"]), (4, "y", "l", []), (5, None, "l", ["a"])]
    out = counts(spark.createDataFrame(rows, "event_id long, event_type string, lib string, gene_key array<string>"))
    assert "Expand" not in plan(out) and "Generate" not in plan(out)
    got = sorted(((r.event_type, r.lib, r.n_events, r.n_genes, r.genes) for r in out.collect()), key=repr)
    assert got == sorted([("x", "l", 2, 3, ["a", "b", "c"]), ("x", "m", 1, 1, ["a"]), ("x", None, 1, 1, ["d"]), ("x", None, 3, 4, ["a", "b", "c", "d"])], key=repr)


def test_doubled_parts_are_found_for_all_lengths_at_once(spark, monkeypatch):
    from junctura.operators import predict as E

    rng = random.Random(5)
    texts = [(g, "".join(rng.choice("ACé日") for _ in range(rng.choice((0, 1, 7, 60, 300))))) for g in "xyz" for _ in range(12)] + [("x", None), (None, "ACACAC"), ("w", "GTGT")]
    cuts = [(i, "".join(rng.choice("ACé日") for _ in range(rng.randint(1, 4))), rng.choice("xyzv")) for i in range(150)] + [(150, "AC", None), (151, "", "x"), (152, None, "x"), (153, "AA", "x"), (154, "GT", "w"), (155, "TG", "w")]
    events = spark.createDataFrame(cuts, "contig long, dup_seq string, gene string")
    t = spark.createDataFrame(texts, "gene string, seq string").repartition(2)
    want = sorted(i for i, d, g in cuts if d is not None and (d == "" or len(set(d)) > 1) and not (d and any(h == g and g is not None and s is not None and d + d in s for h, s in texts)))
    for few, piece in ((100, 1 << 20), (0, 50)):
        monkeypatch.setattr(E, "FEW_GENES", few)
        monkeypatch.setattr(E, "PIECE", piece)
        out = E.recheck_itd(events, t, t)
        assert "regexp_extract_all" not in plan(out) and "MapInArrow" in plan(out)
        assert sorted(r.contig for r in out.collect()) == want
    assert 0 < len(want) < len(cuts) - 20


def test_highest_coverage_needs_no_row_for_a_region_and_a_read(spark, small, monkeypatch):
    from junctura.operators import support as P
    from junctura.plans import catalog

    rng = random.Random(8)
    reads = [(rng.choice((1, 2)), s, s + rng.choice((8, 9, 10, 30, 74, 74, 200))) for s in (rng.randrange(-50, 900) for _ in range(250))] + [(1, 400, 474)] * 30 + [(None, 5, 90), (1, None, 40)]
    regions = []
    for i in range(60):
        for r in "AB"[: 1 if i == 59 else 2]:
            s, p = rng.randrange(-90, 1200), rng.randrange(-90, 1200)
            regions.append((i, 1 + i % 3, r, rng.choice((1, 2, 3)), s, s + rng.choice((0, 59, 59, 130)), rng.choice(("fusion", "itd", "itd")), p, rng.choice((None, p + 300, p - 80, p + 900, s))))
    regions[7] = (*regions[7][:4], None, *regions[7][5:])
    regions += [(70, 1, "A", 1, 80, 60, "itd", 0, 500), (70, 1, "B", None, 1, 60, "itd", 0, 500)]
    e = spark.createDataFrame(regions, "id long, C long, region string, chrom long, s long, e long, event_type string, bp1 long, bp2 long")
    d = spark.createDataFrame(reads, "chrom long, fs long, fe long")
    base = {}
    for i, c, r, chrom, s, end, event, p, q in regions:
        lo, hi = (min(p, q), max(p, q)) if q is not None else (p, p)
        best = (-c, 0) if s is None or chrom is None or s > end else None
        for at in range(s, end + 1) if best is None else ():
            here = [(a, b) for k, a, b in reads if k is not None and a is not None and k == chrom and a + 5 <= at <= b - 5]
            inner = event != "fusion" and any(lo < a and b < hi for a, b in here)
            best = max(best or (-(10**9), 0), (len(here) - c * (3 if inner else 1), len(here)))
        base.setdefault(i, {})[r] = best
    want = sorted((i, *x["A"], *x.get("B", (None, None))) for i, x in base.items())
    for few in (1 << 20, 0):
        monkeypatch.setattr(P, "FEW_DEPTHS", few)
        for width in (240, 32):
            out = P.relative_coverage(P.peak_coverage(e, d, ["id", "C"], width=width), None, ["id"])
            assert "Window" not in plan(out) and ("BroadcastHashJoin" in plan(out)) == (few > 0)
            assert sorted(tuple(r) for r in out.select("id", "W_a", "T_a", "W_b", "T_b").collect()) == want
    monkeypatch.undo()
    # The pairs of alignments alone are joined and shuffled; what comes after stays where they are.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, moved in (("g22_relative_coverage", 4), ("g22_event_coverage", 5)):
            q = plan(catalog.QUERIES[name](spark, small))
            assert q.count("SortMergeJoin") == 1 and q.count("Exchange hashpartitioning") == moved, q
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

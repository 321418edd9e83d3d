"""Queries over the whole of their tables, not a part that is easy to do."""

from __future__ import annotations

import random

import pytest

from junctura.operators import gaps as D
from junctura.plans import catalog
from junctura.plans import fixtures
from junctura.plans import queries_events as V
from junctura.plans import queries_outcomes as Q

from .compare import connect, norm


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


def rows(df, *columns):
    return sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)


def sql_rows(con, name, *columns):
    cur = con.execute(catalog.ORACLE[name])
    at = [[x[0] for x in cur.description].index(c) for c in columns]
    return sorted((tuple(norm(r[i]) for i in at) for r in cur.fetchall()), key=repr)


def bases(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice("ACGT") for _ in range(n))


def test_contigs_hold_all_of_every_text(spark):
    texts = {0: bases(299, 1), 39: bases(900, 2), 40: bases(701, 3), 79: bases(137, 4), 80: bases(5, 5), 82: bases(7, 6), 120: "", 160: None}
    seqs = spark.createDataFrame(list(texts.items()), "seq_id long, seq string")
    got = {}
    for r in Q.contigs_of(seqs).orderBy("seq_id", "contig_no").collect():
        assert all(1 <= b.s <= b.e <= len(r.seq) for b in r.blocks)
        got.setdefault(r.seq_id, []).append(r.seq)
    assert {k: list(map(len, v)) for k, v in got.items()} == {0: [299], 39: [300] * 3, 40: [300, 300, 101], 79: [137], 80: [5], 82: [7]}
    assert all("".join(got[k]) == texts[k] for k in (0, 40, 80))  # nothing is put into these
    dups = D.find_gap_duplication(D.explode_gaps(Q.contigs_of(seqs.where("seq_id=39"))), Q.GKEY).where("gap_s=121").collect()
    assert sorted((r.contig_no, r.dup_s, r.dup_e, r.distance, r.inverted) for r in dups) == [(k, 82, 120, 0, False) for k in range(3)]


def test_all_contigs_have_the_gaps_of_the_sql(spark, small, con):
    g = rows(catalog.QUERIES["c15_explode_gaps"](spark, small), *Q.GKEY)
    assert g == sql_rows(con, "c15_explode_gaps", *Q.GKEY) and any(r[1] > 0 for r in g)


def test_coverage_of_all_topologies(spark, small, con):
    keys = ["contig", "no1", "no2"]
    j = V.junctions(spark, small).cache()
    fusions = ("interchr", "intrachr-same-strand", "intrachr-opp-strand")
    reads = [(r.contig % 4 + 1, r.contig * 60 + r.rleft, r.contig * 60 + r.rright) for r in fixtures.view(spark, small, fixtures.READS).collect()]
    over = lambda x: any(c == x[f"chrom_{s}"] and a - 60 < x[f"coord_{s}"] < b + 60 for s in "ab" for c, a, b in reads)
    events = j.orderBy("topology", *keys).collect()
    chosen = []
    for t in {x.topology for x in events}:
        chosen += [x for x in events if x.topology == t and over(x)][:4]
    want = {}
    for x in chosen:
        for s in "ab":
            at = range(x[f"coord_{s}"] - 59, x[f"coord_{s}"] + 1) if x[f"dir_{s}"] == "up" else range(x[f"coord_{s}"], x[f"coord_{s}"] + 60)
            lo, hi = sorted((x.coord_a, x.coord_b))
            for p in at:
                n = {"DW": 0, "T1": 0, "T2": 0}
                for c, a, b in reads:
                    if c == x[f"chrom_{s}"] and a + 5 <= p <= b - 5:
                        if x.topology in fusions:
                            n["DW" if any(x[f"chrom_{y}"] == c and a < x[f"coord_{y}"] < b for y in "ab") else "T1"] += 1
                        else:
                            n["DW" if a < lo and b > hi else "T2" if lo < a and hi > b else "T1"] += 1
                want[(x.contig, x.no1, x.no2, s.upper(), p)] = tuple(n.values())
    assert {x.topology for x in chosen} & set(fusions) and any(sum(v) for v in want.values())
    ids = spark.createDataFrame([(x.contig, x.no1, x.no2) for x in chosen], "contig long, no1 int, no2 int")
    g = catalog.QUERIES["g21_base_coverage"](spark, small)
    got = {(r.contig, r.no1, r.no2, r.region, r.pos): (r.DW, r.T1, r.T2) for r in g.join(ids, keys, "left_semi").collect()}
    assert got == want
    for name in ("g21_base_coverage", "g22_relative_coverage"):
        q = catalog.QUERIES[name](spark, small)
        assert rows(q, *sorted(q.columns)) == sql_rows(con, name, *sorted(q.columns))
    assert catalog.QUERIES["g22_relative_coverage"](spark, small).count() == len(events)


def test_callers_meet_on_two_chromosomes_too(spark, small, con):
    e = [(f"{r.contig}:{r.no1}:{r.no2}", r) for r in V.junctions(spark, small).collect()]
    cells = {}
    for i, r in e:
        if r.contig % 2:
            cells.setdefault((r.chrom_a, r.chrom_b), []).append((i, r.coord_a + r.contig % 7, r.coord_b - r.contig % 5))
    want = []
    for i, r in e:
        if r.contig % 2 == 0:
            for k, a, b in cells.get((r.chrom_a, r.chrom_b), []):
                if (far := max(abs(r.coord_a - a), abs(r.coord_b - b))) <= 1000:
                    want.append((i, k, far))
    got = rows(catalog.QUERIES["j13_location_match"](spark, small), "id", "id2", "distance")
    assert got == sorted(want, key=repr)
    inter = {i for i, r in e if r.topology == "interchr"}
    assert any(g[0] in inter for g in got)
    assert got == sql_rows(con, "j13_location_match", "id", "id2", "distance")
    reports = rows(catalog.QUERIES["j15_reports"](spark, small), "id", "report")
    assert reports == sorted(((i, "common" if i in {g[0] for g in got} else "ours") for i, r in e if r.contig % 2 == 0), key=repr)
    assert reports == sql_rows(con, "j15_reports", "id", "report")


def test_clusters_hold_near_breakpoints_of_both_callers(spark):
    schema = "contig long, no1 int, no2 int, chrom_a long, coord_a long, dir_a string, chrom_b long, coord_b long, dir_b string"
    ours = spark.createDataFrame([(2, 3, 4, 1, 1000, "up", 2, 5000, "down"), (4, 1, 2, 1, 9000, "up", 2, 5000, "down")], schema)
    theirs = spark.createDataFrame([(3, 1, 2, 1, 1050, "up", 2, 4950, "down"), (5, 1, 2, 1, 9051, "up", 2, 5000, "down")], schema)
    got = {r.node: (r.group_key, r.primary) for r in Q.clusters(ours, theirs).collect()}
    assert got == {20304: (20304, True), 30102: (20304, True), 40102: (40102, True), 50102: (50102, True)}


def test_comparison_counts_come_of_matches(spark):
    from junctura.operators import compare as X

    calls = spark.createDataFrame([("a", 5, "g", "h"), ("b", 1, "h", "g"), ("c", 1, "g", "k"), ("d", 0, None, "k")], "id2 string, quality int, gene1 string, gene2 string")
    located = spark.createDataFrame([("x", "a"), ("y", "a"), ("x", "d")], "id string, id2 string")
    partners = spark.createDataFrame([("g", "h"), ("g", "k")], "gene1 string, gene2 string")
    got = {r.q: tuple(r)[1:] for r in X.comparison_counts(X.matched_calls(calls, located, partners)).collect()}
    assert got[0] == (4, 2, 2, 1, 2, 1, 2, 1) and got[1] == (3, 1, 2, 1, 2, 1, 2, 1) and got[5] == (1, 1, 1, 1, 1, 1, 1, 1)


def test_sequences_are_whole(spark, small):
    seqs = {r.seq_id: r.seq for r in fixtures.view(spark, small, fixtures.SEQS).collect() if r.seq}
    fasta = {r.id: "\n".join([(x := r.value.split("\n"))[0], "".join(x[1:])]) for r in catalog.QUERIES["k07_contigs_fasta"](spark, small).collect()}
    assert fasta == {str(k): f">{k}\n{s}" for k, s in seqs.items() if k % 3 == 0} and max(map(len, fasta.values())) > 400
    joined = {r.seq_id: r.expected for r in catalog.QUERIES["g31_chimera_sequence"](spark, small).where("seq_id < 40").collect()}
    assert joined == {k: s[: 50 + k % 100] + "N" + seqs[k + 1][9 + k % 30 :] for k, s in seqs.items() if k < 40 and k + 1 in seqs}


def test_known_duplications_are_found_in_all_of_every_transcript(spark, small):
    seqs = {r.seq_id: r.seq for r in fixtures.view(spark, small, fixtures.SEQS).collect() if r.seq}
    want = []
    for k, s in seqs.items():
        dup = s[k % 50 : k % 50 + 4 + k % 17]
        if len(s) >= 60 and len(set(dup)) > 1 and not any(dup * 2 in t for i, t in seqs.items() if i % 20 == k % 20):
            want.append((k, dup, k % 20))
    assert rows(catalog.QUERIES["e16_recheck_itd"](spark, small), "contig", "dup_seq", "gene") == sorted(want, key=repr) and want

"""Duplications in gaps: long and repetitive gaps, and the kinds of tandem."""

import random
import time

from junctura.operators import gaps as D

GAPS = "id long, seq string, gap_s long, gap_e long, gap_seq string, edge boolean, blocks array<struct<s:long,e:long>>"


def turn(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def bases(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def test_a_gap_of_20000_bases_and_one_of_a_single_letter(spark):
    rng = random.Random(31)
    gap = bases(rng, 20_000)
    worn = list(gap)
    for i in range(500, 20_000, 400):
        worn[i] = {"A": "C", "C": "G", "G": "T", "T": "A"}[worn[i]]
    left, right = bases(rng, 300) + "".join(worn) + bases(rng, 700), bases(rng, 500)
    one = "ACGT" + "A" * 900 + "CGTC"
    rows = [
        (1, left + gap + right, len(left) + 1, len(left) + len(gap), gap, False, []),
        (2, one, 305, 604, "A" * 300, False, []),
        (3, "", 1, 0, "", False, []),
        (4, None, 1, 4, None, None, None),
    ]
    start = time.time()
    got = {r.id: r for r in D.find_gap_duplication(spark.createDataFrame(rows, GAPS), ["id"]).collect()}
    assert time.time() - start < 60
    assert set(got) == {1, 2}
    mismatches = len(range(500, 20_000, 400))
    assert (got[1].score, got[1].inverted, got[1].dup_s, got[1].dup_e, got[1].distance) == (20_000 - 2 * mismatches, False, 301, 20_300, 700)
    assert (got[2].score, got[2].inverted, got[2].distance) == (300, False, 0)


def test_seeds_are_as_long_as_every_run_has_in_a_row(spark):
    for ratio in (0.5, 0.7, 0.9, 0.95, 1.0):
        d = spark.range(4, 121).withColumnRenamed("id", "t")
        got = {r.t: r.q for r in d.select("t", D._seed_size(d.t, ratio).alias("q")).collect()}
        for score, size in got.items():
            shortest = min(-(-(n - m) // (m + 1)) for m in range(60) for n in [max(score + 2 * m, m)] if True for n in range(n, n + 130) if n - 2 * m >= ratio * n)
            assert 1 <= size <= shortest, (ratio, score)


def test_kinds_of_tandem(spark):
    rng = random.Random(32)
    unit = bases(rng, 40)

    def row(i, left, copy, between, gap, right, inverted=False, blocks=()):
        ds, us = len(left) + 1, len(left) + len(copy) + len(between) + 1
        seq = left + copy + between + gap + right
        return (i, seq, us, us + len(gap) - 1, ds, ds + len(copy) - 1, us, us + len(gap) - 1, us - ds - len(copy), inverted, [{"s": s, "e": e} for s, e in blocks])

    far = bases(rng, 60)
    ten = "ACGGTACCTA"
    other = "GTTACATGGC"
    rows = [
        row(1, far, unit, "", unit, far),  # adjacent
        row(2, far, unit, "AC", unit, far),  # negligible: border moves by 2
        row(3, "", unit * 3, "ACGTA", unit * 3, ""),  # short, no room before the copy
        row(4, far + "GGCAT", unit * 3, "GGCAT", unit * 3, far),  # short and alike
        row(5, far + "AAAAA", unit * 3, "GCGCG", unit * 3, far),  # short, not alike
        row(6, far + ten, unit, ten, unit, far),  # further, alike
        row(7, far + other, unit, ten, unit, far),  # further, not alike
        row(8, "", unit, ten, unit, far),  # further, no room
        row(9, far, unit, far, unit, far),  # too far
        row(10, far + ten, unit, ten, unit, far, blocks=[(112, 118)]),  # a block between
        row(11, far, turn(unit), "ACGT", unit, far, True),  # inverted, negligible
        row(12, far, turn(unit), "ACGGTT" + turn("ACGGTT"), unit, far, True),  # inverted, alike
        row(13, far, turn(unit), "AAAAAA" + "AAAAAA", unit, far, True),  # inverted, not alike
        row(14, far, turn(unit), far + far, unit, far, True),  # inverted, too far
    ]
    schema = "id long, seq string, gap_s long, gap_e long, dup_s long, dup_e long, used_s long, used_e long, distance long, inverted boolean, blocks array<struct<s:long,e:long>>"
    got = {r.id: (r.how, r.tandem, r.used_s - r.border_s, r.border_e - r.used_e) for r in D.classify_tandem(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        1: ("TAN(Sh&Neg)", True, 0, 0),
        2: ("TAN(Sh&Neg)", True, 2, 0),
        3: ("TAN(Sh&Ir)", True, 0, 0),
        4: ("TAN(Sh&Mod)", True, 5, 0),
        5: ("TAN(Sh&NMod)", True, 0, 0),
        6: ("TAN(Mod)", True, 10, 0),
        7: ("TAN(NMod)", False, 0, 0),
        8: ("", False, 0, 0),
        9: ("", False, 0, 0),
        10: ("", False, 0, 0),
        11: ("TAN(Sh&Neg)", True, 2, 0),
        12: ("TAN(Mod)", True, 6, 0),
        13: ("TAN(NMod)", False, 0, 0),
        14: ("", False, 0, 0),
    }


def test_the_copy_after_the_gap_moves_the_end(spark):
    rng = random.Random(33)
    unit, far, ten = bases(rng, 40), bases(rng, 60), "ACGGTACCTA"
    seq = far + unit + ten + unit + ten + far
    row = (1, seq, 61, 100, 111, 150, 61, 100, 10, False, [])
    schema = "id long, seq string, gap_s long, gap_e long, dup_s long, dup_e long, used_s long, used_e long, distance long, inverted boolean, blocks array<struct<s:long,e:long>>"
    got = D.classify_tandem(spark.createDataFrame([row], schema)).first()
    assert (got.how, got.border_s, got.border_e) == ("TAN(Mod)", 61, 110)


def test_runs_are_found_in_their_row_as_by_brute_force(spark):
    rng = random.Random(34)
    rows = []
    for i in range(150):
        left, right, gap = bases(rng, rng.randrange(30)), bases(rng, rng.randrange(30)), "".join(rng.choice("ACGTN") for _ in range(rng.randint(1, 24)))
        left += gap[: rng.randrange(20)] if i % 2 else turn(gap)[: rng.randrange(20)]
        rows.append((i, left + gap + right, len(left) + 1, len(left) + len(gap), gap, False, []))
    rows.append((999, "É" * 9 + "ACÉGT" + "ACÉGT", 10, 14, "ACÉGT", False, []))

    def best(seq, gs, ge, gap):
        found, size = [], ge - gs + 1
        lo = max(1, gs - 2 * size)
        for inverted, g in ((False, gap), (True, turn(gap))):
            for side, (at, w) in enumerate(((lo, seq[lo - 1 : gs - 1]), (ge + 1, seq[ge : ge + 2 * size]))):
                for d in range(1 - len(g), len(w)):
                    now, since, top = 0, 0, (0, 0, 0)
                    for k in range(len(g)):
                        now += 1 if 0 <= k + d < len(w) and g[k] == w[k + d] else -1
                        if now <= 0:
                            now, since = 0, k + 1
                        if now > top[0]:
                            top = (now, since, k)
                    score, s, e = top
                    if score >= max(4, 0.3 * size) and score >= 0.9 * (e - s + 1):
                        ds, us = at + d + s, ge - e if inverted else gs + s
                        n = e - s + 1
                        away = ds - us - n if ds > us + n - 1 else us - ds - n
                        found.append((score, not inverted, -away, -ds))
        return max(found, default=None)

    x = D.find_gap_duplication(spark.createDataFrame(rows, GAPS), ["id"], min_ratio=0.9)
    text = x._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and text.count("Exchange") == 1
    got = {r.id: (r.score, not r.inverted, -r.distance, -r.dup_s) for r in x.collect()}
    want = {r[0]: best(*r[1:5]) for r in rows}
    assert got == {k: v for k, v in want.items() if v} and got[999][0] == 5

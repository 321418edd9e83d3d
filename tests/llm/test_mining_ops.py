"""Hard negatives, shards and collocations."""

from __future__ import annotations

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from junctura.llm import collocations, negatives, queries, sharding
from tests.compare import connect, differences

from .fixtures import docs


def brute_negatives(rows):
    kept = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    kept = sorted(set(kept))
    out = []
    for i, label, v in kept:
        if i % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, m) for j, m, w in kept if j != i)
        for s, j, _ in [x for x in scored if x[2] == label][:5]:
            window = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(i, j, r, k, -s, -t) for r, (t, k, _) in enumerate(window, 1)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1.0, "b") for r in rows], "vec_id long, embedding array<float>, label int, score double, block string").repartition(3)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def made(seed, n, centres=12, dims=6, spread=0.05):
    rng = np.random.default_rng(seed)
    mid = rng.normal(size=(centres, dims))
    mid /= np.linalg.norm(mid, axis=1)[:, None]
    return [(i, [float(x) for x in mid[i % centres] + rng.normal(size=dims) * spread], int(rng.integers(4))) for i in range(n)]


def test_negatives_equal_brute_force_with_many_blocks_and_odd_rows(spark):
    rows = made(1, 700)
    rows += [(1000, None, 1), (1050, [1.0] * 6, None), (None, [1.0] * 6, 1), (1100, [float("nan")] * 6, 1), (1150, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (1200, [float("inf")] * 6, 2)]
    rows += [(1250, [0.5, 0.5], 1), (1300, [], 2), (2000, [0.9] * 6, 3), (2000, [0.9] * 6, 3), (2050, [-0.9] * 6, 3), (2051, [-0.9] * 6, 3)]
    rows += [(3000 + i, rows[3][1], 1 + i % 2) for i in range(120)]  # copies: ties go by id
    got = found(negatives.mined(vectors(spark, rows), block=32, group=8, tile=4))
    assert got == brute_negatives(rows) and len(got) > 100


def test_negatives_of_one_id_that_differ_and_of_huge_values(spark):
    rows = [(50, [1.0, 0.0], 1), (50, [0.0, 1.0], 1), (3, [0.9, 0.1], 1), (4, [0.8, 0.2], 2), (5, [0.6, 0.5], 2)]
    assert found(negatives.mined(vectors(spark, rows))) == brute_negatives(rows)
    huge = [(50, [2.0**20, 1.0], 1), (1, [2.0**20, 0.5], 1), (2, [2.0**19, 0.5], 2), (3, [2.0**19 + 1, 3.0], 2), (4, [2.0**19 - 1, 3.0], 2)]
    assert found(negatives.mined(vectors(spark, huge))) == brute_negatives(huge)


def test_negatives_of_nothing(spark):
    assert found(negatives.mined(vectors(spark, [(1, [1.0], 1)]).limit(0))) == []
    assert found(negatives.mined(vectors(spark, [(1, [1.0], 1), (2, [0.5], 2)]))) == []


def test_hilbert_curve_steps_to_neighbours():
    cells = np.array(list(itertools.product(range(8), repeat=3)))
    place = negatives.hilbert(cells, 3)
    assert sorted(place) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(1) == 1).all()


def test_bounds_hold_and_prune_clusters():
    rows = np.floor(256 * np.array([r[1] for r in made(2, 2000, spread=0.02)]))
    cells = np.clip(np.floor((rows - rows.mean(0)) / rows.std(0) * 4) + 8, 0, 15)
    ordered = rows[np.argsort(negatives.hilbert(cells))].reshape(-1, 50, 6)
    low, high = negatives.bounds(rows[:40], ordered.min(1), ordered.max(1))
    scores = np.einsum("ad,brd->abr", rows[:40], ordered)
    assert (low[:, :, None] <= scores).all() and (scores <= high[:, :, None]).all()
    fifth = np.sort(scores.reshape(40, -1))[:, -6]
    assert (high >= fifth[:, None]).mean() < 0.35  # most blocks needn't be read


def brute_shards(rows, shards):
    return {s: [r for r in rows if r.shard == s] for s in range(shards)}


def test_shards_are_near_equal_and_places_are_gapless(spark):
    rng = random.Random(3)
    rows = [(i, "é" * rng.randrange(400)) for i in range(6000)] + [(None, "x"), (7, None), (8, ""), (9, "long " * 8000), (9, "long " * 8000)]
    d = docs(spark, rows)
    out = sharding.sharded(d, slots=512).collect()
    assert len(out) == len(rows) and {r.law for r in out} == {"bytes"} and {r.grown_shard for r in out} == {None}
    assert sorted((r.size, r.text_crc32) for r in out) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in rows)
    for field, n in (("shard", 24), ("next_shard", 25)):
        total = collections.Counter()
        for r in out:
            total[getattr(r, field)] += r.size
        assert set(total) == set(range(n)) and max(total.values()) - min(total.values()) <= 0.02 * sum(total.values()) / n
    for s, part in brute_shards(out, 24).items():
        assert sorted(r.slot for r in part) == list(range(len(part))), s
    moved = [r for r in out if r.shard != r.next_shard]
    assert sum(r.size for r in moved) < 2.5 * sum(r.size for r in out) / 25


def test_shards_of_one_id_with_a_third_of_all_rows(spark):
    rows = [(1, "same text of all")] * 3000 + [(i, "t" * (i % 50)) for i in range(2, 6000)]
    out = sharding.sharded(docs(spark, rows), slots=256).collect()
    sizes = collections.Counter()
    for r in out:
        sizes[r.shard] += r.size
    assert max(sizes.values()) < 1.1 * min(sizes.values())
    for part in brute_shards(out, 24).values():
        assert sorted(r.slot for r in part) == list(range(len(part)))


def test_slot_maps_are_edited_for_fewer_shards_and_new_sizes(spark):
    rows = sharding.slotted(sharding.sized(docs(spark, [(i, "x" * (i % 97)) for i in range(3000)])), 256)
    one = sharding.first_map(sharding.slot_sizes(rows, 6, 256), 6).cache()
    fewer = sharding.next_map(one, 5).cache()
    a, b = ({(r.virtual_slot, r.part): r for r in m.collect()} for m in (one, fewer))
    assert a.keys() == b.keys() and {r.version for r in b.values()} == {2} and {r.shard for r in b.values()} == set(range(5))
    assert all(b[k].shard == r.shard for k, r in a.items() if r.shard < 5)  # shards grow by what the last one had
    more = sharding.slotted(sharding.sized(docs(spark, [(i, "x" * (i % 97 + (i % 3) * 40)) for i in range(4000)])), 256)
    grown = sharding.next_map(fewer, 5, sharding.slot_sizes(more, 5, 256))
    total = collections.Counter()
    for r in grown.collect():
        total[r.shard] += r.size
        assert r.version == 3
    assert max(total.values()) < 1.05 * min(total.values())


def test_shards_of_nothing(spark):
    assert sharding.sharded(docs(spark).limit(0)).count() == 0


def brute_collocations(rows, least, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            ws = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(ws)
            for m in range(1, 5):
                for i in range(len(ws) - m + 1):
                    f[lang or "und", tuple(ws[i : i + m])] += 1
    f = {k: v for k, v in f.items() if v >= least}
    longer = {}
    for (lang, p), v in f.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                longer[lang, p[i : i + m]] = max(v, longer.get((lang, p[i : i + m]), 0))
    kept = collections.defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) > 1 and not 100 * longer.get((lang, p), 0) >= 80 * a:
            score, _, left, right = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            kept[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, r, p.decode(), -a, left, right, n[lang], -s) for lang, v in kept.items() for r, (s, a, p, left, right) in enumerate(sorted(v)[:top], 1))


def texts(spark, rows):
    return spark.createDataFrame([(i, lang, t, "x", 1) for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string, chunk string, tile int").repartition(3)


@pytest.mark.parametrize("span", [7, 400, collocations.SPAN])
def test_collocations_equal_brute_force(spark, span, monkeypatch):
    rng = random.Random(span)
    vocabulary = ["New", "york", "CITY", "of", "the", "é\x1cx", "a\x00b", "ǅ", "漢字"]
    make = lambda: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", "\x85 "]) for _ in range(rng.randrange(60)))
    rows = [(rng.choice(["en", "de", None, "und"]), make()) for _ in range(150)] + [("en", None), ("en", ""), ("en", " .. \t"), ("en", "one two three four five " * 300)]
    monkeypatch.setattr(collocations, "FAN", 4)
    d = texts(spark, rows)
    got = sorted(tuple(r) for r in collocations.collocations(d, least=5, span=span).collect())
    assert got == brute_collocations(rows, 5) and len(got) > 20


def test_collocations_beyond_the_tiles_head(spark, monkeypatch):
    rng = random.Random(5)
    rows = [("en", " ".join(f"w{min(int(rng.expovariate(0.05)), 200)}" for _ in range(120))) for _ in range(120)]
    monkeypatch.setattr(collocations, "EDGE", 2)
    monkeypatch.setattr(collocations, "HEAD", 4)  # 16 ids in tiles of 4 x 4, the rest by hash
    width, spread = 500, 8
    seq = np.random.default_rng(1).integers(0, 40, 4000)
    want = collections.Counter((int(x), int(y)) for x, y in zip(seq[:3000], seq[1:], strict=False) if x and y)
    got = {}
    for tile, codes, counts in collocations.tiled(seq, 3000, width, spread):
        for c, n in zip(codes, counts, strict=True):
            pair = ((tile >> 2) << 2 | c >> 2, (tile & 3) << 2 | c & 3) if tile >= 0 else (c // width, c % width)
            if n:
                got[int(pair[0]), int(pair[1])] = int(n)
    assert got == want


def test_collocations_of_more_words_than_tiles_cover(spark):
    rng = random.Random(5)
    order = [f"w{i}" for i in range(34000)]
    rows = [("en", " ".join(order[k : k + 500])) for _ in range(2) for k in range(0, 34000, 500)] + [("en", " ".join(rng.choices(order[:40], k=200)) + ".") for _ in range(20)]
    out = sorted(tuple(r) for r in collocations.collocations(texts(spark, rows), least=2).collect())
    assert out == brute_collocations(rows, 2)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(texts(spark, [("en", "a b")]).limit(0)).count() == 0
    assert collocations.collocations(texts(spark, [("en", None), (None, "")])).count() == 0


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_collocations"])
def test_mining_queries_equal_sql(spark, small, name):
    assert differences(queries.QUERIES[name](spark, small), connect(small), queries.ORACLE[name]) in ("", "no rows")

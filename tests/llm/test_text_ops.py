"""Operators on texts against brute force, over odd rows and a small table."""

from __future__ import annotations

import base64
import collections
import functools
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash

from junctura.llm import bytebpe, ctph, lm, packing, simhash
from junctura.plans.session import table

from .fixtures import LONG, ROWS, docs

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def key(x):
    return (x is None, x or 0)


def plain_scores(rows, order, mu, spread):
    """(id, held out, tokens, known, N, base, score) by counting and the formula alone."""
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    tokens = [(t or "").encode().lower().split() + [None] for _, t in rows]
    c = collections.Counter()
    for h, t in zip(held, tokens, strict=True):
        if not h:
            c.update((w,) for w in t)
            for k in range(2, order + 1):
                c.update(tuple([None, *t][i : i + k]) for i in range(len(t) + 2 - k))
    n, v = sum(x for g, x in c.items() if len(g) == 1), sum(len(g) == 1 for g in c)

    def p(gram):
        if len(gram) == 1:
            return (c[gram] + 1) / (n + v + 1)
        before = c[gram[:-1]]
        k = min(len(gram) - 2, len(mu) - 1)
        m = mu[k] + spread[min(len(gram) - 2, len(spread) - 1)] * before
        return (c[gram] + m * p(gram[1:])) / (before + m) if before else p(gram[1:])

    out = []
    for (i, _), h, t in zip(rows, held, tokens, strict=True):
        padded = [None, *t]
        each = [p(tuple(padded[max(0, k + 2 - order) : k + 2])) if order > 1 else p((w,)) for k, w in enumerate(t)]
        score = sum(math.log10(x) if x else -math.inf for x in each)
        out.append((i, h, len(t), sum(c[w,] > 0 for w in t), n, sum(math.log10((c[w,] + 1) / (n + v + 1)) for w in t), score))
    return out


def equal_scores(got, want):
    rank = lambda r: (key(r[0]), r[2], round(r[5], 6))
    got, want = sorted(map(tuple, got), key=rank), sorted(want, key=rank)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], abs=1e-6)


@pytest.mark.parametrize(("order", "mu", "spread"), [(1, (1.0,), (0.0,)), (2, (3.0,), (1.0,)), (3, (10.0, 0.5), (3.0, 0.8)), (4, (2.0, 0.0, 1.0), (0.0, 0.5)), (3, (0.0,), (0.0,))])
def test_lm_is_the_counted_model(spark, order, mu, spread):
    out = lm.score(docs(spark), order, mu, spread, block_bytes=40_000).collect()
    equal_scores(out, plain_scores(ROWS, order, mu, spread))
    assert any(r.held_out for r in out) and not all(r.held_out for r in out)


def test_lm_blocks_meet_through_routers_and_long_texts_in_lanes(spark, monkeypatch):
    rng = random.Random(10)
    rows = [(i, " ".join(f"w{int(rng.expovariate(0.2))}" for _ in range(rng.randrange(60)))) for i in range(150)]
    rows += [(1000, " ".join(f"W{int(rng.expovariate(0.1))}" for _ in range(3000)))] + rows[:5]
    monkeypatch.setattr(lm, "LANE", 100)
    for fan in (3, 1024):
        out = lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), block_bytes=1500, fan=fan).collect()
        equal_scores(out, plain_scores(rows, 3, lm.MU, lm.SPREAD))


def test_lm_query_equals_brute_force(spark, small):
    from junctura.llm import queries

    rows = [(r.doc_id, r.text) for r in table(spark, small, "documents").collect()]
    equal_scores(queries.op1_lm_scoring(spark, small).collect(), plain_scores(rows, 3, lm.MU, lm.SPREAD))


def test_lm_sums_to_one():
    texts = ["a b a b c", "a c b", "b"]
    for order in (1, 2, 3):
        for history in (["a"], ["a", "b"], ["b", "a", "b"]):
            total = 0.0
            for w in ("a", "b", "c", None, "unseen"):
                block = lm.Block(*lm.tokenised([*texts, " ".join([*history, w] if w else history)]), order)
                counts = block.own(np.array([True] * 3 + [False]))
                auto = lm.Automaton(block, counts, int(counts[0].sum()), int((counts[0] > 0).sum()), lm.MU, lm.SPREAD)
                total += 10 ** auto.traverse()[block.starts[3] + len(history)]
            assert total == pytest.approx(1.0)


def test_lm_states_and_failure_arcs():
    block = lm.Block(*lm.tokenised(["a b c", "a b d", "x b e"]), 3)
    counts = block.own(np.array([True, True, False]))
    auto = lm.Automaton(block, counts, int(counts[0].sum()), int((counts[0] > 0).sum()), (2.0,))
    at = int(block.starts[0]) + 1  # "a b" ends here
    state, b = int(auto.numbers[1, at]), int(auto.numbers[0, at])
    assert auto.seen[state] and auto.shorter[state] == b and auto.shorter[b] == 0
    assert auto.failure[state] == pytest.approx(math.log10(2 / (2 + 2)))
    odd = int(block.starts[2]) + 1  # "x b" was never seen: no state, and the text is in the state "b"
    assert not auto.seen[auto.numbers[1, odd]]


def test_lm_empty(spark):
    assert lm.score(docs(spark, [])).count() == 0


@functools.lru_cache(1)
def word_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    return t


def tokens(text):
    return np.array([*word_library().encode(text or "", add_special_tokens=False).ids, 1], np.uint32)


def test_word_encoder_equals_library():
    rng = random.Random(1)
    letters = "aAbB .,'\t\n\x1c\x85\xa0 　1é漢JǰİſßΣ̌̇😀#*"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(1500)] + ["a" * 5000]
    got = packing.WordEncoder(WORDS)(texts)
    assert all(np.array_equal(np.frombuffer(g, np.uint32), tokens(t)[:-1]) for t, g in zip(texts, got, strict=True))


def test_word_encoder_survives_a_full_store(monkeypatch):
    monkeypatch.setattr(packing, "CACHED", 5)
    texts = ["one two three", "four five six seven eight nine", "one " + "z" * 100, "two one"]
    got = packing.WordEncoder(WORDS)(texts)
    assert all(np.array_equal(np.frombuffer(g, np.uint32), tokens(t)[:-1]) for t, g in zip(texts, got, strict=True))


def test_packing_places_every_piece(spark):
    out = packing.packed(docs(spark), WORDS, shard_pieces=9).collect()
    want = collections.Counter()
    for i, t in ROWS:
        ids = tokens(t)
        want.update((i, k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096)))
    assert want == collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out)
    by = collections.defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_sum_of_squares_takes_the_least_square_sum():
    rng = random.Random(2)
    lengths = np.array([rng.randrange(1, 33) for _ in range(400)])
    bins, offsets = packing.sum_of_squares(lengths, 32)
    gaps, n = {}, 0
    square = lambda g: sum(v * v for v in collections.Counter(x for x in g if x).values())
    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        options = [square([*(x - s if b == k else x for b, x in gaps.items())]) for k, g in gaps.items() if g >= s]
        fresh = square([*gaps.values(), 32 - s])
        before = dict(gaps)
        assert offsets[i] == (32 - before[bins[i]] if bins[i] in before else 0)
        gaps[bins[i]] = before.get(bins[i], 32) - s
        assert gaps[bins[i]] >= 0
        assert square(gaps.values()) == min([*options, fresh])
        n = max(n, bins[i] + 1)
    assert n <= 1.1 * lengths.sum() / 32 + 1


def test_closing_pass_takes_fewer_sequences():
    rng, fewer = random.Random(8), 0
    for _ in range(40):
        lengths = np.array([rng.choice([rng.randrange(1, 64), rng.randrange(1, 16)]) for _ in range(rng.randrange(1, 120))])
        before = packing.sum_of_squares(lengths, 64)
        bins, offsets = packing.closed(lengths, *before, 64, 16)
        n = len(set(bins.tolist()))
        assert math.ceil(lengths.sum() / 64) <= n <= before[0].max() + 1
        fewer += n < before[0].max() + 1
        for b in set(bins.tolist()):
            at = 0
            for o, size in sorted(zip(offsets[bins == b].tolist(), lengths[bins == b].tolist(), strict=True)):
                assert o == at
                at += size
            assert at <= 64
    assert fewer
    none = np.zeros(0, np.int64)
    assert len(packing.closed(none, none, none, 64, 16)[0]) == 0


def test_packing_takes_nearly_the_least_sequences(spark):
    from junctura.llm import queries

    out = queries.op2_packing(spark, "/root/testdata/sf0.01").select("length", "sequence_id", "ids_crc32", "doc_id", "piece").collect()
    assert len({r.sequence_id for r in out}) <= math.ceil(sum(r.length for r in out) / 4096)
    d = {r.doc_id: r.text for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    for r in out[::25]:
        assert r.ids_crc32 == zlib.crc32(tokens(d[r.doc_id])[4096 * r.piece : 4096 * (r.piece + 1)].tobytes())


def test_equal_rows_spread_over_shards(spark):
    same = spark.range(900).selectExpr("7 AS doc_id", "0 AS piece", "cast(10 as long) AS length")
    out = packing.pack(same, 64, shard_pieces=100).collect()
    assert len({r.sequence_id >> 32 for r in out}) == 9 and len(out) == 900


def test_sequences_hold_the_ids(spark):
    placed = packing.pack(packing.pieces(docs(spark), WORDS))
    total = sum(len(r.ids) for r in packing.sequences(placed).collect())
    assert total == 4 * sum(len(tokens(t)) for _, t in ROWS)


def test_packing_empty(spark):
    assert packing.packed(docs(spark, []), WORDS).count() == 0


@functools.lru_cache(1)
def library():
    import tiktoken

    with open(BYTES, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize(("size", "overlap", "span"), [(1 << 16, 1 << 10, 1 << 20), (50, 20, 200), (1024, 96, 5000), (997, 31, 1 << 16), (2000, 5, 1000)])
def test_byte_bpe_equals_library(spark, size, overlap, span):
    enc = library()
    out = collections.Counter((r.doc_id, tuple(r.ids)) for r in bytebpe.encode(docs(spark), BYTES, public_tokenizers.PATTERN, size, overlap, span).collect())
    assert out == collections.Counter((i, tuple(enc.encode_ordinary(t or ""))) for i, t in ROWS)


def test_byte_bpe_round_trip(spark):
    ids = bytebpe.encode(docs(spark), BYTES, public_tokenizers.PATTERN)
    back = bytebpe.decode(ids, BYTES, public_tokenizers.PATTERN)
    assert collections.Counter((r.doc_id, bytes(r.bytes)) for r in back.collect()) == collections.Counter((i, (t or "").encode()) for i, t in ROWS)
    digests = bytebpe.round_trip(docs(spark), BYTES, public_tokenizers.PATTERN).collect()
    assert collections.Counter((r.doc_id, r.decoded_sha256) for r in digests) == collections.Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ROWS)


def test_chunks_stitch_where_boundaries_meet():
    c = bytebpe.Codec(BYTES, public_tokenizers.PATTERN)
    rng = random.Random(3)
    for _ in range(1500):
        text = "".join(rng.choice(["a", "bc", " ", "  ", "\n", "1", "'ll", "'", "!", "é", "aaaaaaaaaaaa", "          ", "\t"]) for _ in range(rng.randrange(120)))
        assert bytebpe.split(text, c.pattern.findall, rng.randrange(5, 40), rng.randrange(1, 20)) == c.pattern.findall(text)


def test_most_texts_are_stitched_and_equal_the_library(spark, monkeypatch):
    """Counts rows that go through two chunks or more: the query's sizes, on the table's texts."""
    enc, c = library(), bytebpe.codec(BYTES, public_tokenizers.PATTERN)
    texts = [r.text or "" for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]
    stitched, real = [], bytebpe.stitch
    monkeypatch.setattr(bytebpe, "stitch", lambda text, ends, *rest: stitched.append(len(ends)) or real(text, ends, *rest))
    for t in texts:
        assert c.ids(bytebpe.split(t, c.pattern.findall)) == enc.encode_ordinary(t)
    assert len(stitched) > len(texts) / 2 and min(stitched) >= 2


def test_byte_bpe_query_equals_library(spark, small):
    from junctura.llm import queries

    enc, texts = library(), {r.doc_id: r.text or "" for r in table(spark, small, "documents").collect()}
    for r in queries.op7_byte_bpe(spark, small).collect():
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_byte_bpe_empty(spark):
    assert bytebpe.round_trip(docs(spark, []), BYTES, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("range_bytes", [1 << 24, 2000])
def test_ctph_follows_ids_down(spark, range_bytes):
    out = ctph.compared(docs(spark), range_bytes=range_bytes).collect()
    rows = sorted(((i, t or "") for i, t in ROWS if i is not None), reverse=True) + [(None, t) for i, t in ROWS if i is None]
    want = collections.Counter((i, hashlib.sha256(ctph.edited(t, rows[(k + 1) % len(rows)][1]).encode()).hexdigest(), len(t)) for k, (i, t) in enumerate(rows))
    assert collections.Counter((r.doc_id, r.edited_sha256, r.n_chars) for r in out) == want
    assert all(r.fingerprint == ctph.fingerprint(dict(rows)[r.doc_id]) for r in out if r.doc_id != 6)


@pytest.mark.parametrize("kind", ["string", "large"])
def test_ctph_takes_ids_of_any_order(spark, kind):
    ids = ["b", "a", None, "é", "a"] if kind == "string" else [1 << 60, (1 << 60) + 1, None, 5, (1 << 60) + 1]
    texts = ["first text of some words " * 40, "second text " * 90, "third " * 70, "fourth one " * 50, "second text " * 90]
    d = spark.createDataFrame(list(zip(ids, texts, strict=True)), f"doc_id {'string' if kind == 'string' else 'long'}, text string").repartition(3)
    rows = sorted(((i, t) for i, t in zip(ids, texts, strict=True) if i is not None), key=lambda r: r[0].encode() if kind == "string" else r[0], reverse=True) + [(None, texts[2])]
    want = collections.Counter((i, hashlib.sha256(ctph.edited(t, rows[(k + 1) % 5][1]).encode()).hexdigest()) for k, (i, t) in enumerate(rows))
    for size in (1 << 24, 700):
        assert collections.Counter((r.doc_id, r.edited_sha256) for r in ctph.compared(d, range_bytes=size).collect()) == want


def test_ctph_repeated_rows_spread(spark):
    same = spark.range(400).selectExpr("3 AS doc_id", "repeat('all the same text ', 20) AS text")
    out = ctph.compared(same, range_bytes=10_000).collect()
    assert len(out) == 400 and {(r.near_next, r.edited_sha256) for r in out} == {(1.0, out[0].edited_sha256)}


def plain_signature(text):
    """Chunks by a loop: the rolling hash afresh for every byte, every block size tried in turn."""
    data, marks = (text or "").encode(), []
    for i in range(len(data)):
        w = [data[i - k] if i >= k else 0 for k in range(7)]
        mixed = 0
        for k in range(7):
            mixed ^= w[k] << 5 * k & 0xFFFFFFFF
        marks.append((sum(w) + sum((7 - k) * w[k] for k in range(7)) + mixed + 1) & 0xFFFFFFFF)
    block = 3
    while sum(m % block == 0 for m in marks) >= 64:
        block *= 2

    def letters(n):
        out, start = "", 0
        for i, m in enumerate(marks):
            if m % n == 0:
                out += ctph.LETTERS[xxhash.xxh32_intdigest(data[start : i + 1]) % 64]
                start = i + 1
        return out + (ctph.LETTERS[xxhash.xxh32_intdigest(data[start:]) % 64] if start < len(data) or not data else "")

    return block, letters(block), letters(2 * block)


def plain_likeness(one, other):
    if one == other:
        return 1.0

    def alike(a, b):
        if a == b:
            return 1.0
        run = min(5, len(a), len(b))
        if not any(a[i : i + run] == b[j : j + run] for i in range(len(a) - run + 1) for j in range(len(b) - run + 1)):
            return 0.0
        row = [*range(len(b) + 1)]
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (0 if x == y else 2))
        return 1 - row[-1] / (len(a) + len(b))

    (n, a1, a2), (m, b1, b2) = one, other
    if n == m:
        return max(alike(a1, b1), alike(a2, b2) if min(len(a2), len(b2)) > 5 else 0.0)
    return alike(a1, b2) if n == 2 * m else alike(a2, b1) if m == 2 * n else 0.0


def test_ctph_query_equals_brute_force(spark, small):
    from junctura.llm import queries

    rows = sorted(((r.doc_id, r.text or "") for r in table(spark, small, "documents").collect()), reverse=True)
    out = {r.doc_id: r for r in queries.op5_ctph(spark, small).collect()}
    assert len(out) == len(rows)
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n = len(t) // 3
        changed = t[: len(t) - n] + after[:n]
        assert (out[i].n_chars, out[i].edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        if len(t) > 4000 or len(after) > 4000:  # the loop is slow
            continue
        own, new, then = plain_signature(t), plain_signature(changed), plain_signature(after)
        assert out[i].fingerprint == ":".join(map(str, own)) and out[i].edited_fingerprint == ":".join(map(str, new))
        assert out[i].near_edited == pytest.approx(plain_likeness(own, new)) and out[i].near_next == pytest.approx(plain_likeness(own, then))


def test_ctph_rolls_like_a_loop():
    data = bytes(random.Random(4).randrange(256) for _ in range(3000))
    hits = []
    for i in range(len(data)):
        w = [data[i - k] if i >= k else 0 for k in range(7)]
        mixed = 0
        for k in range(7):
            mixed ^= w[k] << 5 * k & 0xFFFFFFFF
        h = (sum(w) + sum((7 - k) * w[k] for k in range(7)) + mixed) & 0xFFFFFFFF
        if (h + 1) % 3 == 0:
            hits.append(i)
    step, ctph.STEP = ctph.STEP, 500
    try:
        places, levels = ctph._triggers(data)
    finally:
        ctph.STEP = step
    assert places.tolist() == hits and len(levels) == len(hits)


def test_ctph_likeness(spark, small):
    texts = [r.text for r in table(spark, small, "documents").select("text").collect() if r.text and len(r.text) > 300]
    near = [ctph.likeness(ctph.fingerprint(a), ctph.fingerprint(ctph.edited(a, b))) for a, b in zip(texts, texts[1:], strict=False)]
    assert np.median(near) > 0.6 and np.mean([x > 0.3 for x in near]) > 0.95
    assert ctph.likeness(ctph.fingerprint(""), ctph.fingerprint(None)) == 1.0
    assert ctph.fingerprint("x" * 100_000).count(":") == 2


def test_ctph_edit_distance_is_the_textbook_one():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0, *row[1:]]
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rng = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(1, 40))) for _ in range(2))
        table_ = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table_[i + 1][j + 1] = table_[i][j] + 1 if x == y else max(table_[i][j + 1], table_[i + 1][j])
        assert ctph._common(a, b) == table_[-1][-1]


def test_ctph_empty_and_single(spark):
    assert ctph.compared(docs(spark, [])).count() == 0
    assert ctph.compared(docs(spark, [(1, "only one here")])).first().near_next == 1.0


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_fingerprints(spark):
    out = simhash.fingerprints(docs(spark)).collect()
    assert collections.Counter((r.doc_id, r.fp & (1 << 64) - 1) for r in out) == collections.Counter((i, plain_fingerprint(t)) for i, t in ROWS)


def components(values):
    values, parent = sorted(set(values)), {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for i, a in enumerate(values):
        find(a)
        for b in values[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3:
                parent[find(a)] = find(b)
    return {frozenset(v for v in values if find(v) == r) for r in {find(v) for v in values}}


@pytest.mark.parametrize("dense", [512, 3])
def test_simhash_links_equal_brute_force(spark, dense):
    rng = random.Random(6)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    values = {rng.getrandbits(64) for _ in range(60)}
    for base in list(values)[:8]:  # dense groups around a middle, and chains
        for _ in range(25):
            x = base
            for _ in range(rng.choice([1, 2, 3, 3, 4, 5])):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    fps = [signed(v) for v in values]
    edges = simhash.link_edges(spark.createDataFrame([(v,) for v in fps], "fp long"), dense=dense)
    comp = {r.node: r.component for r in simhash.connected_components(edges).collect()}
    got = collections.defaultdict(set)
    for v in fps:
        got[comp.get(v, v)].add(v)
    assert {frozenset(x) for x in got.values()} == components(fps)


def test_simhash_few_beside_many_go_by_hubs(spark):
    """A key of few members one bit from a key of many is crowded too: nobody meets all of the many in pairs."""
    rng, base = random.Random(9), 0x1234_5678_0000_0000
    many = {base | rng.getrandbits(32) for _ in range(300)}
    few = {(base ^ 1 << 35) | (x & 0xFFFFFFFF) ^ (1 << k) for k, x in zip(range(3), many, strict=False)}
    fps = sorted(many | few)
    frame = spark.createDataFrame([(v,) for v in fps], "fp long")
    edges = simhash.link_edges(frame, dense=50).distinct()
    comp = {r.node: r.component for r in simhash.connected_components(edges).collect()}
    got = collections.defaultdict(set)
    for v in fps:
        got[comp.get(v, v)].add(v)
    assert {frozenset(x) for x in got.values()} == components(fps)
    assert edges.count() < 2000


def test_simhash_query_equals_brute_force(spark, small):
    from junctura.llm import queries

    out = {r.doc_id: r for r in queries.op9_simhash(spark, small).collect()}
    texts = {r.doc_id: r.text for r in table(spark, small, "documents").collect()}
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    groups = components(fps.values())
    assert {i: r.fingerprint for i, r in out.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    for g in groups:
        ids = [i for i, f in fps.items() if f in g]
        assert {out[i].component_id for i in ids} == {min(ids)}


def test_simhash_component_ids(spark):
    out = simhash.near_duplicates(docs(spark)).collect()
    groups = components([r.fp for r in out])
    for r in out:
        of = next(g for g in groups if r.fp in g)
        ids = [x.doc_id for x in out if x.fp in of and x.doc_id is not None]
        assert r.component_id == (min(ids) if ids else None)
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_simhash_keeps_one_of_each_group(spark):
    d = docs(spark)
    kept = simhash.keep_one(d)
    assert kept.columns == d.columns
    near = simhash.near_duplicates(d).collect()
    groups = components([r.fp for r in near])
    assert kept.count() == len(groups)
    assert {r.doc_id for r in kept.collect()} == {min((x.doc_id for x in near if x.fp in g), key=key) for g in groups}
    again = simhash.keep_one(docs(spark, [(None, "same text here now"), (None, "same text here now"), (3, LONG), (3, LONG)]))
    assert sorted((r.doc_id for r in again.collect()), key=key) == [3, None]

"""Phrase collocations by direct-address tiles of pairs.

A text (null: empty) is lower-cased in A-Z, split at ``[.,;:!?\\x0A-\\x0D]`` into pieces
and those at blanks and tabs into words; nothing crosses a piece. Words of at least
``least`` occurrences get ids by falling frequency (a language's word has its own id),
and texts become chunks of ids. A pair of ids falls into a tile of 512 x 512; a chunk
counts a full tile by a dense bincount and a sparse one as sorted coordinates, as it
does with pairs outside the first 32,768 ids, whose tiles go by a hash. Tiles of
``FAN`` chunks at a time are added, dense ones in place, until one is left of each.
Frequent pairs are ranked to ids again, and two pairs that overlap by a word are the next
level's pair: triples, then quadruples from overlapping triples. As a phrase is as frequent
as its rarest part at most, leaving out ids below ``least`` loses nothing.

What meets in a task is one chunk with the ids that it asked for, or a tile of ``FAN``
chunks; the most frequent pair is one entry a chunk. Chunks close at ``SPAN`` words,
and a longer text is cut into several, each seeing three words on.

A null language is ``und``. Ids, repeated rows and other columns don't matter (repeated
texts count each time); an empty table gives no rows. Counts are exact.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import stored
from .numbering import keyed, numbered

SPAN, AHEAD, FAN = 1 << 21, 3, 128
FEW_WORDS = 1 << 20  # a vocabulary up to this is broadcast, a larger one is joined by shuffle
EDGE, HEAD = 9, 15  # bits of a tile's side and of the ids that tiles cover
STATE = pa.schema([("chunk", pa.int64()), ("own", pa.int64()), ("a", pa.binary()), ("tile", pa.int64()), ("codes", pa.binary()), ("counts", pa.binary())])
STATE_DDL = "chunk long, own long, a binary, tile long, codes binary, counts binary"


def _table() -> bytes:
    t = bytearray(bytes(range(256)).lower())
    for c in b".,;:!?\n\x0b\x0c\r":
        t[c] = 10
    t[9] = 32
    return bytes(t)


TABLE = _table()


def words(text: bytes) -> list[bytes]:
    """Words of all pieces, with ``.`` (which no word holds) between pieces and after the last."""
    return (text.translate(TABLE) + b"\n").replace(b"\n", b" . ").split()


def pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0 as planes of bytes, as many as the largest needs; long ones as a Zstandard frame."""
    planes = -(-int(values.max(initial=0)).bit_length() // 8)
    raw = np.ascontiguousarray(values, np.int64).view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()
    if len(raw) < 512:
        return bytes([planes]) + len(values).to_bytes(4, "little") + raw
    return bytes([planes | 16]) + len(values).to_bytes(4, "little") + zstandard.compress(raw, 1)


def unpack(data: bytes) -> np.ndarray:
    planes, n = data[0] & 15, int.from_bytes(data[1:5], "little")
    raw = zstandard.decompress(data[5:]) if data[0] & 16 else data[5:]
    out = np.zeros((n, 8), np.uint8)
    out[:, :planes] = np.frombuffer(raw, np.uint8).reshape(planes, n).T
    return out.view(np.int64).ravel()


def chunks(docs: DataFrame, span: int) -> DataFrame:
    """Two kinds of rows: a chunk's local word ids (own, a), and what they stand for (lang, word, local, n)."""
    kinds = pa.schema([("chunk", pa.int64()), ("own", pa.int64()), ("a", pa.binary()), ("lang", pa.string()), ("word", pa.binary()), ("local", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = itertools.count(TaskContext.get().partitionId() << 32)

        def closed(known: dict, seq: list[np.ndarray], own: int) -> Iterator[pa.RecordBatch]:
            a, chunk = np.concatenate(seq), next(numbers)
            yield pa.RecordBatch.from_pylist([{"chunk": chunk, "own": own, "a": pack(a)}], kinds)
            n = np.bincount(a[:own], minlength=max((max(d.values()) for d in known.values()), default=0) + 1)
            for lang, d in known.items():
                del d[b"."]
                local = np.fromiter(d.values(), np.int64, len(d))
                cols = [pa.array(np.full(len(d), chunk)), pa.nulls(len(d), pa.int64()), pa.nulls(len(d), pa.binary()), pa.array([lang] * len(d), pa.string()), pa.array(list(d), pa.binary()), pa.array(local), pa.array(n[local])]
                yield from pa.Table.from_arrays(cols, schema=kinds).to_batches(1 << 15)

        def fresh() -> dict:
            numbered_from = itertools.count(1).__next__

            def start() -> defaultdict:
                d = defaultdict(numbered_from)
                d[b"."] = 0
                return d

            return defaultdict(start)

        known, seq, size = fresh(), [], 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = words(text.as_py() or b"")
                for at in range(0, len(tokens), span):
                    part = tokens[at : at + span + AHEAD]
                    seq.append(np.fromiter(map(known[lang].__getitem__, part), np.int64, len(part)))
                    size += min(span, len(tokens) - at)
                    if size >= span or at + span < len(tokens):
                        yield from closed(known, seq, size)
                        known, seq, size = fresh(), [], 0
        if seq:
            yield from closed(known, seq, size)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "chunk long, own long, a binary, lang string, word binary, local long, n long")


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted coordinates with their sums."""
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[first], np.add.reduceat(counts[order], first)


def tiled(seq: np.ndarray, own: int, width: int, spread: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """tile, sorted codes and counts of neighbours in ``seq`` (0: a break); those from ``own`` on are named but count 0."""
    at = np.flatnonzero((seq[:-1] != 0) & (seq[1:] != 0))
    counted, a, b = at < own, seq[at], seq[at + 1]
    inside = (a >> HEAD | b >> HEAD) == 0
    mask, side = (1 << EDGE) - 1, HEAD - EDGE
    tile = np.where(inside, (a >> EDGE) << side | b >> EDGE, 0)
    code = np.where(inside, (a & mask) << EDGE | b & mask, a * width + b)
    far = ~inside
    tile[far] = -1 - ((code[far].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % spread
    order = np.argsort(tile, kind="stable")
    del a, b, at, inside, far
    tile, code, counted = tile[order], code[order], counted[order]
    ends = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1], True]) if len(tile) else np.zeros(1, np.int64)
    for lo, hi in itertools.pairwise(ends):
        if tile[lo] >= 0 and hi - lo >= 1 << 2 * EDGE - 3:
            there = np.bincount(code[lo:hi], minlength=1 << 2 * EDGE)
            codes = np.flatnonzero(there)
            yield int(tile[lo]), codes, np.bincount(code[lo:hi][counted[lo:hi]], minlength=1 << 2 * EDGE)[codes]
        else:
            yield int(tile[lo]), *_summed(code[lo:hi], counted[lo:hi].astype(np.int64))


def _state(chunk: int, seq: np.ndarray, own: int, width: int, spread: int) -> pa.Table:
    """Rows of one chunk: its ids that have a neighbour, a break after each run, and the counts of neighbours by tile."""
    there = seq != 0
    beside = np.zeros(len(seq), bool)
    beside[1:] |= there[:-1]
    beside[:-1] |= there[1:]
    there &= beside
    keep = there.copy()
    keep[1:] |= there[:-1]
    own = int(np.count_nonzero(keep[:own]))
    seq = np.where(there, seq, 0)[keep]
    rows = [{"chunk": chunk, "own": own, "a": pack(seq)}]
    rows += [{"chunk": chunk, "tile": t, "codes": pack(np.diff(c, prepend=0)), "counts": pack(n)} for t, c, n in tiled(seq, own, width, spread)]
    return pa.Table.from_pylist(rows, STATE)


def _packed(asked: DataFrame) -> DataFrame:
    """(chunk, local, id) rows, packed by chunk as far as they lie together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunk, local, ids = (np.asarray(batch.column(k)) for k in range(3))
            order = np.argsort(chunk, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(chunk[order])) + 1):
                if len(part):
                    cols = [pa.array([v]) for v in (int(chunk[part[0]]), pack(local[part]), pack(ids[part]))]
                    yield pa.RecordBatch.from_arrays(cols, ["chunk", "locals", "ids"])

    return asked.mapInArrow(run, "chunk long, locals binary, ids binary")


def _first_state(seqs: DataFrame, ids: DataFrame, width: int, spread: int) -> DataFrame:
    """Chunks of local words with their frequent words' packed ids -> states of pairs of words."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        local = unpack(left["a"][0].as_py())
        to = np.zeros(int(local.max(initial=0)) + 1, np.int64)
        for r in right.to_pylist():
            to[unpack(r["locals"])] = unpack(r["ids"])
        return _state(key[0].as_py(), to[local], left["own"][0].as_py(), width, spread)

    return keyed(seqs, "chunk").cogroup(keyed(ids, "chunk")).applyInArrow(run, STATE_DDL)


def _next_state(states: DataFrame, ids: DataFrame, width: int, wide: int, spread: int) -> DataFrame:
    """States with their frequent pairs' ids (packed codes a * width + b, ids) -> states of the next level, of ids below ``wide``."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        seq = unpack(left["a"][0].as_py())
        got = np.zeros(len(seq), np.int64)
        if len(right):
            codes = np.concatenate([unpack(v.as_py()) for v in right["codes"]])
            named = np.concatenate([unpack(v.as_py()) for v in right["ids"]])
            order = np.argsort(codes)
            codes, named = codes[order], named[order]
            pair = np.flatnonzero((seq[:-1] != 0) & (seq[1:] != 0))
            want = seq[pair] * width + seq[pair + 1]
            at = np.minimum(np.searchsorted(codes, want), len(codes) - 1)
            got[pair] = np.where(codes[at] == want, named[at], 0)
        return _state(key[0].as_py(), got, left["own"][0].as_py(), wide, spread)

    return keyed(states, "chunk").cogroup(keyed(ids, "chunk")).applyInArrow(run, STATE_DDL)


def _added(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sum of a tile's rows, one after another: in place where it is dense, else by sorted coordinates."""
    pairs = ((np.cumsum(unpack(c.as_py())), unpack(n.as_py())) for c, n in zip(rows["codes"], rows["counts"], strict=True))
    if rows["tile"][0].as_py() >= 0 and len(rows) >= 8:
        total, there = np.zeros(1 << 2 * EDGE, np.int64), np.zeros(1 << 2 * EDGE, bool)
        for c, n in pairs:
            total[c] += n
            there[c] = True
        at = np.flatnonzero(there)
        return at, total[at]
    return _summed(*map(np.concatenate, zip(*pairs, strict=True)))


def frequent_pairs(states: DataFrame, n_chunks: int, width: int, least: int) -> DataFrame:
    """tile, code, a, b, f of the pairs that occur at least ``least`` times."""
    mask, side = (1 << EDGE) - 1, HEAD - EDGE

    def more(rows: pa.Table) -> pa.Table:
        codes, counts = _added(rows)
        return pa.table([rows["tile"][:1], pa.array([pack(np.diff(codes, prepend=0))], pa.binary()), pa.array([pack(counts)], pa.binary())], ["tile", "codes", "counts"])

    def final(rows: pa.Table) -> pa.Table:
        codes, counts = _added(rows)
        codes, counts = codes[counts >= least], counts[counts >= least]
        tile = rows["tile"][0].as_py()
        a, b = ((tile >> side) << EDGE | codes >> EDGE, (tile & (1 << side) - 1) << EDGE | codes & mask) if tile >= 0 else (codes // width, codes % width)
        return pa.table([pa.array(np.full(len(codes), tile, np.int64)), *map(pa.array, (codes, a, b, counts))], ["tile", "code", "a", "b", "f"])

    rows = states.where("tile is not null").select("tile", "codes", "counts", "chunk")
    while n_chunks > FAN:
        n_chunks = -(-n_chunks // FAN)
        part = F.pmod(F.xxhash64("chunk", F.lit(n_chunks)), F.lit(n_chunks))
        rows = rows.withColumn("chunk", part).groupBy("tile", "chunk").applyInArrow(lambda key, t: more(t).append_column("chunk", pa.array([key[1].as_py()], pa.int64())), "tile long, codes binary, counts binary, chunk long")
    return rows.groupBy("tile").applyInArrow(final, "tile long, code long, a long, b long, f long")


def _answers(states: DataFrame, named: DataFrame, n_chunks: int, width: int) -> DataFrame:
    """chunk, codes (a * width + b), ids: what each chunk's frequent pairs are called, tile by tile."""
    parts = -(-n_chunks // FAN)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            right = right.sort_by("code")
            code, whole, ids = (np.asarray(right[c]) for c in ("code", "whole", "id"))
            for r in left.to_pylist():
                mine = np.cumsum(unpack(r["codes"]))
                at = np.minimum(np.searchsorted(mine, code), len(mine) - 1)
                both = mine[at] == code
                if both.any():
                    out.append({"chunk": r["chunk"], "codes": pack(whole[both]), "ids": pack(ids[both])})
        return pa.Table.from_pylist(out, pa.schema([("chunk", pa.int64()), ("codes", pa.binary()), ("ids", pa.binary())]))

    left = states.where("tile is not null").select("tile", "chunk", "codes", F.pmod(F.xxhash64("chunk"), F.lit(parts)).alias("part"))
    right = named.select("tile", "code", (F.col("a") * width + F.col("b")).alias("whole"), "id", F.explode(F.expr(f"sequence(0L, {parts - 1}L)")).alias("part"))
    return keyed(left, "tile", "part").cogroup(keyed(right, "tile", "part")).applyInArrow(run, "chunk long, codes binary, ids binary")


def phrases(docs: DataFrame, least: int = 30, longest: int = 4, span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """(lang, words, f) of all phrases that occur at least ``least`` times, and (lang, n) of all words."""
    rows = stored(chunks(docs, span), "chunks")
    seqs, told = rows.where("a is not null").select("chunk", "own", "a"), rows.where("a is null").select("chunk", "lang", "word", "local", "n")
    counted = stored(told.groupBy("lang", "word").agg(F.sum("n").alias("f")), "word-counts")
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    vocabulary = numbered(counted.where(F.col("f") >= least), "vocabulary", F.desc("f"), F.asc("lang"), F.asc("word")).withColumn("id", F.col("no") + 1)
    size = seqs.agg(F.count(F.lit(1)).alias("chunks"), F.sum("own").alias("tokens")).first()
    n_chunks, n_words = size["chunks"], vocabulary.count()
    width = n_words + 1
    spread = 1 << max(6, ((size["tokens"] or 0) >> 18).bit_length())
    level = vocabulary.select("id", "lang", F.array(F.col("word").cast("string")).alias("words"), "f")
    grams = level.drop("id")
    if n_chunks == 0:
        return grams, totals
    known = vocabulary.select("lang", "word", "id")
    asked = told.join(F.broadcast(known) if n_words <= FEW_WORDS else known, ["lang", "word"]).select("chunk", "local", "id")
    states = stored(_first_state(seqs, _packed(asked), width, spread), "pairs")
    for k in range(2, longest + 1):
        found = frequent_pairs(states, n_chunks, width, least)
        named = numbered(found, f"phrases-{k}", F.desc("f"), F.asc("a"), F.asc("b")).withColumn("id", F.col("no") + 1)
        front = level.select(F.col("id").alias("a"), "lang", "words")
        back = level.select(F.col("id").alias("b"), F.element_at("words", -1).alias("last"))
        joined = named.select("id", "a", "b", "f").join(front, "a").join(back, "b")
        level = stored(joined.select("id", "lang", F.concat("words", F.array("last")).alias("words"), "f"), f"level-{k}")
        grams = grams.unionByName(level.drop("id"))
        if k < longest:
            ids, wide = _answers(states, named, n_chunks, width), named.count() + 1
            states = stored(_next_state(states.where("a is not null").select("chunk", "own", "a"), ids, width, wide, spread), f"states-{k}")
            width = wide
    return grams, totals


def _exact(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, top: int = 2000, cover: int = 80, span: int = SPAN) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases.

    A phrase's score is the least over its cuts of floor(2000000 a / (l + r)); it goes if
    a longer frequent phrase that holds it has at least ``cover`` percent of its count.
    """
    grams, totals = phrases(docs, least, longest, span)
    text = lambda w: F.array_join(w, " ")
    grams = stored(grams.withColumn("phrase", text(F.col("words"))), "grams")
    f = grams.select("lang", "phrase", "f")
    long = grams.where(F.size("words") > 1).withColumn("m", F.size("words"))
    cuts = long.select("lang", "phrase", "m", F.col("f").alias("a"), "words", F.explode(F.expr("sequence(1, m - 1)")).alias("k"))
    halves = cuts.select("lang", "phrase", "a", "k", text(F.expr("slice(words, 1, k)")).alias("left"), text(F.expr("slice(words, k + 1, m - k)")).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        halves = halves.join(f.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    scored = halves.withColumn("score", F.expr("(cast(a as decimal(20,0)) * 2000000BD) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inside = long.where("m > 2").select("lang", F.col("f").alias("longer"), "words", "m", F.explode(F.expr("sequence(2, m - 1)")).alias("k"))
    inside = inside.select("lang", "longer", F.explode(F.expr("transform(sequence(1, m - k + 1), i -> array_join(slice(words, i, k), ' '))")).alias("phrase"))
    held = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = lowest.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (_exact(F.col("longer")) * 100 < _exact(F.col("a")) * cover))
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    out = ranked.join(totals, "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))

"""Hard negatives by blocks on a Hilbert curve with zone maps.

A component x becomes the integer floor(256 x), a row's score is its integer inner
product with the anchor, and a shorter vector counts as ending in zeros. Rows are
written as Parquet in the order of a Hilbert curve through the dimensions of the
greatest spread, ``block`` rows to a block, and each block has a zone map: least and
greatest value of every dimension and the labels in it. Interval arithmetic gives a
block's least and greatest possible score for an anchor; no block is left out that
could hold a wanted row, so results are exact whatever the bounds are worth.

An anchor's positives are its first rows of the same label: the blocks of the greatest
bounds are read first, and after that only those that can still reach the last of the
positives found. The windows of its positives read the same way: first the blocks
whose bounds lie about a window's upper end, then those that can hold a score between
the third found (else the lower end) and the upper end.

Anchors, along the curve too, go in groups of ``group``; a task reads one block for one
group, so each side of what it holds is bounded, and both are replicated only to the
blocks and groups that need them. Bounds are taken for ``group`` anchors and ``tile``
zone maps at a time. With vectors that have no clusters every block can hold some
anchor's row, and then every group reads all blocks.

Rows with a null label, vector or id, or a null, infinite or NaN component take no part
(results name rows by id). Where vec_id is divisible by ``noise`` the label is moved on
by one modulo 10. Rows equal in id, label and vector count once; rows of one id that
differ each take part, and an anchor's other rows are those of another id. Ties go to
the smaller id. Other columns are ignored; empty vectors have scores of 0; an empty
table or one without anchors gives no rows. Scores are exact integers; beyond 64 bits
they are held at the ends of that range.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import stored
from .numbering import keyed, numbered

BITS, CURVE_DIMS, EXACT = 4, 15, float(1 << 53)


def codes(rows: DataFrame, noise: int = 7) -> DataFrame:
    """vec_id, label (long), codes (array of whole doubles) of the rows that take part."""
    fit = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double") * 256) < float("inf"), F.lit(False)))
    whole = lambda v: F.when(F.abs(v) < EXACT, F.floor(v).cast("double")).otherwise(v)
    label = F.col("label").cast("long")
    told = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & fit).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(F.col("vec_id") % noise == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.transform("embedding", lambda x: whole(x.cast("double") * 256)).alias("codes"),
    )
    return told.dropDuplicates()


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    sizes = np.asarray(pc.list_value_length(lists), np.int64)
    flat = np.asarray(lists.flatten(), np.float64)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of rows of whole numbers below 2**bits (dimensions x bits at most 62).

    The coordinates become the transposed index by undoing rotations from the highest
    bit down and by Gray coding; its bits are then read across the dimensions.
    """
    x = cells.T.astype(np.int64)
    dims = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(dims):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn ^= np.where((x[-1] & q) > 0, q - 1, 0)
    x ^= turn
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            place = place << 1 | x[i] >> b & 1
    return place


def along_curve(coded: DataFrame, spread: list[tuple[int, float, float]], width: int) -> DataFrame:
    """``coded`` with ``curve``; ``spread`` has the dimensions to use, with mean and deviation."""
    dims, mean, dev = ([s[k] for s in spread] for k in range(3))

    def run(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            x = _matrix(t["codes"], width)[:, dims]
            scaled = np.clip(np.floor((x - mean) / dev * 4) + (1 << BITS - 1), 0, (1 << BITS) - 1)
            place = hilbert(scaled) if dims else np.zeros(len(x), np.int64)
            yield from t.append_column("curve", pa.array(place)).to_batches()

    return coded.mapInArrow(run, "vec_id long, label long, codes array<double>, curve long")


def zone_maps(rows: DataFrame, width: int) -> DataFrame:
    """block, labels, low and high (of every dimension): one row a block."""

    def run(t: pa.Table) -> pa.Table:
        x = _matrix(t["codes"], width)
        ends = [pa.array([v], pa.list_(pa.float64())) for v in (x.min(0), x.max(0))]
        return pa.table([t["block"][:1], pa.array([t["label"].unique().to_pylist()], pa.list_(pa.int64())), *ends], ["block", "labels", "low", "high"])

    return rows.select("block", "label", "codes").groupBy("block").applyInArrow(run, "block long, labels array<long>, low array<double>, high array<double>")


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible score of each anchor (row) in each block (column)."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    most = np.abs(anchors).max(initial=0) * max(np.abs(low).max(initial=0), np.abs(high).max(initial=0)) * anchors.shape[1]
    if most >= EXACT:  # sums of doubles may be off: nothing is left out
        return np.full((len(anchors), len(low)), -np.inf), np.full((len(anchors), len(low)), np.inf)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    most = np.abs(anchors).max(initial=0) * np.abs(rows).max(initial=0) * max(1, anchors.shape[1])
    if most * len(rows) < EXACT:
        return (anchors @ rows.T).astype(np.int64)
    exact = np.array([[int(v) for v in r] for r in anchors], object) @ np.array([[int(v) for v in r] for r in rows], object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1)


def _first(scores: np.ndarray, valid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k greatest valid scores of each row; in ties the smaller column."""
    n = scores.shape[1]
    k = min(k, n)
    kept = np.where(valid, scores, scores.min() - 1)
    key = np.arange(n) - kept * n
    best = np.argsort(key, axis=1, kind="stable")[:, :k] if key.dtype == object else np.argpartition(key, k - 1, axis=1)[:, :k]
    at, to = np.repeat(np.arange(len(scores)), k), best.ravel()
    ok = valid[at, to]
    return at[ok], to[ok]


class _Positives:
    """First ``k`` rows of the anchor's label."""

    found = "anchor long, slot int, score long, vec_id long"

    def __init__(self, k: int, seeds: int = 2):
        self.k, self.seeds = k, seeds

    def blocks(self, anchors: pa.Table, zones: pa.Table, low: np.ndarray, high: np.ndarray, seeding: bool) -> np.ndarray:
        own = np.asarray(anchors["label"])
        known = [set(v) for v in zones["labels"].to_pylist()]
        has = np.array([[v in s for s in known] for v in np.unique(own)]).reshape(-1, len(known))[np.unique(own, return_inverse=True)[1]]
        best = np.argsort(np.where(has, -high, np.inf), axis=1, kind="stable")[:, : self.seeds]
        first = np.zeros(has.shape, bool)
        np.put_along_axis(first, best, True, axis=1)
        return has & first if seeding else has & ~first & (high >= np.asarray(anchors["floors"].combine_chunks().flatten()).reshape(-1, 1))

    def rows(self, anchors: pa.Table, scores: np.ndarray, alike: np.ndarray, other: np.ndarray) -> list[tuple]:
        at, to = _first(scores, alike & other, self.k)
        return [(np.zeros(len(at), np.int32), at, to)]


class _Negatives:
    """First ``k`` rows of another label in each of the anchor's windows (``slots``: from lows to highs)."""

    found = _Positives.found

    def __init__(self, k: int):
        self.k = k

    def _windows(self, anchors: pa.Table, names: list[str]) -> list[np.ndarray]:
        n = anchors["lows"].combine_chunks()
        sizes = np.asarray(pc.list_value_length(n), np.int64)
        wide = int(sizes.max(initial=0))
        out = []
        for name in names:
            m = np.full((len(sizes), wide), np.nan)
            m[np.arange(wide) < sizes[:, None]] = np.asarray(anchors[name].combine_chunks().flatten(), np.float64)
            out.append(m.T)
        return out

    def blocks(self, anchors: pa.Table, zones: pa.Table, low: np.ndarray, high: np.ndarray, seeding: bool) -> np.ndarray:
        own = np.asarray(anchors["label"])
        known = zones["labels"].to_pylist()
        many, one = np.array([len(s) > 1 for s in known], bool), np.array([s[0] for s in known], np.int64)
        other = many | (one != own[:, None])
        first, rest = np.zeros(other.shape, bool), np.zeros(other.shape, bool)
        for lows, highs, floors in zip(*self._windows(anchors, ["lows", "highs", "floors"]), strict=True):
            can = other & (low <= highs[:, None] + self._slack(highs)) & (high >= lows[:, None] - self._slack(lows))
            with np.errstate(invalid="ignore"):
                off = np.where(can, np.nan_to_num(np.abs((low + high) / 2 - highs[:, None]), nan=0), np.inf)
            if off.shape[1]:
                near = np.argmin(off, axis=1)[:, None]
                np.put_along_axis(first, near, np.take_along_axis(can, near, 1) | np.take_along_axis(first, near, 1), axis=1)
            rest |= can & (high >= floors[:, None] - self._slack(floors))
        return first if seeding else rest & ~first

    @staticmethod
    def _slack(x: np.ndarray) -> np.ndarray:
        """What a 64-bit number may be off as a double."""
        return np.where(np.abs(x) >= EXACT, 2048.0, 0.0)[:, None]

    def rows(self, anchors: pa.Table, scores: np.ndarray, alike: np.ndarray, other: np.ndarray) -> list[tuple]:
        lows, highs = anchors["lows"].to_pylist(), anchors["highs"].to_pylist()
        out = []
        for s in range(max(map(len, lows), default=0)):
            lo, hi = (np.array([v[s] if s < len(v) else end for v in lists], scores.dtype)[:, None] for lists, end in ((lows, 1), (highs, 0)))
            at, to = _first(scores, ~alike & (scores >= lo) & (scores <= hi), self.k)
            out.append((np.full(len(at), s, np.int32), at, to))
        return out


def _needed(anchors: DataFrame, zones: DataFrame, want, width: int, tile: int, n_groups: int, n_blocks: int, seeding: bool) -> DataFrame:
    """anchor, block: the blocks that an anchor has to read."""

    def run(a: pa.Table, z: pa.Table) -> pa.Table:
        z = z.sort_by("block")
        out = [[], []]
        if len(a) and len(z):
            low, high = bounds(_matrix(a["codes"], width), _matrix(z["low"], width), _matrix(z["high"], width))
            at, to = np.nonzero(want.blocks(a, z, low, high, seeding))
            out = [np.asarray(a["anchor"])[at], np.asarray(z["block"])[to]]
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], ["anchor", "block"])

    tiles = -(-n_blocks // tile)
    left = anchors.withColumn("tile", F.explode(F.expr(f"sequence(0, {tiles - 1})")))
    right = zones.withColumn("tile", (F.col("block") / tile).cast("int")).withColumn("group", F.explode(F.expr(f"sequence(0L, {n_groups - 1}L)")))
    return keyed(left, "group", "tile").cogroup(keyed(right, "group", "tile")).applyInArrow(run, "anchor long, block long")


def _read(rows: DataFrame, anchors: DataFrame, needed: DataFrame, want, width: int, part: int = 256) -> DataFrame:
    """What ``want`` finds in the blocks that are needed: anchor, slot, score, vec_id."""

    def run(a: pa.Table, r: pa.Table) -> pa.Table:
        r = r.sort_by("vec_id")
        x, label, ids = _matrix(r["codes"], width), np.asarray(r["label"]), np.asarray(r["vec_id"])
        cols = [[], [], [], []]
        for begin in range(0, len(a) if len(r) else 0, part):
            some = a.slice(begin, part)
            scores = _scores(_matrix(some["codes"], width), x)
            alike = np.asarray(some["label"])[:, None] == label
            other = np.asarray(some["vec_id"])[:, None] != ids
            for slot, at, to in want.rows(some, scores, alike, other):
                for c, v in zip(cols, (np.asarray(some["anchor"])[at], slot, scores[at, to], ids[to]), strict=True):
                    c.append(pa.array(v))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.table([pa.chunked_array([v.cast(k) for v in c], k) for c, k in zip(cols, kinds, strict=True)], ["anchor", "slot", "score", "vec_id"])

    sent = needed.join(anchors, "anchor")
    wanted = needed.join(anchors.select("anchor", "group"), "anchor").select("group", "block").distinct()
    return keyed(sent, "group", "block").cogroup(keyed(rows.join(wanted, "block"), "group", "block")).applyInArrow(run, want.found)


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mined(
    rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, noise: int = 7, block: int = 2048, group: int = 2048, tile: int = 2048
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``. A positive's negatives have
    scores from 50 to 95 percent of its own.
    """
    none = rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    coded = stored(codes(rows, noise), "codes")
    by_dim = coded.select(F.posexplode("codes").alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("dev")).collect()
    width = len(by_dim)
    spread = sorted((r for r in by_dim if r["dev"] > 0), key=lambda r: (-r["dev"], r["dim"]))[:CURVE_DIMS]
    order = ["curve", "vec_id", "label", "codes"]
    ordered = numbered(along_curve(coded, [(r["dim"], r["mean"], r["dev"]) for r in spread], width), "curve", *map(F.col, order))
    parts = ordered.withColumn("block", (F.col("no") / block).cast("long")).select("block", "vec_id", "label", "codes", "no")
    blocks = stored(parts, "blocks")
    chosen = numbered(blocks.where(F.col("vec_id") % every == 0).select(F.col("no").alias("anchor"), "vec_id", "label", "codes"), "anchors", F.col("anchor"))
    n_rows, n_anchors = blocks.count(), chosen.count()
    if n_anchors == 0:
        return none
    anchors = stored(chosen.withColumn("group", (F.col("no") / group).cast("long")).drop("no"), "anchor-groups")
    blocks = blocks.drop("no")
    zones = stored(zone_maps(blocks, width), "zones")
    n_groups, n_blocks = -(-n_anchors // group), -(-n_rows // block)

    def searched(state: DataFrame, want, k: int, narrowed: Callable[[DataFrame], DataFrame]) -> DataFrame:
        first = stored(_read(blocks, state, _needed(state, zones, want, width, tile, n_groups, n_blocks, True), want, width), "first-read")
        state = stored(narrowed(first), "state")
        rest = _read(blocks, state, _needed(state, zones, want, width, tile, n_groups, n_blocks, False), want, width)
        return stored(_best(first.unionByName(rest), k), "found")

    def last(found: DataFrame, k: int) -> DataFrame:
        return _best(found, k).where(F.col("rank") == k)

    def reach(first: DataFrame) -> DataFrame:
        low = last(first, positives).select("anchor", F.array(F.col("score").cast("double")).alias("floors"))
        return anchors.join(low, "anchor", "left").withColumn("floors", F.coalesce("floors", F.array(F.lit(float("-inf")))))

    pos = searched(anchors, _Positives(positives), positives, reach).where("score >= 0")
    s = F.col("score")
    window = F.struct((F.col("rank") - 1).alias("at"), F.expr("score - score div 2").alias("low"), (s - F.expr("(score - 1) div 20") - F.when(s > 0, 1).otherwise(0)).alias("high"))
    spans = pos.groupBy("anchor").agg(F.array_sort(F.collect_list(window)).alias("w"))
    wide = stored(anchors.join(spans, "anchor").select("anchor", "group", "vec_id", "label", "codes", F.col("w.low").alias("lows"), F.col("w.high").alias("highs"), F.col("w.low").alias("floors")), "windows")

    def narrow(first: DataFrame) -> DataFrame:
        low = last(first, negatives).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("m"))
        at: Column = F.transform("lows", lambda v, i: F.coalesce(F.try_element_at("m", i), v))
        return wide.join(low, "anchor", "left").withColumn("floors", at).drop("m")

    neg = searched(wide, _Negatives(negatives), negatives, narrow)
    held = pos.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), s.alias("positive_score"))
    named = anchors.select("anchor", F.col("vec_id").alias("anchor_id"))
    out = neg.select("anchor", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(held, ["anchor", "slot"]).join(named, "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")

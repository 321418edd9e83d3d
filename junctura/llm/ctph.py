"""Context-triggered piecewise hashing.

A rolling hash over 7 bytes of the UTF-8 text ends a chunk wherever its value
plus one is a multiple of the block size, 3 * 2**k. A signature has one letter
of 64 for each chunk. k is the smallest that gives at most 64 chunks, and the
fingerprint ``block:signature:signature of twice the block`` can be compared
with one of the same, half or twice the block size. Likeness is by edit distance
(insertions and deletions cost 1, replacements 2) of the signatures at a common
block size: 1 - distance / (sum of lengths). Signatures of different texts that
share no run of ``RUN`` letters (or of the shorter one's length) have likeness 0.

Documents follow each other by falling id of any type that has an order (nulls
last, ties by falling XXH64 of the text); after the last comes the first.

Scale: rows move once, with their texts compressed, to ranges of (id, tie, row
number) that Spark samples, so repeated ids and rows spread. Each range is sorted
and read as a stream that holds two documents. What is done is stored, and with
it the first and last document of every range; these few rows meet those of the
next range in a join of range numbers. Only the numbers of ranges that have rows
go through the driver.

Defined cases: a null text is empty (one empty chunk); a very long one is hashed
in steps; a single document is its own next; repeated rows each get a row and
follow each other; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import stored

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
WINDOW, MOST, RUN, FIRST = 7, 64, 5, 3
STEP = 1 << 20


def _triggers(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places after which a chunk can end, and for how many doublings of the block size it does."""
    places, levels = [], []
    for at in range(0, len(data), STEP):
        low = max(0, at - WINDOW + 1)
        b = np.frombuffer(data, np.uint8, min(at + STEP, len(data)) - low, low).astype(np.uint32)
        lead = WINDOW - 1 - (at - low)
        b = np.concatenate([np.zeros(lead, np.uint32), b])
        n = len(b) - WINDOW + 1
        rolled, mixed = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
        for k in range(WINDOW):  # k bytes before the last of the window
            part = b[WINDOW - 1 - k : WINDOW - 1 - k + n]
            rolled += part * np.uint32(WINDOW - k + 1)
            mixed ^= part << np.uint32(5 * k)
        rolled += mixed + np.uint32(1)
        hit = np.flatnonzero(rolled % np.uint32(FIRST) == 0)
        third = rolled[hit] // np.uint32(FIRST)
        places.append(hit + at)
        levels.append(np.bitwise_count((third & (~third + np.uint32(1))) - np.uint32(1)))
    return (np.concatenate(places), np.concatenate(levels)) if places else (np.zeros(0, np.int64), np.zeros(0, np.uint8))


def fingerprint(text: str | None) -> str:
    data = (text or "").encode("utf-8", "surrogatepass")
    places, levels = _triggers(data)
    counts = np.bincount(levels, minlength=34)[::-1].cumsum()[::-1]  # chunk ends at a level or higher
    k = int(np.argmax(counts < MOST))

    def signature(level: int) -> str:
        ends = (places[levels >= level] + 1).tolist()
        if not ends or ends[-1] < len(data):
            ends.append(len(data))
        return "".join([LETTERS[xxhash.xxh32_intdigest(data[i:j]) & 63] for i, j in zip([0, *ends], ends, strict=False)])

    return f"{FIRST << k}:{signature(k)}:{signature(k + 1)}"


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming."""
    full, at = (1 << len(a)) - 1, {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    run = min(RUN, len(a), len(b))
    if {a[i : i + run] for i in range(len(a) - run + 1)}.isdisjoint(b[i : i + run] for i in range(len(b) - run + 1)):
        return 0.0
    return 2 * _common(a, b) / (len(a) + len(b))


def likeness(one: str, other: str) -> float:
    """0 to 1; 0 where the block sizes aren't compatible."""
    if one == other:
        return 1.0
    (n, a1, a2), (m, b1, b2) = one.split(":"), other.split(":")
    n, m = int(n), int(m)
    if n == m:
        return max(_alike(a1, b1), _alike(a2, b2) if min(len(a2), len(b2)) > RUN else 0.0)
    if n == 2 * m:
        return _alike(a1, b2)
    return _alike(a2, b1) if m == 2 * n else 0.0


def edited(text: str, after: str) -> str:
    """``text`` whose last third is replaced by as many first characters of ``after``, or all."""
    n = len(text) // 3
    return text[: len(text) - n] + after[:n]


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
TYPES = [pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, tie, no, packed: each text compressed by itself."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3, write_content_size=True, write_checksum=False)
        for b in batches:
            packed = pa.array([press.compress((x.as_py() or "").encode("utf-8", "surrogatepass")) for x in b.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], packed], ["doc_id", "tie", "no", "packed"])

    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), F.monotonically_increasing_id().alias("no"), "text")
    return rows.mapInArrow(pack, f"doc_id {kind}, tie long, no long, packed binary")


def _row(one: object, text: str, own: str, after: str, next_own: str) -> tuple:
    changed = edited(text, after)
    new = fingerprint(changed)
    return one, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own, new, likeness(own, new), likeness(own, next_own)


def compared(docs: DataFrame, range_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.desc_nulls_last("doc_id"), F.desc("tie"), F.asc("no")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, unpack = TaskContext.get().partitionId(), None, zstandard.ZstdDecompressor()
        id_type = None

        def built(rows: list[tuple], edge: str) -> pa.RecordBatch:
            """Done rows, or one that is the first or last of its range."""
            cols = list(zip(*rows, strict=True)) or [()] * 8
            arrays = [pa.array(c, t) for c, t in zip(cols[:7], [id_type, *TYPES], strict=True)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([part] * len(rows), pa.int32()), pa.array([edge] * len(rows), pa.string()), pa.array(cols[7], pa.binary())], [*NAMES, "part", "edge", "packed"])

        def waits(row: tuple, edge: str) -> pa.RecordBatch:
            return built([(row[0], len(row[1]), None, row[2], None, None, None, row[3])], edge)

        for b in batches:
            out, id_type = [], b["doc_id"].type
            for one, packed in zip(b["doc_id"], b["packed"], strict=True):
                packed = packed.as_py()
                text = unpack.decompress(packed).decode("utf-8", "surrogatepass")
                own = last[2] if last and last[1] == text else fingerprint(text)
                now = (one.as_py(), text, own, packed)
                if last:
                    out.append((*_row(*last[:3], text, own), None))
                else:
                    yield waits(now, "first")
                last = now
            yield built(out, "")
        if last:
            yield waits(last, "last")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for one, own, packed, next_own, after in zip(*(b[c].to_pylist() for c in ("doc_id", "fingerprint", "packed", "next_own", "after")), strict=True):
                text, then = (unpack.decompress(x).decode("utf-8", "surrogatepass") for x in (packed, after))
                rows.append(_row(one, text, own, then, next_own))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [b["doc_id"].type, *TYPES], strict=True)], NAMES)

    ranged = _packed(docs).repartitionByRange(max(1, math.ceil(total / range_bytes)), *order).sortWithinPartitions(*order)
    out = stored(ranged.select("doc_id", "packed").mapInArrow(run, f"{made}, part int, edge string, packed binary"), "ctph")
    parts = sorted(r.part for r in out.where("edge = 'last'").select("part").collect())
    after = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next int")
    firsts = out.where("edge = 'first'").select(F.col("part").alias("next"), F.col("fingerprint").alias("next_own"), F.col("packed").alias("after"))
    ends = out.where("edge = 'last'").select("part", "doc_id", "fingerprint", "packed").join(after, "part").join(firsts, "next")
    return out.where("edge = ''").select(*NAMES).unionByName(ends.select("doc_id", "fingerprint", "packed", "next_own", "after").mapInArrow(joined, made))

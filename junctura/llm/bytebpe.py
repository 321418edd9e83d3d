"""Byte-level BPE: overlapping chunk encoding, and decoding.

A text is cut into chunks of ``size`` characters that run ``overlap`` characters
into the next. Chunks are pre-tokenised apart, each from its own start, which
need not be a pre-token's. Matching goes left to right and looks only ahead, so
once a chunk and its predecessor both have a boundary at one place they agree
from there on; the pieces up to it are the predecessor's, from it the chunk's.
Where two chunks don't meet in the overlap (a long run), matching goes on from
the last sure boundary until it meets one of the chunk. The pieces are then
encoded each by itself, and decoding concatenates the raw bytes of the ids.

Scale: texts are chunked, stitched and encoded where they lie, a task's many at
its time. One of over ``span`` characters is cut into overlapping rows of that
size that are dealt out, pre-tokenised (again by chunks) and encoded in
parallel; only piece ends and ids meet again, by text, and are stitched alike.

Defined cases: a null text is empty and has no ids; a very long text is spread
over tasks; null ids and repeated rows pass through, a row each, and equal texts
have equal ids; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP, AHEAD = 1024, 96, 4  # AHEAD: how far past its end a match may have looked
SPAN = 1 << 16
CACHED, LONGEST = 400_000, 60


class Codec:
    """Ids of pieces by public ranks, and bytes of ids."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.raw = {i: b for b, i in ranks.items()}
        self.known: dict[str, tuple[int, ...]] = {}

    def piece(self, text: str) -> tuple[int, ...]:
        found = self.known.get(text)
        if found is None:
            found = tuple(self.core.encode_ordinary(text))
            if len(text) <= LONGEST:
                if len(self.known) >= CACHED:
                    self.known.clear()
                self.known[text] = found
        return found

    def ids(self, pieces: list[str]) -> list[int]:
        get, slow = self.known.get, self.piece
        return list(chain.from_iterable([get(p) or slow(p) for p in pieces]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))


@lru_cache(1)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def chunks(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    return [text[at : at + size + overlap] for at in range(0, max(1, len(text)), size)]


def sure(pieces: list[str], chunk: str, last: bool) -> list[int]:
    """Sure piece ends in a chunk that is read from its start."""
    ends = list(accumulate(map(len, pieces)))
    while not last and ends and ends[-1] > len(chunk) - AHEAD:
        ends.pop()
    return ends


def cuts(find: Callable, chunk: str, last: bool) -> list[int]:
    return sure(find(chunk), chunk, last)


def stitch(text: Callable[[int, int], str], ends: list[list[int]], size: int, total: int, find: Callable) -> list[tuple[int, int, int]]:
    """(chunk, first end, last end) parts, or (-1, start, stop) for a stretch to match anew, that make up the whole.

    ``ends[k]`` are chunk k's sure piece ends counted from its start; ``text(a, b)`` gives characters a to b.
    """
    parts: list[tuple[int, int, int]] = []
    at, k = 0, 0  # a sure boundary of the whole, and the chunk that has it
    while at < total:
        own = ends[k]
        i = 0 if at == k * size else bisect_right(own, at - k * size)
        if k + 1 == len(ends):
            parts.append((k, i, len(own)))
            break
        after = {0, *ends[k + 1]} if len(ends[k + 1]) < 64 else {0, *ends[k + 1][: bisect_right(ends[k + 1], own[-1] - size if own else 0)]}
        j = next((j for j in range(max(i, bisect_left(own, size)), len(own)) if own[j] - size in after), None)
        if j is not None:
            parts.append((k, i, j + 1))
            at, k = own[j] + k * size, k + 1
            continue
        parts.append((k, i, len(own)))
        at = own[-1] + k * size if len(own) > i else at
        began, width = at, size
        while True:  # match on from the last sure end until a later chunk has one of the ends
            stop = min(total, at + width)
            new = [at + e for e in cuts(find, text(at, stop), stop == total)]
            met = next(((e, n) for e in new for n in (min(e // size, len(ends) - 1),) if n > k and e < total and _has(ends[n], e - n * size)), None)
            if met is not None or stop == total:
                break
            width *= 2
        parts.append((-1, began, met[0] if met else total))
        at, k = met or (total, k)
    return parts


def _has(ends: list[int], e: int) -> bool:
    i = bisect_left(ends, e)
    return e == 0 or i < len(ends) and ends[i] == e


def split(text: str, find: Callable, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Pre-tokens of a text by overlapping chunks."""
    if len(text) <= size:
        return find(text)
    each = chunks(text, size, overlap)
    pieces = [find(c) for c in each]
    ends = [sure(p, c, k + 1 == len(each)) for k, (p, c) in enumerate(zip(pieces, each, strict=True))]
    out: list[str] = []
    for k, i, j in stitch(lambda a, b: text[a:b], ends, size, len(text), find):
        out += pieces[k][i:j] if k >= 0 else _upto(find, text, i, j)
    return out


def _upto(find: Callable, text: str, start: int, stop: int) -> list[str]:
    out, at = [], start
    for p in find(text[start : stop + AHEAD + 1]) if stop > start else []:
        if at >= stop:
            break
        out.append(p)
        at += len(p)
    return out


def encode(docs: DataFrame, path: str, pattern: str, size: int = SIZE, overlap: int = OVERLAP, span: int = SPAN) -> DataFrame:
    """doc_id, ids array<int>: the ids of every whole text."""
    return _with_ids(docs, path, pattern, (size, overlap, span), "ids array<int>", lambda c, ids: (ids,), [pa.list_(pa.int32())])


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, bytes: the raw bytes of ``ids``, concatenated."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(x or []) for x in b.column(1).to_pylist()], pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, size: int = SIZE, overlap: int = OVERLAP, span: int = SPAN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded and decoded again, kept as digests."""

    def digest(c: Codec, ids: list[int]) -> tuple:
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()

    return _with_ids(docs, path, pattern, (size, overlap, span), "n_tokens long, ids_sha256 string, decoded_sha256 string", digest, [pa.int64(), pa.string(), pa.string()])


def _with_ids(docs: DataFrame, path: str, pattern: str, sizes: tuple[int, int, int], columns: str, finish: Callable, types: list) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [x.split()[0] for x in columns.split(", ")]
    docs = docs.select("doc_id", "text")
    size, overlap, span = sizes
    long = F.length("text") > span

    def built(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * len(types)
        return pa.RecordBatch.from_arrays([ids, *(pa.array(x, t) for x, t in zip(cols, types, strict=True))], ["doc_id", *names])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            yield built(b.column(0), [finish(c, c.ids(split(x or "", c.pattern.findall, size, overlap))) for x in b.column(1).to_pylist()])

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, row = TaskContext.get().partitionId(), 0
        for b in batches:
            for one, x in zip(b.column(0), b.column(1), strict=True):
                each = chunks(x.as_py(), span, overlap)
                for k, part in enumerate(each):  # a row per chunk, so no batch is larger than the text was
                    yield pa.RecordBatch.from_arrays([pa.array([one.as_py()], b.column(0).type), pa.array([(task << 33) + row]), pa.array([k], pa.int32()), pa.array([len(each)], pa.int32()), pa.array([part])], ["doc_id", "text_no", "chunk", "n", "part"])
                row += 1

    def pretokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            ends, flat, sizes = [], [], []
            for part, k, n in zip(b["part"].to_pylist(), b["chunk"].to_pylist(), b["n"].to_pylist(), strict=True):
                found = split(part, c.pattern.findall, size, overlap)
                e = sure(found, part, k + 1 == n)
                ids = [*map(c.piece, found[: len(e)])]
                ends.append(e)
                flat.append([*chain.from_iterable(ids)])
                sizes.append([len(x) for x in ids])
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*(b[x] for x in ("doc_id", "text_no", "chunk", "n", "part")), pa.array(ends, ints), pa.array(flat, ints), pa.array(sizes, ints)], ["doc_id", "text_no", "chunk", "n", "part", "ends", "ids", "sizes"])

    def stitched(t: pa.Table) -> pa.Table:
        c, t = codec(path, pattern), t.sort_by("chunk")
        parts, ends = t["part"].to_pylist(), t["ends"].to_pylist()
        total = (len(parts) - 1) * span + len(parts[-1])

        def text(a: int, b: int) -> str:
            last = len(parts) - 1
            return "".join(parts[k][max(0, a - k * span) : b - k * span] if k == last else parts[k][:span][max(0, a - k * span) : b - k * span] for k in range(min(last, a // span), min(last, b // span) + 1))

        ids: list[int] = []
        for k, i, j in stitch(text, ends, span, total, partial(split, find=c.pattern.findall, size=size, overlap=overlap)):
            if k < 0:
                ids += c.ids(_upto(c.pattern.findall, text(i, min(total, j + AHEAD + 1)), 0, j - i))
            else:
                at = np.concatenate([[0], np.cumsum(t["sizes"][k].as_py(), dtype=np.int64)])
                ids += t["ids"][k].as_py()[int(at[i]) : int(at[j])]
        return pa.Table.from_batches([built(t["doc_id"].combine_chunks()[:1], [finish(c, ids)])])

    rows = docs.where(long).mapInArrow(cut_up, f"doc_id {kind}, text_no long, chunk int, n int, part string")
    tokens = rows.repartition(F.col("text_no"), F.col("chunk")).mapInArrow(pretokenised, f"doc_id {kind}, text_no long, chunk int, n int, part string, ends array<int>, ids array<int>, sizes array<int>")
    whole = tokens.groupBy("text_no").applyInArrow(stitched, f"doc_id {kind}, {columns}")
    return docs.where(~F.coalesce(long, F.lit(False))).mapInArrow(short, f"doc_id {kind}, {columns}").unionByName(whole)

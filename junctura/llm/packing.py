"""Tokenising documents and packing them by the sum-of-squares rule.

A document's sequence is its token ids and one separator id. Longer ones than
``capacity`` are cut into full pieces and a rest; nothing else is cut. A piece
goes where the sum over gaps of (open bins with that gap) squared becomes
smallest: into an open bin whose gap fits, or a new bin; ties take the smallest
gap. Pieces are taken longest first, so short ones fill what is left. At the end
the pieces of the ``closing`` emptiest bins are packed anew, each into the
fullest bin that has room, and that is kept if it takes fewer bins.

Scale: rows are dealt to shards of about ``shard_pieces`` pieces by a hash of a
key of their own, so equal rows spread, and each shard is packed alone; a shard
leaves at most a few part-filled bins. Full pieces are bins at once.

Defined cases: a null text is empty and has the separator alone; a very long one
is tokenised whole and cut into pieces; a null id is packed like another;
repeated rows are packed each; pieces of one length go in any order; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import gc
import json
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import stored

_SPACE = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_ODD = regex.compile(r"[\x1c-\x1f]")  # white space for str.split() alone
CACHED, LONGEST, GROUP = 600_000, 48, 2 << 20
TAIL = ".,;:!?*#$%&|)(-\""  # letters and then a run of these are two pre-tokens


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next free ones from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Merger:
    """The merges of a vocabulary file, applied to many pre-tokens at once.

    In every round each pre-token's leftmost pair of the lowest rank becomes one
    symbol, until no pair has a rank; pairs are looked up in a hashed table.
    """

    NEVER = 1 << 30

    def __init__(self, path: str):
        with open(path) as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        letters = _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + end] for c in letters], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.size = len(vocab)
        if self.size >= 1 << 16:
            raise ValueError("pairs of ids must fit 32 bits")
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.uint32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.bits, self.free = 19, np.uint32(0xFFFFFFFF)  # no pair has the key ``free``
        self.keys, self.ranks = np.full((1 << self.bits) + 64, self.free, np.uint32), np.full((1 << self.bits) + 64, self.NEVER, np.int32)
        self.probes = 1
        for rank, (key, at) in enumerate(zip(keys.tolist(), self._slot(keys).tolist(), strict=True)):
            n = 0
            while self.keys[at + n] != self.free:
                n += 1
            self.keys[at + n], self.ranks[at + n], self.probes = key, rank, max(self.probes, n + 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.uint32) * np.uint32(self.size) + b.astype(np.uint32)
        at = self._slot(key)
        out = np.where(self.keys[at] == key, self.ranks[at], self.NEVER)
        for n in range(1, self.probes):
            at += np.uint32(1)
            out = np.where(self.keys[at] == key, self.ranks[at], out)
        out[(a < 0) | (b < 0)] = self.NEVER
        return out

    def __call__(self, parts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each pre-token, given as its UTF-8 bytes."""
        out: list[bytes] = [b""] * len(parts)
        order = np.argsort(np.fromiter(map(len, parts), np.int32, len(parts)), kind="stable").tolist()
        for at in range(0, len(order), 8192):
            self._some(parts, order[at : at + 8192], out)
        return out

    def _some(self, parts: list[bytes], which: list[int], out: list[bytes]) -> None:
        size = np.array([len(parts[i]) for i in which])
        wide = int(size.max())
        s = np.full((len(which), wide + 1), -1, np.int32)
        s[np.arange(wide + 1) < size[:, None]] = self.inner[np.frombuffer(b"".join([parts[i] for i in which]), np.uint8)]
        ends = np.frombuffer(bytes([parts[i][-1] for i in which]), np.uint8)
        s[np.arange(len(which)), size - 1] = self.last[ends]
        r = np.full((len(which), wide + 1), self.NEVER, np.int32)
        r[:, :-1] = self.rank(s[:, :-1], s[:, 1:])
        live, cols = np.arange(len(which)), np.arange(wide)
        done = s.copy()
        while True:
            m = r.argmin(1)
            best = r[np.arange(len(m)), m]
            on = best < self.NEVER
            if not on.all():
                done[live[~on]] = s[~on]
                s, r, m, best, live = s[on], r[on], m[on], best[on], live[on]
            if not len(live):
                break
            row = np.arange(len(live))
            s[row, m] = self.made[best]
            tail = cols > m[:, None]
            s[:, :-1] = np.where(tail, s[:, 1:], s[:, :-1])
            r[:, :-1] = np.where(tail, r[:, 1:], r[:, :-1])
            s[:, -1], r[:, -1] = -1, self.NEVER
            r[row, m] = self.rank(s[row, m], s[row, np.minimum(m + 1, wide)])
            left = m > 0
            r[row[left], m[left] - 1] = self.rank(s[row[left], m[left] - 1], s[row[left], m[left]])
        n = (done >= 0).sum(1)
        flat = done[done >= 0].astype(np.uint32).tobytes()
        ends = (4 * np.cumsum(n)).tolist()
        for i, a, b in zip(which, [0, *ends], ends, strict=False):
            out[i] = flat[a:b]


def _western(text: str) -> bool:
    """Whether all characters are below 256; such text is composed, and its lower case is character by character."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordEncoder:
    """Ids of texts by a vocabulary that lower-cases, drops white space and never joins over it.

    As such a vocabulary encodes every white-space word alone, ids of words are
    kept (at most ``CACHED`` of at most ``LONGEST`` characters). New words of a
    group of texts are encoded together: those with characters below 256 are cut into
    pre-tokens, and new ones of these merged at once; others, and long ones, by the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.merger = Merger(path)
        self.part = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.words: dict[str, bytes] = {}

    def _split(self, text: str | None) -> list[str]:
        if not text:
            return []
        plain = _western(text)
        text = text.lower() if plain else text
        words = [w for w in _SPACE.split(text) if w] if _ODD.search(text) else text.split()
        return words if plain else [w.lower() if _western(w) else w for w in words]

    def _learn(self, words: set[str]) -> list[str]:
        """Add the ids of new words and of their pre-tokens; returns the words that are too long to stay."""
        known = self.words
        odd = [w for w in words if len(w) > LONGEST or not w.isascii() and not _western(w)]
        if odd:
            found = self.model.encode_batch_fast(odd, add_special_tokens=False)
            known.update((w, np.asarray(e.ids, np.uint32).tobytes()) for w, e in zip(odd, found, strict=True))
            words = words.difference(odd)
        parts = {w for w in words if w.isalpha()}
        rest = [w for w in words if not w.isalpha()]
        cores = [w.rstrip(TAIL) for w in rest]
        cut = {}
        for w, core in zip(rest, cores, strict=True):
            if core.isalpha():
                parts.add(core)
                parts.add(w[len(core) :])
            else:
                cut[w] = self.part.findall(w)
                parts.update(cut[w])
        new = list(parts.difference(known))
        known.update(zip(new, self.merger([p.encode() for p in new]), strict=True))
        for w, core in zip(rest, cores, strict=True):
            known[w] = b"".join([known[p] for p in cut[w]]) if w in cut else known[core] + known[w[len(core) :]]
        return [w for w in odd if len(w) > LONGEST]

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        at = 0
        while at < len(texts):
            split, size = [], 0
            while at < len(texts) and size < GROUP:
                split.append(self._split(texts[at]))
                size += len(texts[at] or "")
                at += 1
            need = set().union(*split)
            new = need.difference(self.words)
            if len(self.words) + len(new) > CACHED:
                self.words, new = {}, need
            gc.disable()  # else every few hundred new words are a reason to look through all that are known
            passing = self._learn(new) if new else []
            gc.enable()
            get = self.words.__getitem__
            for words in split:
                yield b"".join(map(get, words))
            for w in passing:
                del self.words[w]


@lru_cache(1)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pieces(docs: DataFrame, path: str, capacity: int = 4096, separator: int = 1, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32[, ids (little-endian 32-bit)] per piece."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    tail = np.uint32(separator).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            rows: list[tuple] = []
            for i, data in enumerate(enc(b.column(1).to_pylist())):
                data += tail
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    rows.append((i, k, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            out = [b.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:5])]
            yield pa.RecordBatch.from_arrays(out + [pa.array(cols[5], pa.binary())] * with_ids, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length; bins are numbered from 0."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    n = np.zeros(capacity + 1, np.int64)  # open bins by gap
    where: list[list[int]] = [[] for _ in range(capacity + 1)]
    made, never = 0, 1 << 60
    for i in order:
        s = int(lengths[i])
        # Change of the sum less 2 where a bin is open: n[g] loses one bin, n[g - s] gains one.
        cost = np.where(n[s:capacity] > 0, 2 * (n[: capacity - s] - n[s:capacity]), never)
        if n[s]:
            cost[0] = -2 * n[s] - 1  # a full bin leaves, and no gap gains one
        at = int(cost.argmin()) if len(cost) else 0
        if not len(cost) or cost[at] > 2 * n[capacity - s] - 1:
            b, gap = made, capacity
            made += 1
        else:
            gap = s + at
            b = where[gap].pop()
            n[gap] -= 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            where[gap - s].append(b)
            n[gap - s] += 1
    return bins, offsets


def closed(lengths: np.ndarray, bins: np.ndarray, offsets: np.ndarray, capacity: int, closing: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the emptiest bins packed anew, best fit and longest first, if that takes fewer."""
    fill = np.bincount(bins, lengths) if len(bins) else np.zeros(0)
    emptiest = np.argsort(fill, kind="stable")[:closing]
    chosen = np.flatnonzero(np.isin(bins, emptiest))
    open_, place = [], {}  # (gap, bin) by gap
    made = 0
    for i in chosen[np.argsort(-lengths[chosen], kind="stable")].tolist():
        size = int(lengths[i])
        at = bisect_left(open_, (size, -1))
        gap, b = open_.pop(at) if at < len(open_) else (capacity, made)
        made = max(made, b + 1)
        place[i] = b, capacity - gap
        if gap > size:
            insort(open_, (gap - size, b))
    if made >= len(emptiest):
        return bins, offsets
    bins, offsets = bins.copy(), offsets.copy()
    for i, (b, offset) in place.items():
        bins[i], offsets[i] = emptiest[b], offset
    return bins, offsets


def pack(items: DataFrame, capacity: int = 4096, shard_pieces: int = 40_000, shard_by: list[str] | None = None, closing: int = 256) -> DataFrame:
    """``items`` (with length, at most capacity) and sequence_id, offset. Columns beside these pass through; ``shard_by`` (a row number) deal them to shards."""
    shards = max(1, -(-items.count() // shard_pieces))

    def run(t: pa.Table) -> pa.Table:
        lengths = t["length"].to_numpy()
        bins, offsets = closed(lengths, *sum_of_squares(lengths, capacity), capacity, closing)
        return t.drop_columns(["shard"]).append_column("sequence_id", pa.array(bins + (t["shard"][0].as_py() << 32))).append_column("offset", pa.array(offsets))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    by = [F.col(c) for c in shard_by] if shard_by else [F.monotonically_increasing_id()]
    dealt = items.withColumn("shard", F.pmod(F.xxhash64(*by), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(run, f"{fields}, sequence_id long, offset long")


def packed(docs: DataFrame, path: str, capacity: int = 4096, separator: int = 1, shard_pieces: int = 40_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids per piece of every document.

    Places come of lengths alone; the ids are stored with a number of their row (documents may repeat) and joined to their places.
    """
    cut_up = stored(pieces(docs, path, capacity, separator).withColumn("__key", F.monotonically_increasing_id()), "pieces")
    placed = pack(cut_up.drop("ids"), capacity, shard_pieces, ["__key"])
    return placed.join(cut_up.select("__key", "ids"), "__key").drop("__key")


def sequences(placed: DataFrame) -> DataFrame:
    """Placed pieces with their ids -> sequence_id, ids: the training sequences, each at most the capacity."""
    both = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return both.select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))

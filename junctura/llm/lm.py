"""Language-model scoring by a weighted backoff automaton.

Tokens are the ASCII-white-space words of the A-Z-lower-cased text and one end
token. Unigrams are add-one smoothed with a place for the unknown word; longer
n-grams are smoothed by a prior on the next shorter model,

    P(w | h) = (c(h w) + m P(w | h')) / (c(h) + m),  m = mu + spread c(h) of the length,

which sums to one. The automaton has a state for the empty context and for every
context h seen in training, an arc for each seen h w with the smoothed weight,
and a failure arc from h to its suffix h' of weight m / (c(h) + m).

Texts are read from left to right, many side by side. Each carries its state: if
the state has an arc for the next token, its weight is added and the arc leads to
the longest seen context; if not, the failure arc's weight is added and the same
token is tried from the shorter state. A text starts in the state after an end.
A long text is read in lanes of ``LANE`` tokens, each after a run-up of order - 1
tokens, which leads from the empty state to the very state that the text has there.

Of the ``mu`` and ``spread`` tried on the 0.1 scale documents the defaults have
the highest held-out likelihood (log10 a token: -3.25; unigrams alone -4.19).

Scale: the model is never whole in one place. A task tokenises its rows into
blocks of about ``block_bytes`` of text and stores them; texts are not shuffled.
Blocks ask for the training counts of their distinct n-grams, by shards of the
n-grams' 64-bit hashes: for words and word pairs first, then for each length more
only those whose two parts are in other blocks too; the count of any other is the
block's own. So a part of the automaton is built where its texts are. With
more than ``fan`` blocks, questions go through routers that merge those of
``fan`` blocks, and so on upward, so messages grow with the blocks and not with
their square. A frequent n-gram is one entry per block, so no key is hot. Hashes
of n distinct n-grams meet by chance about n*n/2**65 times (10**7: 3e-6).

Defined cases: a null text is empty and has the end token alone; a very long text
is a block of its own; a null id is not held out; repeated rows and equal texts
each get a row, with equal scores; an empty table gives an empty result; with no
training rows N = V = 0. With ``mu`` 0 what a seen context was never followed by
has probability 0 and score -infinity; an unseen context is no state, so it costs
nothing. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import stored

END = b""
LANE, SOME = 1024, 1 << 18  # tokens of a lane, words held as such
MU, SPREAD = (10.0, 0.5), (3.0, 0.8)  # for word pairs, and for longer n-grams
_ASK = "block long, rank int, shard long, keys binary, counts binary"
_ASKED = pa.schema([("block", pa.int64()), ("rank", pa.int32()), ("shard", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_ANSWER = "block long, rank int, shard long, counts binary, types long, tokens long"
_ANSWERED = pa.schema([("block", pa.int64()), ("rank", pa.int32()), ("shard", pa.int64()), ("counts", pa.binary()), ("types", pa.int64()), ("tokens", pa.int64())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.table([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte of equal weight, which the shuffle's own compression shortens."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _from_planes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _pack(keys: np.ndarray) -> bytes:
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(data, np.uint64), dtype=np.uint64)


def tokenised(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Word numbers of all texts (0: an end), tokens of each text, and the words from number 1."""
    words, lengths, parts = [], np.zeros(len(texts), np.int32), []
    for i, t in enumerate(texts):
        mine = (t or "").encode("utf-8", "surrogatepass").lower().split()
        lengths[i] = len(mine) + 1
        words.append(END)
        words += mine
        if len(words) > SOME:
            parts.append(pa.array(words, pa.binary()))
            words = []
    coded = pa.chunked_array([*parts, pa.array([*words, END], pa.binary())]).dictionary_encode()
    # Each text's end is put before its words above, so the first word is the end; now it goes behind them.
    numbers = np.concatenate([c.indices.to_numpy() for c in coded.chunks])[1:].astype(np.int32)
    return numbers, lengths, coded.chunk(coded.num_chunks - 1).dictionary.to_pylist()[1:]


class Block:
    """The token sequences of some texts, and their n-grams up to ``order``.

    grams[k-1]: sorted distinct k-gram hashes; places[k-1]: for each token the
    number of the k-gram that ends there (-1: it would reach before the start);
    prefix[k-1], suffix[k-1]: the (k-1)-grams of each k-gram without its last and first token.
    """

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, words: list[bytes], order: int):
        self.lengths = lengths.astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        one = np.fromiter(map(xxhash.xxh64_intdigest, [END, *words]), np.uint64, len(words) + 1)
        g, back = np.unique(one, return_inverse=True)
        self.end = int(back[0])
        self.grams, self.places, self.prefix, self.suffix = [g], [back[ids].astype(np.int32)], [None], [None]
        at = np.arange(len(ids)) - np.repeat(self.starts, self.lengths)  # place in its text
        key = hashed = one[ids]
        for k in range(2, order + 1):
            before, context = np.empty_like(key), np.empty(len(ids), np.int32)
            before[1:], before[:1] = key[:-1], 0
            context[1:], context[:1] = self.places[-1][:-1], 0
            if k == 2:  # a text starts in the state after an end
                before[self.starts], context[self.starts] = one[0], self.end
            key = _mixed(before * np.uint64(0x9E3779B97F4A7C15) + hashed + np.uint64(k))
            there = np.flatnonzero(at >= k - 2)
            g, first, back = np.unique(key[there], return_index=True, return_inverse=True)
            place = np.full(len(ids), -1, np.int32)
            place[there] = back
            first = there[first]
            self.prefix.append(context[first])
            self.suffix.append(self.places[-1][first])
            self.grams.append(g)
            self.places.append(place)

    def own(self, train: np.ndarray) -> list[np.ndarray]:
        """Occurrences in the texts that ``train`` (a flag per text) takes."""
        on = np.repeat(train, self.lengths)
        return [np.bincount(p[on & (p >= 0)], minlength=len(g)) for p, g in zip(self.places, self.grams, strict=True)]

    def shared(self, rank: int, common: list[np.ndarray]) -> np.ndarray:
        """n-grams whose both parts are in another block too: only these can be there themselves."""
        return common[rank - 1][self.prefix[rank]] & common[rank - 1][self.suffix[rank]]

    def totals(self, own: list[np.ndarray], told: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Training counts, and whether an n-gram is in another block too, of the lengths that were answered."""
        total, common = [], []
        for rank, answers in enumerate(told):
            count, twice = own[rank].astype(np.int64), np.zeros(len(own[rank]), bool)
            some = self.shared(rank, common) if rank > 1 else slice(None)
            count[some], twice[some] = answers >> 1, answers & 1
            total.append(count)
            common.append(twice)
        return total, common


class Automaton:
    """The states and arcs that a block's texts can meet; weights are log10.

    State 0 is the empty context; every n-gram has a number, and is a state if it
    is shorter than the order, and the arc from its prefix's state by its last
    token. ``seen``: it exists; ``arc``: the arc's weight; ``failure``: the
    weight of the state's failure arc, which leads to ``shorter``.
    """

    def __init__(self, block: Block, counts: list[np.ndarray], n: int, v: int, mu: tuple[float, ...], spread: tuple[float, ...] = (0.0,)):
        first = np.cumsum([1, *map(len, block.grams)])
        self.block, self.order = block, len(counts)
        self.seen, self.shorter = np.ones(first[-1], bool), np.zeros(first[-1], np.int32)
        self.arc, self.failure = np.zeros(first[-1]), np.zeros(first[-1])
        with np.errstate(divide="ignore", invalid="ignore"):
            for k, c in enumerate(counts):
                here = slice(first[k], first[k + 1])
                self.seen[here] = c > 0
                if k == 0:
                    self.arc[here] = np.log10((c + 1.0) / (n + v + 1.0))
                else:
                    self.shorter[here] = block.suffix[k] + first[k - 1]
                    before = counts[k - 1][block.prefix[k]].astype(np.float64)
                    m = mu[min(k - 1, len(mu) - 1)] + spread[min(k - 1, len(spread) - 1)] * before
                    self.arc[here] = np.log10((c + m * np.power(10.0, self.arc[self.shorter[here]])) / (before + m))
                if k + 1 < self.order:
                    m = mu[min(k, len(mu) - 1)] + spread[min(k, len(spread) - 1)] * c
                    self.failure[here] = np.log10(m / (c + m))
        block.grams, block.prefix, block.suffix = [], [], []  # done with
        self.numbers = np.stack([p + f for p, f in zip(block.places, first, strict=False)])  # n-gram by length and token
        self.end = block.end + 1

    def base(self) -> np.ndarray:
        return self.arc[self.numbers[0]]

    def _lanes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First token, tokens, and tokens of run-up of each lane."""
        b, run_up = self.block, self.order - 1
        each = np.maximum(1, -(-b.lengths // LANE))
        part = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        early = np.where(part > 0, run_up, 0)
        first = np.repeat(b.starts, each) + part * LANE - early
        size = np.minimum(LANE, np.repeat(b.lengths, each) - part * LANE) + early
        return first, size, early

    def traverse(self) -> np.ndarray:
        """log10 P of each token given those before it."""
        out = np.zeros(self.numbers.shape[1])
        first, size, early = self._lanes()
        by = np.argsort(-size, kind="stable")
        first, size, early = first[by], size[by], early[by]
        start = early == 0
        if self.order > 1 and self.seen[self.end]:
            state, length = np.where(start, self.end, 0), start.astype(np.int64)
        else:
            state, length = np.zeros(len(by), np.int64), np.zeros(len(by), np.int64)
        active = len(by)
        for step in range(int(size[0]) if len(size) else 0):
            active = int(np.searchsorted(-size[:active], -step, "left"))
            at, weight = first[:active] + step, np.zeros(active)
            left = np.arange(active)
            while len(left):
                arc = self.numbers[length[left], at[left]]
                found = self.seen[arc] | (length[left] == 0)
                weight[left[found]] += self.arc[arc[found]]
                left = left[~found]
                weight[left] += self.failure[state[left]]
                state[left] = self.shorter[state[left]]
                length[left] -= 1
            longest = np.minimum(length[:active] + 1, self.order - 1)
            longest = np.where((longest == 1) & ~self.seen[self.numbers[0, at]], 0, longest)
            length[:active] = longest
            state[:active] = np.where(longest > 0, self.numbers[np.maximum(longest - 1, 0), at], 0)
            count = step >= early[:active]
            out[at[count]] = weight[count]
        return out


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """A row per block: its documents' ids, whether they are held out, and their token sequences."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, size = TaskContext.get().partitionId(), 0, 0
        ids, out, texts = [], [], []
        press = zstandard.ZstdCompressor(level=3)

        def block() -> pa.RecordBatch:
            nonlocal made, size
            numbers, lengths, words = tokenised(texts)
            # Packed one by one, so that no two copies of a block's data are held.
            data = [press.compress(x) for x in (numbers.tobytes(), lengths.tobytes(), b" ".join(words))]
            row = [[(task << 24) + made], [ids[:]], [out[:]], *([x] for x in data)]
            kinds = [pa.int64(), pa.list_(id_type), pa.list_(pa.bool_()), *[pa.binary()] * 3]
            made, size = made + 1, 0
            for x in (ids, out, texts):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], ["block", "doc_ids", "held", "numbers", "lengths", "words"])

        for b in batches:
            id_type = b.column(0).type
            for one, h, t in zip(b.column(0), b.column(1), b.column(2), strict=True):
                ids.append(one.as_py())
                out.append(h.as_py())
                texts.append(t.as_py())
                size += len(texts[-1] or "") + 1
                if size >= block_bytes:
                    yield block()
        if texts:
            yield block()

    return docs.select("doc_id", held.alias("held"), "text").mapInArrow(run, f"block long, doc_ids array<{kind}>, held array<boolean>, numbers binary, lengths binary, words binary")


def _loaded(row: dict, order: int) -> tuple[Block, np.ndarray]:
    """A stored block, and which of its texts train."""
    raw = zstandard.ZstdDecompressor()
    words = raw.decompress(row["words"])
    block = Block(np.frombuffer(raw.decompress(row["numbers"]), np.int32), np.frombuffer(raw.decompress(row["lengths"]), np.int32), words.split(b" ") if words else [], order)
    return block, ~np.array(row["held"], bool)


def _questions(number: int, rank: int, keys: np.ndarray, counts: np.ndarray, shards: int) -> list[tuple]:
    cuts = [0, *np.searchsorted(keys, np.array([(i << 64) // shards for i in range(1, shards)], np.uint64)), len(keys)]
    counts = counts.astype(np.int64)
    return [(number, rank, s, _pack(keys[i:j]), _planes(counts[i:j])) for s, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if j > i]


def _merged(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of all questions, their summed counts with whether two blocks ask, each question's places among them, and where questions end.

    Counts go about doubled, plus one for what two blocks or more ask for.
    """
    keys = [_unpack(x.as_py()) for x in t["keys"]]
    asked = np.concatenate([_from_planes(x.as_py(), np.int64) for x in t["counts"]])
    g, back = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(back, asked >> 1, len(g)).astype(np.int64)
    twice = (np.bincount(back, minlength=len(g)) > 1) | (np.bincount(back, asked & 1, len(g)) > 0)
    return g, total * 2 + twice, back, np.cumsum([0, *map(len, keys)])


def summed(asked: DataFrame, blocks: int, parts: int, fan: int) -> DataFrame:
    """Questions (block, rank, shard, keys, counts), of ``parts`` shards -> answers in the order asked; rows of block -1 have a shard's types and tokens.

    Over ``fan`` blocks, the questions of a shard meet in groups of about ``fan``
    blocks, each of which asks for what its blocks ask, in ``fan`` finer shards.
    """

    def answer(t: pa.Table) -> pa.Table:
        _, total, back, ends = _merged(t)
        rank, shard = t["rank"][0].as_py(), t["shard"][0].as_py()
        out = [(b.as_py(), rank, shard, _planes(total[back[i:j]]), 0, 0) for b, i, j in zip(t["block"], ends, ends[1:], strict=False)]
        return _table([*out, (-1, rank, shard, b"", int((total > 1).sum()), int((total >> 1).sum()))], _ANSWERED)

    if blocks <= fan:
        return asked.groupBy("rank", "shard").applyInArrow(answer, _ANSWER)

    def again(t: pa.Table) -> pa.Table:
        g, total, _, _ = _merged(t)
        shard, out = t["shard"][0].as_py(), []
        bounds = np.array([((shard * fan + i) << 64) // (parts * fan) for i in range(1, fan)], np.uint64)
        cuts = [0, *np.searchsorted(g, bounds), len(g)]
        for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if j > i:
                out.append((t["router"][0].as_py(), t["rank"][0].as_py(), shard * fan + k, _pack(g[i:j]), _planes(total[i:j])))
        return _table(out, _ASKED)

    def passed_on(t: pa.Table, a: pa.Table) -> pa.Table:
        if not len(t):
            return _table([], _ANSWERED)
        _, _, back, ends = _merged(t)
        found = a.sort_by("shard")
        total = np.concatenate([_from_planes(x.as_py(), np.int64) for x in found["counts"]])
        rank, shard = t["rank"][0].as_py(), t["shard"][0].as_py()
        return _table([(b.as_py(), rank, shard, _planes(total[back[i:j]]), 0, 0) for b, i, j in zip(t["block"], ends, ends[1:], strict=False)], _ANSWERED)

    groups = -(-blocks // fan)
    routed = stored(asked.withColumn("router", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("long")), "lm-questions")
    finer = routed.groupBy("router", "rank", "shard").applyInArrow(again, _ASK)
    told = stored(summed(finer, groups, parts * fan, fan), "lm-answers")
    back = told.where("block >= 0").select(F.col("block").alias("router"), "rank", F.col("shard").alias("finer"), "counts")
    back = back.select("router", "rank", F.floor(F.col("finer") / fan).cast("long").alias("parent"), F.col("finer").alias("shard"), "counts")
    both = routed.groupBy("router", "rank", "shard").cogroup(back.groupBy("router", "rank", "parent"))
    return both.applyInArrow(passed_on, _ANSWER).unionByName(told.where("block < 0"))


def score(docs: DataFrame, order: int = 3, mu: tuple[float, ...] = MU, spread: tuple[float, ...] = SPREAD, block_bytes: int = 6 << 20, fan: int = 1024) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    blocks = stored(_blocks(docs, block_bytes), "lm-blocks")
    n_blocks = max(1, blocks.count())
    parts = min(n_blocks, fan)

    def answers(a: pa.Table, ranks: int) -> list[np.ndarray]:
        """The answers by rank; nothing was asked of a rank that has none."""
        found: dict[int, list] = {}
        for rank, _, c in sorted(zip(a["rank"].to_pylist(), a["shard"].to_pylist(), a["counts"].to_pylist(), strict=True), key=lambda x: x[:2]):
            found.setdefault(rank, []).append(_from_planes(c, np.int64))
        return [np.concatenate(found.get(rank, [np.zeros(0, np.int64)])) for rank in range(ranks)]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                block, train = _loaded(row, min(2, order))
                for rank, (keys, counts) in enumerate(zip(block.grams, block.own(train), strict=True)):
                    yield from _table(_questions(row["block"], rank, keys, 2 * counts, parts), _ASKED).to_batches()

    asked = blocks.mapInArrow(ask, _ASK)
    told = stored(summed(asked, n_blocks, parts, fan), "lm-counts")
    v, n = (x or 0 for x in told.where("block = -1 and rank = 0").agg(F.sum("types"), F.sum("tokens")).first())

    def ask_more(rank: int):
        def run(d: pa.Table, a: pa.Table) -> pa.Table:
            row = d.to_pylist()[0]
            block, train = _loaded(row, rank + 1)
            own = block.own(train)
            some = block.shared(rank, block.totals(own, answers(a, rank))[1])
            return _table(_questions(row["block"], rank, block.grams[rank][some], 2 * own[rank][some], parts), _ASKED)

        return run

    for rank in range(2, order):
        both = blocks.groupBy("block").cogroup(told.where("block >= 0").groupBy("block"))
        more = summed(both.applyInArrow(ask_more(rank), _ASK), n_blocks, parts, fan)
        told = told.unionByName(stored(more, "lm-counts"))

    def scored(d: pa.Table, a: pa.Table) -> pa.Table:
        row = d.to_pylist()[0]
        b, train = _loaded(row, order)
        counts, _ = b.totals(b.own(train), answers(a, order))
        known = (counts[0] > 0)[b.places[0]].astype(np.int64)
        auto = Automaton(b, counts, n, v, mu, spread)
        del counts, row, a
        over = lambda x: np.add.reduceat(x, b.starts) if len(b.starts) else x[:0]
        return pa.table(
            {
                "doc_id": d["doc_ids"].combine_chunks().flatten(),
                "held_out": ~train,
                "n_tokens": b.lengths,
                "n_known": over(known),
                "train_tokens": np.full(len(b.lengths), n, np.int64),
                "base_score": over(auto.base()),
                "score": over(auto.traverse()),
            }
        )

    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.groupBy("block").cogroup(told.where("block >= 0").groupBy("block")).applyInArrow(scored, schema)

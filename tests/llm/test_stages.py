"""Stages of the pipeline on their own, and parts of operators that several tests share."""

from __future__ import annotations

import collections
import random

import pytest

import corpus_pipeline
from junctura.plans.session import table

from .fixtures import ROWS, docs


@pytest.mark.parametrize("k", range(4))
def test_every_stage_takes_odd_rows(spark, small, k):
    """Nulls in any column, empty and very long texts, ties, repeated rows and clashing names, and an empty table."""
    name, stage = corpus_pipeline.STAGES[k]
    d = docs(spark)
    out = stage(spark, d, small)
    ids = collections.Counter(r.doc_id for r in out.select("doc_id").collect())
    given = collections.Counter(i for i, _ in ROWS)
    if name == "best-fit packing":
        assert set(ids) == set(given) and all(ids[i] >= n for i, n in given.items())
    else:
        assert out.columns == d.columns and all(ids[i] <= given[i] for i in ids)
    if name == "pii surrogates":
        assert ids == given
    if name == "simhash near-dedup":
        assert ids[6] == 0 and ids[1] == 1  # row 6 and its repetition are copies of row 1
    assert stage(spark, docs(spark, []), small).count() == 0


def test_stages_lose_no_clean_document(spark, small):
    d = table(spark, small, "documents")
    assert corpus_pipeline.pii_stage(spark, d, small).count() == d.count()
    packed = corpus_pipeline.packing_stage(spark, d, small)
    assert packed.select("doc_id").distinct().count() == d.select("doc_id").distinct().count()


@pytest.mark.parametrize(
    ("row", "words"),
    [
        ("<form><td>a</td><td>b</td></form>", ["a  b"]),
        ("<center><td>a</td><td>b</td></center>", ["a  b"]),
        ("<form><center>x<td>a</td>y <b>u</b> <i>v</i></center><td>b</td></form>", ["x", "y u v", "a  b"]),
        ("text<td>a</td>more", ["text", "more", "a"]),
        ("<div>text</div>", ["text"]),
        ("<div>one</div><div>two</div><td>a</td>", ["one", "two", "a"]),
        ("<details><summary>s</summary><td>gone</td></details><td>a</td>", ["s", "a"]),
        ("<form style='display:none'><td>gone</td></form><td>a</td>", ["a"]),
        ("<form style='visibility:hidden'>gone<td>gone</td></form><td>a</td>", ["a"]),
        ("<form><table><tr><td>inner</td></tr></table></form><td>a</td>", ["inner", "a"]),
    ],
)
def test_rows_keep_what_is_in_no_cell(row, words):
    from junctura.llm.htmltext import render

    got = [s for s in render(f"<style>div{{color:red}}</style><table><tr>{row}</tr></table>").split("\n") if s]
    assert got == words


def test_deep_rows_take_linear_time():
    from junctura.llm.htmltext import render

    assert render("<table><tr>" + "<form>" * 20_000 + "<td>a").strip() == "a"


@pytest.mark.parametrize("few", [True, False])
def test_the_stage_keeps_what_the_query_keeps(spark, few):
    from junctura.llm import quality

    rng = random.Random(5)
    text = lambda good: " ".join(rng.choice(["plain", "words", "here"] if good else ["#@!", "%%%", "1$"]) for _ in range(30))
    docs = [(i, text(i % 2), "en", f"http://h{i % 5}.x/p{i % 40}") for i in range(200)] + [(1000 + i, text(i % 2), "en", f"http://h1.x/only{i}") for i in range(20)]
    labels = [(i, i % 2) for i in range(0, 200, 3)] + [(1000 + i, 1 - i % 2) for i in range(20)] + [(1000, 1), (None, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    y = spark.createDataFrame(labels, "doc_id long, quality int")
    want = {r.doc_id for r in quality.classified(d, y).where("keep").collect()}
    got = quality.accepted(d, y, broadcast_rows=10_000 if few else 0)
    assert got.columns == d.columns and {r.doc_id for r in got.collect()} == want and 0 < len(want) < len(docs)


def test_placed_pieces_have_their_ids(spark):
    import zlib

    import numpy as np
    import public_tokenizers

    from junctura.llm import packing

    from .fixtures import ROWS, docs

    path = public_tokenizers.path("word_bpe_49k.json")
    placed = packing.packed(docs(spark), path, capacity=256, shard_pieces=9).cache()
    got = placed.collect()
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    want = [bytes(x) + np.uint32(1).tobytes() for x in packing.WordEncoder(path)([t for _, t in ROWS])]
    text = {}
    for r in sorted(got, key=lambda r: r.start):
        if r.doc_id != 6:
            text[r.doc_id] = text.get(r.doc_id, b"") + r.ids
    assert text == {k: w for (k, _), w in zip(ROWS, want, strict=True) if k != 6} and sum(r.doc_id == 6 for r in got) == 2
    assert sum(len(r.ids) for r in packing.sequences(placed).collect()) == sum(map(len, want))

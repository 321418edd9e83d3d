"""SimHash near-duplicates with pigeonring filtering.

A text (null: empty) is lower-cased in A-Z and cut at ASCII white space; its
word shingles, repeats included, are hashed with XXH64 (seed 42), and a bit of
the 64-bit fingerprint is set where over half the hashes have it. No words give
fingerprint 0; fewer words than a shingle give one shingle of the whole.

Two fingerprints link at ``tau`` (3) or fewer differing bits. With four ring
segments of 16 bits, pigeonring says that a linking pair has a start segment
from which every run of l segments differs in at most l*tau/4 bits: 0, 1, 2 and
3. The first two links of the chain are an equi-join (a 32-bit key and its 16
one-bit neighbours on one side), the other two prune what joined, and only then
is the full distance counted. Distinct fingerprints are compared, not rows.

Keys that over ``dense`` fingerprints share, and their one-bit neighbours, whose
few members would meet all of those, would make squares of pairs. Those go
another exact way, linear in fingerprints: members are hung on hubs. A home
member hangs on every 32-bit remainder within one bit of its own, a probe member
on every one within two (one, where the key already differs). Any two that meet
at a hub with a home member are within three bits of it, and two linked members
always meet, so hanging all on that member keeps components whole.

Nulls: a null id gets a fingerprint and takes part in links; a group's id is its
smallest id that isn't null. Repeated rows stay, each with its own result row.
Very long texts are hashed in blocks of ``BLOCK`` words; texts of equal words tie
and share a fingerprint. Columns besides id and text are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..plans.session import cut

BLOCK = 1 << 15


def fingerprint(text: str | None, shingle: int = 3) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    width = min(shingle, len(words))
    total, ones = len(words) - width + 1, np.zeros(64, np.int64)
    for at in range(0, total, BLOCK):
        part = words[at : min(at + BLOCK, total) + width - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(width)), strict=False))
        h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (signed 64-bit): one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([fingerprint(x.as_py(), shingle) for x in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fps], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _turned(fp: Column, i: int) -> Column:
    """The ring read from segment i: fp rotated left by 16 i bits."""
    return fp if i == 0 else F.shiftleft(fp, 16 * i).bitwiseOR(F.shiftrightunsigned(fp, 64 - 16 * i))


def _keyed(fps: DataFrame, flips: list[int]) -> DataFrame:
    """ring (start segment and its 32-bit key), rest (the other 32 bits), off (bits changed in the key)."""
    rows = []
    for i in range(4):
        t = _turned(F.col("fp"), i)
        key = F.shiftrightunsigned(t, 32)
        rows += [F.struct(key.bitwiseXOR(F.lit(f)).bitwiseOR(F.lit(i << 32)).alias("ring"), F.lit(int(f > 0)).alias("off"), t.bitwiseAND(F.lit(0xFFFFFFFF)).alias("rest")) for f in flips]
    return fps.select("fp", F.explode(F.array(*rows)).alias("k")).select("fp", "k.*")


def link_edges(fps: DataFrame, tau: int = 3, dense: int = 512) -> DataFrame:
    """``fps(fp)`` distinct -> ``(u, v)`` whose components are those of all links at ``tau`` (at most 3) bits."""
    if not 0 <= tau <= 3:
        raise ValueError("four segments of 16 bits serve budgets of 0 to 3 bits")
    home = _keyed(fps, [0])
    probe = _keyed(fps, [0] + [1 << b for b in range(16)])
    # Keys of several home members, and what their members probe: a small table, one in ``dense`` at most, and 16 neighbours.
    large = home.groupBy("ring").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > dense)
    beside = F.transform(F.array(*[F.lit(0), *[F.lit(1 << b) for b in range(16)]]), lambda m: F.col("ring").bitwiseXOR(m))
    crowded = cut(large.select(F.explode(beside).alias("ring")).distinct())
    x = F.col("fp").bitwiseXOR(F.col("fp2"))
    third = F.shiftrightunsigned(F.col("rest").bitwiseXOR(F.col("rest2")), 16)
    chain = F.col("off2") + F.bit_count(third) <= F.lit(3 * tau // 4)
    lone = F.col("fp") < F.col("fp2")
    sparse = home.join(crowded, "ring", "left_anti") if (any_crowded := not crowded.isEmpty()) else home
    other = probe.select(F.col("fp").alias("fp2"), "ring", F.col("off").alias("off2"), F.col("rest").alias("rest2"))
    # A pair may show its chain from either side, so both orders stay; the smaller first makes repeats equal.
    pairs = sparse.join(other, (sparse["ring"] == other["ring"]) & (F.col("fp") != F.col("fp2")) & chain & (F.bit_count(x) <= tau))
    out = pairs.select(F.least("fp", "fp2").alias("u"), F.greatest("fp", "fp2").alias("v"))
    return out.unionByName(_dense_edges(home, probe, crowded, tau)) if any_crowded else out


def _near(rest: Column, bits: int) -> list[Column]:
    """(remainder within ``bits`` changed bits) of the 32-bit remainder."""
    masks = [0] + [1 << a for a in range(32)] * (bits > 0) + [(1 << a) | (1 << b) for a in range(32) for b in range(a)] * (bits > 1)
    return F.transform(F.array(*[F.lit(m) for m in masks]), lambda m: rest.bitwiseXOR(m))


def _dense_edges(home: DataFrame, probe: DataFrame, crowded: DataFrame, tau: int) -> DataFrame:
    # A row becomes up to 529 below, so rows are spread over tasks by themselves before, not by their keys.
    tasks = max(int(home.sparkSession.conf.get("spark.sql.shuffle.partitions")), home.sparkSession.sparkContext.defaultParallelism)
    h, p = (d.join(crowded, "ring", "left_semi").repartition(tasks, "ring", "fp") for d in (home, probe))
    centre, same, turned = min(1, tau), max(0, tau - 1), max(0, tau - 2)
    a = h.select("ring", "fp", F.lit(True).alias("home"), F.explode(_near(F.col("rest"), centre)).alias("hub"))
    b = p.where("off = 0").select("ring", "fp", F.lit(False).alias("home"), F.explode(_near(F.col("rest"), same)).alias("hub"))
    out = [a, b]
    if tau > 0:
        out.append(p.where("off = 1").select("ring", "fp", F.lit(False).alias("home"), F.explode(_near(F.col("rest"), turned)).alias("hub")))
    rows = out[0]
    for d in out[1:]:
        rows = rows.unionByName(d)
    mid = a.groupBy("ring", "hub").agg(F.min("fp").alias("v"))
    return rows.join(mid, ["ring", "hub"]).where("fp <> v").select(F.least("fp", "v").alias("u"), F.greatest("fp", "v").alias("v"))


def near_duplicates(docs: DataFrame, tau: int = 3, shingle: int = 3, dense: int = 512) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable over links of at most ``tau`` bits)."""
    rows = cut(fingerprints(docs, shingle))
    own = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    comp = connected_components(link_edges(own.select("fp"), tau, dense))
    named = own.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    low = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of = named.join(low, "component").select("fp", "component_id")
    return rows.join(of, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, tau: int = 3, shingle: int = 3) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: that of the smallest id.

    Rows whose id is null stay only if their component has no other id, one of them.
    Of rows with the same kept id one stays.
    """
    near = cut(near_duplicates(docs, tau, shingle))
    ids = near.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    one = docs.join(ids.where("n = 1").select("doc_id"), "doc_id", "left_semi")
    many = docs.join(ids.where("n > 1").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    bare = near.where("component_id is null").select("fp").distinct()
    if not bare.isEmpty():
        lone = docs.where("doc_id is null")
        same = fingerprints(lone.withColumn("doc_id", F.col("text")), shingle).withColumnRenamed("doc_id", "text").join(bare, "fp", "left_semi")
        comp = connected_components(link_edges(bare, tau)).withColumnRenamed("node", "fp")
        pick = same.join(comp, "fp", "left").groupBy(F.coalesce("component", "fp").alias("c")).agg(F.min("text").alias("text"))
        many = many.unionByName(lone.join(pick.select("text"), lone["text"].eqNullSafe(pick["text"]), "left_semi").dropDuplicates(["text"]))
    return one.unionByName(many).select(*docs.columns)

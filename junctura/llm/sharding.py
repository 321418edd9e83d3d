"""Shards by fixed virtual slots and a versioned slot map (DataFrame functions only).

A row's slot is a hash of its doc_id modulo a fixed number of slots, which never
changes. Bytes are summed by slot, and a table maps slots to shards, one version after
another: the first deals slots out, the largest first, each to the shard with the
least; a later one (more or fewer shards, or other sizes) keeps a slot where it is
unless its shard would get more than its share, and deals out only the rest. So the
bytes of shards are near equal (the law ``bytes``), and a new shard costs about its own
share of moves.

A slot with over ``HOT`` of a shard's share (a repeated id can hold a third of all rows) is in
parts by a row's number in its input; the map has a line for each part. The map has at
most slots + shards x (share / HOT) lines, so the fold that deals them out is one row of
fixed size, and so is what is broadcast.

``slot`` is a row's place within its shard: the rows of the map's lines before its own,
then its number in its line, so no window holds a whole shard. A null text has no
bytes, a null id hashes to a slot of its own, repeated rows are placed each, other
columns are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import stored

SLOTS, HOT = 8192, 16


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and a number of the row, stored."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("row"))
    return stored(rows, "sized")


def slotted(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    return rows.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id"), F.lit(slots)).cast("int"))


def slot_sizes(rows: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """virtual_slot, parts, part, size: bytes by slot, hot slots in parts."""
    by_slot = rows.groupBy("virtual_slot").agg(F.sum("size").alias("size"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot")).join(by_slot, "virtual_slot", "left").na.fill(0, ["size"])
    share = every.agg((F.sum("size") / shards / HOT).alias("most"))
    parts = every.join(F.broadcast(share)).select("virtual_slot", F.greatest(F.lit(1), F.ceil(F.col("size") / F.greatest("most", F.lit(1.0)))).cast("int").alias("parts"))
    placed = in_part(rows.join(F.broadcast(parts), "virtual_slot")).groupBy("virtual_slot", "part").agg(F.sum("size").alias("size"))
    lines = parts.withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    return lines.join(placed, ["virtual_slot", "part"], "left").na.fill(0, ["size"])


def in_part(rows: DataFrame) -> DataFrame:
    part = F.when(F.col("parts") == 1, 0).otherwise(F.pmod(F.xxhash64("row"), F.col("parts")))
    return rows.withColumn("part", part.cast("int"))


def _dealt(lines: DataFrame, shards: int) -> DataFrame:
    """``lines`` with a shard: those that have ``kept`` keep it, the others go to the least loaded, the largest first."""
    line = F.struct((-F.col("size")).alias("less"), "virtual_slot", "part")
    free = F.array_sort(F.collect_list(F.when(F.col("kept").isNull(), line)))
    held = F.collect_list(F.when(F.col("kept").isNotNull(), F.struct("kept", "size")))
    one = lines.agg(free.alias("free"), held.alias("held"))
    empty = F.array_repeat(F.lit(0).cast("long"), shards)
    loads = F.aggregate("held", empty, lambda acc, x: F.transform(acc, lambda v, i: F.when(i == x["kept"], v + x["size"]).otherwise(v)))

    def step(state: Column, x: Column) -> Column:
        at = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        return F.struct(
            F.transform(state["loads"], lambda v, i: F.when(i == at, v - x["less"]).otherwise(v)).alias("loads"),
            F.concat(state["taken"], F.array(at)).alias("taken"),
        )

    dealt = F.aggregate("free", F.struct(F.col("loads"), F.array().cast("array<int>").alias("taken")), step)["taken"]
    shard_of = one.withColumn("loads", loads).select(F.explode(F.arrays_zip("free", dealt.alias("taken"))).alias("x"))
    to = shard_of.select("x.free.virtual_slot", "x.free.part", F.col("x.taken").alias("shard"))
    return lines.join(to, ["virtual_slot", "part"], "left").withColumn("shard", F.coalesce("kept", "shard")).drop("kept")


def first_map(sizes: DataFrame, shards: int) -> DataFrame:
    """version 1: virtual_slot, parts, part, size, shard."""
    return _dealt(sizes.withColumn("kept", F.lit(None).cast("int")), shards).withColumn("version", F.lit(1))


def next_map(last: DataFrame, shards: int, sizes: DataFrame | None = None) -> DataFrame:
    """The version after ``last`` for ``shards`` shards, with ``sizes`` where these have changed.

    In each shard lines are kept, the largest first, while they stay within an equal
    share of all bytes; the others, and those of shards that are no more, are dealt out.
    """
    lines = last
    if sizes is not None:
        before = last.select("virtual_slot", "part", "shard", "version")
        lines = sizes.join(before, ["virtual_slot", "part"], "left")
    version = last.agg((F.max("version") + 1).alias("version"))
    share = lines.agg((F.sum("size") / shards).alias("share"))
    run = Window.partitionBy("shard").orderBy(F.desc("size"), "virtual_slot", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = lines.drop("version").withColumn("__sum", F.sum("size").over(run)).join(F.broadcast(share))
    keeps = (F.col("__sum") <= F.col("share")) & (F.col("shard") < shards)
    edited = held.withColumn("kept", F.when(keeps, F.col("shard"))).drop("__sum", "share", "shard")
    return _dealt(edited, shards).join(F.broadcast(version))


def assigned(rows: DataFrame, maps: DataFrame, version: int) -> DataFrame:
    """``rows`` (with virtual_slot) with shard and slot, their place within it, by one version of the map."""
    lines = maps.where(F.col("version") == version).select("virtual_slot", "parts", "part", "shard")
    placed = in_part(rows.join(F.broadcast(lines.select("virtual_slot", "parts").distinct()), "virtual_slot"))
    counts = placed.groupBy("virtual_slot", "part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = lines.join(counts, ["virtual_slot", "part"], "left").withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    within = Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "row")
    joined = placed.withColumn("__no", F.row_number().over(within)).join(F.broadcast(starts.select("virtual_slot", "part", "shard", "__start")), ["virtual_slot", "part"])
    return joined.withColumn("slot", (F.col("__start") + F.col("__no") - 1).cast("long")).drop("__start", "__no", "parts")


def sharded(docs: DataFrame, shards: int = 24, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null), virtual_slot, and next_shard with one shard more."""
    rows = slotted(sized(docs), slots)
    sizes = stored(slot_sizes(rows, shards, slots), "slot-sizes")
    first = stored(first_map(sizes, shards), "slot-map-1")
    maps = first.unionByName(stored(next_map(first, shards + 1), "slot-map-2"))
    now = assigned(rows, maps, 1)
    later = maps.where("version = 2").select("virtual_slot", "part", F.col("shard").alias("next_shard"))
    out = now.join(F.broadcast(later), ["virtual_slot", "part"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "next_shard")

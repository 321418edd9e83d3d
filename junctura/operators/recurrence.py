"""Recurrence of events over libraries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import stored


def gene_keys(events: DataFrame) -> DataFrame:
    """Events with gene_key, the sorted distinct genes of both sides."""
    return events.withColumn("gene_key", F.array_sort(F.array_union("genes_a", "genes_b")))


def merged_keys(keyed: DataFrame, most: int = 10) -> DataFrame:
    """Keys of a type with the largest key of that type that contains each (of several, the first by text).

    Keys are numbered in that order. A key of up to ``most`` genes is a row for each of its subsets, and the
    least number of a subset that is a key is its container: one aggregation, linear in keys however many share
    genes. Larger keys, which are few, are looked up by the first two genes (the one gene) of what they may contain.
    Keys are many times as large in memory as in the files they are stored in, so no join here broadcasts them by file size.
    """
    order = [F.size("gene_key").desc(), F.array_join("gene_key", ","), F.col("gene_key"), F.col("event_type")]
    keys = keyed.select("event_type", "gene_key").distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    keys = stored(keys.withColumn("no", F.monotonically_increasing_id()), "keys")
    few = keys.where(F.size("gene_key").between(1, most)).withColumn("__m", F.explode(F.expr("sequence(1, shiftleft(1, size(gene_key)) - 1)")))
    sub = F.to_json(F.expr("filter(gene_key, (g, i) -> (shiftright(__m, i) & 1) = 1)"))
    sets = few.select("event_type", sub.alias("sub"), "no", F.expr("CASE WHEN __m = shiftleft(1, size(gene_key)) - 1 THEN no END").alias("own"))
    pairs = F.flatten(F.transform("gene_key", lambda a, i: F.transform(F.slice("gene_key", i + 2, F.size("gene_key")), lambda b: F.concat(a, F.lit("\x01"), b))))
    big = keys.where(F.size("gene_key") > most).select("event_type", F.col("gene_key").alias("big"), F.col("no").alias("big_no"), F.explode(F.concat("gene_key", pairs)).alias("g"))
    probe = keys.withColumn("g", F.array_join(F.slice("gene_key", 1, 2), "\x01"))
    inside = probe.join(big.hint("merge"), ["event_type", "g"]).where(F.size(F.array_except("gene_key", "big")) == 0)
    rows = sets.unionByName(inside.select("event_type", F.to_json("gene_key").alias("sub"), F.col("big_no").alias("no"), F.col("no").alias("own")))
    best = rows.groupBy("event_type", "sub").agg(F.min("no").alias("no"), F.max("own").alias("own")).where("own IS NOT NULL")
    named = best.select("own", "no").join(keys.select(F.col("no").alias("own"), "event_type", "gene_key").hint("merge"), "own")
    return named.join(keys.select("no", F.col("gene_key").alias("key")).hint("merge"), "no").select("event_type", "gene_key", "key")


def recurrence(keyed: DataFrame) -> DataFrame:
    """event_type, key, libraries (sorted), n_libraries, n_events, recurrent (over one library)."""
    keyed = stored(keyed.select("event_type", "gene_key", "lib"), "keyed")  # read twice below
    m = keyed.join(merged_keys(keyed).hint("merge"), ["event_type", "gene_key"])
    g = m.groupBy("event_type", "key").agg(F.array_sort(F.collect_set("lib")).alias("libraries"), F.count(F.lit(1)).alias("n_events"))
    return g.withColumn("n_libraries", F.size("libraries")).withColumn("recurrent", F.size("libraries") > 1)


def recurrence_totals(keyed: DataFrame) -> DataFrame:
    """Per type and library, and over all libraries (lib is null): predictions (distinct gene_key of a library), genes (merged keys), and how many of each recur."""
    keyed = stored(keyed.select("event_type", "gene_key", "lib").distinct(), "keyed")
    m = keyed.join(merged_keys(keyed).hint("merge"), ["event_type", "gene_key"])
    # Few distinct keys and libraries are left to count, so nothing is expanded for several distinct counts at once.
    by_key = stored(m.groupBy("event_type", "key", "lib").agg(F.count(F.lit(1)).alias("__n")), "by-key")
    again = by_key.groupBy("event_type", "key").agg((F.count(F.lit(1)) > 1).alias("__again"))
    k = by_key.join(again.hint("merge"), ["event_type", "key"])
    some = lambda c: F.sum(F.when(F.col("__again"), c).otherwise(0))
    counts_ = [F.sum("__n").alias("n_predictions"), some(F.col("__n")).alias("n_recurrent_predictions"), F.count(F.lit(1)).alias("n_genes"), some(F.lit(1)).alias("n_recurrent_genes")]
    each = k.groupBy("event_type", "lib").agg(*counts_)
    whole = k.groupBy("event_type", "key", "__again").agg(F.sum("__n").alias("__n")).groupBy("event_type").agg(*counts_)
    return each.unionByName(whole.withColumn("lib", F.lit(None).cast("string")))


def split_recurrent(keyed: DataFrame) -> DataFrame:
    """Events with recurrent."""
    keyed = stored(keyed, "keyed")
    merged = stored(merged_keys(keyed), "merged")
    r = keyed.join(merged.hint("merge"), ["event_type", "gene_key"]).groupBy("event_type", "key").agg(F.coalesce(F.min("lib") < F.max("lib"), F.lit(False)).alias("recurrent"))
    named = merged.join(r.hint("merge"), ["event_type", "key"])
    return keyed.join(named.hint("merge"), ["event_type", "gene_key"])


def counts(keyed: DataFrame) -> DataFrame:
    """Events, distinct genes and the sorted list of these per type and library, and over all libraries (lib is null)."""
    # Events are counted without a row for each of their genes, and genes are few once distinct.
    some = stored(keyed.where("event_type IS NOT NULL AND size(gene_key) > 0").select("event_type", "lib", "event_id", "gene_key"), "keyed")
    genes = stored(some.select("event_type", "lib", F.explode("gene_key").alias("gene")).distinct(), "genes")

    def level(lib):
        n = some.groupBy("event_type", lib.alias("lib")).agg(F.countDistinct("event_id").alias("n_events"))
        g = genes.groupBy(F.col("event_type").alias("__type"), lib.alias("__lib")).agg(F.array_sort(F.collect_set("gene")).alias("genes"))
        return n.join(g, (F.col("event_type") == F.col("__type")) & F.col("lib").eqNullSafe(F.col("__lib"))).drop("__type", "__lib")

    return level(F.col("lib")).unionByName(level(F.lit(None).cast(keyed.schema["lib"].dataType))).withColumn("n_genes", F.size("genes").cast("long"))

"""Readers of alignment, annotation, sequence, event and other callers' text formats.

All read with Spark's text source and column functions, so files are split and
read in parallel; coordinates become 1-based and closed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BLOCKS = "array<struct<s:bigint,e:bigint>>"


def _lines(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    r = spark.read
    return (r.option("lineSep", sep) if sep else r).text(path)


def _list(c: Column) -> Column:
    """A comma list (a trailing comma allowed) of numbers."""
    return F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("long"))


def _paired(starts: Column, sizes: Column) -> Column:
    """Blocks of 0-based starts and sizes."""
    return F.zip_with(starts, sizes, lambda a, n: F.struct((a + 1).alias("s"), (a + n).alias("e")))


PSL = "match mismatch repmatch ncount qnuminsert qbaseinsert tnuminsert tbaseinsert strand query query_len qstart qend target target_len tstart tend n_blocks".split()


def read_psl(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of a PSL file; header lines and repeated lines are dropped.

    Query blocks of minus-strand alignments are turned to the contig's own direction.
    """
    f = F.split("value", "\t")
    rows = _lines(spark, path).where(F.col("value").rlike("^[0-9]")).distinct().where(F.size(f) >= 21)
    text = {"strand", "query", "target"}
    cols = [f[i].alias(c) if c in text else f[i].cast("long").alias(c) for i, c in enumerate(PSL)]
    d = rows.select(*cols, _list(f[18]).alias("sizes"), _list(f[19]).alias("qs"), _list(f[20]).alias("ts"))
    q = _paired(F.col("qs"), F.col("sizes"))
    turned = F.reverse(F.transform(q, lambda b: F.struct((F.col("query_len") - b["e"] + 1).alias("s"), (F.col("query_len") - b["s"] + 1).alias("e"))))
    d = d.withColumn("blocks", _paired(F.col("ts"), F.col("sizes"))).withColumn("query_blocks", F.when(F.col("strand").startswith("-"), turned).otherwise(q))
    return d.withColumn("qstart", F.col("qstart") + 1).withColumn("tstart", F.col("tstart") + 1).drop("sizes", "qs", "ts")


def read_exonerate(spark: SparkSession, path: str) -> DataFrame:
    """Records that start with ``C4 Alignment:``; minus where the target range falls; blocks from gff exon lines."""
    rows = _lines(spark, path, "C4 Alignment:").where(F.col("value").contains("Query range:"))
    one = lambda p: F.regexp_extract("value", p, 1)
    num = lambda p: one(p).cast("long")
    exons = F.regexp_extract_all("value", F.lit(r"\t(?:exon|similarity)\t([0-9]+\t[0-9]+)\t"), F.lit(1))
    blocks = F.array_sort(F.transform(exons, lambda x: F.struct(F.split(x, "\t")[0].cast("long").alias("s"), F.split(x, "\t")[1].cast("long").alias("e"))))
    a, b = num(r"Target range: ([0-9]+) ->"), num(r"Target range: [0-9]+ -> ([0-9]+)")
    return rows.select(
        one(r"Query: (\S+)").alias("query"), one(r"Target: (\S+)").alias("target"), num(r"Raw score: ([0-9]+)").alias("score"),
        (num(r"Query range: ([0-9]+) ->") + 1).alias("qstart"), num(r"Query range: [0-9]+ -> ([0-9]+)").alias("qend"),
        F.when(a > b, "-").otherwise("+").alias("strand"), (F.least(a, b) + 1).alias("tleft"), F.greatest(a, b).alias("tright"), blocks.alias("blocks"),
    )


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Reads with ``tags`` as a map and ``number`` from the flag; a /1 or /2 is taken off the name."""
    f = F.split("value", "\t")
    names = "qname flag rname pos mapq cigar mrnm mpos isize seq qual".split()
    ints = {"flag", "pos", "mapq", "mpos", "isize"}
    cols = [f[i].cast("int").alias(c) if c in ints else f[i].alias(c) for i, c in enumerate(names)]
    tags = F.map_from_entries(F.transform(F.slice(f, F.lit(12), F.size(f)), lambda t: F.struct(F.substring(t, 1, 2), F.substring(t, F.lit(6), F.length(t)))))
    d = _lines(spark, path).where(~F.col("value").startswith("@") & (F.size(f) >= 11)).select(*cols, tags.alias("tags"))
    return d.withColumn("qname", F.regexp_replace("qname", "/[12]$", "")).withColumn("number", F.when(F.col("flag").bitwiseAND(F.lit(0x80)) > 0, 2).otherwise(1))


#: Field numbers of each layout: transcript, gene, chrom, strand, tx, cds, exon starts and ends.
DIALECTS = {
    "ensembl": (1, 12, 2, 3, 4, 5, 6, 7, 9, 10),
    "refseq": (1, 12, 2, 3, 4, 5, 6, 7, 9, 10),
    "knowngene": (0, 10, 1, 2, 3, 4, 5, 6, 8, 9),
    "aceview": (0, 10, 1, 2, 3, 4, 5, 6, 8, 9),
    "ensg": (0, 11, 1, 2, 3, 4, 5, 6, 8, 9),
}


def read_gene_pred(spark: SparkSession, path: str, dialect: str) -> DataFrame:
    """transcript, gene, chrom, strand, tx_s, tx_e, cds_s, cds_e, exons of a genePred layout."""
    at = DIALECTS[dialect]
    f = F.split("value", "\t")
    d = _lines(spark, path).where(~F.col("value").startswith("#")).select(*[f[i].alias(n) for i, n in zip(at, "transcript gene chrom strand tx_s tx_e cds_s cds_e starts ends".split(), strict=True)])
    exons = F.zip_with(_list(F.col("starts")), _list(F.col("ends")), lambda a, b: F.struct((a + 1).alias("s"), b.alias("e")))
    num = lambda c, add: (F.col(c).cast("long") + add).alias(c)
    return d.select("transcript", "gene", "chrom", "strand", num("tx_s", 1), num("tx_e", 0), num("cds_s", 1), num("cds_e", 0), exons.alias("exons"))


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """Exon and CDS lines as transcripts; conflict: chromosome, strand or gene differ within one. No CDS: cds_e is tx_s, non-coding."""
    f = F.split("value", "\t")
    attr = lambda k: F.regexp_extract(f[8], k + r' "([^"]*)"', 1)
    d = _lines(spark, path).where((F.size(f) >= 9) & f[2].isin("exon", "CDS")).select(
        f[0].alias("chrom"), f[2].alias("kind"), f[3].cast("long").alias("s"), f[4].cast("long").alias("e"), f[6].alias("strand"), attr("gene_id").alias("gene"), attr("transcript_id").alias("transcript")
    )
    exon, cds = F.col("kind") == "exon", F.col("kind") == "CDS"
    g = d.groupBy("transcript").agg(
        F.min("gene").alias("gene"), F.min("chrom").alias("chrom"), F.min("strand").alias("strand"),
        F.min("s").alias("tx_s"), F.max("e").alias("tx_e"), F.min(F.when(cds, F.col("s"))).alias("cds_s"), F.max(F.when(cds, F.col("e"))).alias("cds_e"),
        F.array_sort(F.collect_set(F.when(exon, F.struct("s", "e")))).alias("exons"),
        ((F.min("gene") != F.max("gene")) | (F.min("chrom") != F.max("chrom")) | (F.min("strand") != F.max("strand"))).alias("conflict"),
    )
    return g.withColumn("cds_e", F.coalesce("cds_e", "tx_s")).withColumn("cds_s", F.coalesce("cds_s", "tx_s"))


def read_fasta(spark: SparkSession, path: str, upper: bool = True) -> DataFrame:
    """id (to the first space), extra, sequence."""
    rows = _lines(spark, path, ">").where(F.trim("value") != "")
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    seq = F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s", "")
    return rows.select(F.regexp_extract(head, r"^(\S*)", 1).alias("id"), F.trim(F.regexp_replace(head, r"^\S*", "")).alias("extra"), (F.upper(seq) if upper else seq).alias("sequence"))


def read_groups(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Event and member rows of blank-line separated groups: ids, KEY:value tokens as a map, and the rest as ``tail``."""
    rows = _lines(spark, path, "\n\n").where(F.trim("value") != "").select(F.split(F.trim("value"), "\n").alias("l"))

    def parsed(d: DataFrame, c: Column) -> DataFrame:
        tokens = F.split(c, " +")
        pairs = F.filter(tokens, lambda t: t.rlike("^[A-Za-z_]+:"))
        entries = F.transform(pairs, lambda t: F.struct(F.substring_index(t, ":", 1), F.regexp_replace(t, "^[A-Za-z_]+:", "")))
        return d.withColumn("fields", F.map_from_entries(F.array_distinct(entries))).withColumn("tail", F.array_join(F.filter(F.slice(tokens, F.lit(2), F.size(tokens)), lambda t: ~t.rlike("^[A-Za-z_]+:")), " "))

    number = F.regexp_extract(F.col("l")[0], r"^(?:GRP:?)?\s*([0-9]+)", 1).cast("long").alias("group_id")
    events = parsed(rows.select(number, F.col("l")[0].alias("line")), F.col("line"))
    m = rows.select(number, F.posexplode(F.slice("l", F.lit(2), F.size("l"))).alias("k", "line"))
    members = parsed(m.withColumn("member_id", F.regexp_extract("line", r"^[0-9]*([a-z]+)", 1)), F.col("line"))
    return events.drop("line"), members.drop("line", "k")


def read_coords(spark: SparkSession, path: str) -> DataFrame:
    """``chrom start end label...`` lines."""
    p = r"^(\S+)\s+(-?[0-9]+)\s+(-?[0-9]+)\s*(.*)$"
    x = lambda i: F.regexp_extract("value", p, i)
    return _lines(spark, path).where(F.col("value").rlike(p)).select(x(1).alias("chrom"), x(2).cast("long").alias("s"), x(3).cast("long").alias("e"), x(4).alias("label"))


def read_libraries(spark: SparkSession, path: str, template: str) -> DataFrame:
    """lib, assembly_ver, output_ver and path: the fourth field, or ``template`` with {lib}, {assembly} and {output} filled in."""
    f = F.transform(F.split("value", ","), lambda x: F.trim(x))
    d = _lines(spark, path).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    version = lambda c: F.when(c.startswith("ver_"), c).otherwise(F.concat(F.lit("ver_"), c))
    d = d.select(f[0].alias("lib"), version(f[1]).alias("assembly_ver"), version(f[2]).alias("output_ver"), F.get(f, 3).alias("given"))
    made = F.replace(F.replace(F.replace(F.lit(template), F.lit("{lib}"), F.col("lib")), F.lit("{assembly}"), F.col("assembly_ver")), F.lit("{output}"), F.col("output_ver"))
    return d.select("lib", "assembly_ver", "output_ver", F.coalesce(F.nullif("given", F.lit("")), made).alias("path"))


def read_defuse(spark: SparkSession, path: str) -> DataFrame:
    """A header-named tab table; Y flags become booleans, and the place of the breakpoint in the split sequence a number."""
    d = spark.read.option("sep", "\t").option("header", True).csv(path)
    flags = [c for c in ("adjacent", "altsplice", "deletion", "eversion", "inversion", "read_through", "interchromosomal") if c in d.columns]
    d = d.withColumns({c: F.col(c) == "Y" for c in flags} | {c: F.col(c).cast("long") for c in ("genomic_break_pos1", "genomic_break_pos2") if c in d.columns} | {"probability": F.col("probability").cast("double")})
    return d.withColumn("break_in_sequence", F.instr("splitr_sequence", "|"))


def read_tophat_fusion(spark: SparkSession, path: str) -> DataFrame:
    """Six-line records that start with ``allAtOnce``: chromosomes, coordinates, strands, reads, genes."""
    rows = _lines(spark, path, "allAtOnce").where(F.col("value").rlike(r"\S+-\S+"))
    head = r"^\s*([^\s-]+)-(\S+)\s+([0-9]+)\s+([0-9]+)\s+([fr])([fr])\s+([0-9]+)"
    x = lambda i: F.regexp_extract("value", head, i)
    lines = F.split(F.regexp_replace("value", r"\s+$", ""), "\n")
    genes = F.split(F.trim(F.element_at(lines, -1)), r"\s+")
    strand = lambda c: F.when(c == "f", "+").otherwise("-")
    return rows.select(
        x(1).alias("chrom_a"), x(2).alias("chrom_b"), x(3).cast("long").alias("coord_a"), x(4).cast("long").alias("coord_b"),
        strand(x(5)).alias("strand_a"), strand(x(6)).alias("strand_b"), x(7).cast("long").alias("reads"), F.get(genes, 0).alias("gene1"), F.get(genes, 1).alias("gene2"),
    )


def build_annotation_reference(known: DataFrame, xref: DataFrame, ensembl: DataFrame, names: DataFrame, repeats: DataFrame) -> dict[str, DataFrame]:
    """genes (known with names), transcripts (ensembl with names where there are any), repeats projected, and the RNA ones."""
    labels = repeats.select("chrom", "s", "e", F.concat_ws("_", "name", "class").alias("label"))
    return {
        "genes": known.join(xref, "transcript"),
        "transcripts": ensembl.join(names, "transcript", "left"),
        "repeats": labels,
        "structural_rna": labels.where(F.col("label").rlike("RNA")),
    }

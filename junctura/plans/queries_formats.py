"""Queries of readers and writers: tables written as text into the shared folder and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import readers as R
from ..sources import writers as W
from . import fixtures
from .queries_candidates import BP_SQL, aln, junctions
from .registry import query
from .session import shared_dir


def as_text(lines: DataFrame, name: str) -> str:
    """Write the ``value`` column into a new folder; its path."""
    path = f"{shared_dir(lines.sparkSession).rstrip('/')}/junctura-{name}-{uuid.uuid4().hex}"
    lines.select("value").write.text(path)
    return path


def joined(df: DataFrame, *exprs: str, sep: str = "\t") -> DataFrame:
    return df.select(F.concat_ws(sep, *[F.expr(e).cast("string") for e in exprs]).alias("value"))


@query("s01_read_psl", "aln", "SELECT DISTINCT CAST(query AS VARCHAR)||'_'||aln_no AS query, qstart, qend, tleft AS tstart, tright AS tend, strand, CASE WHEN strand='-' THEN qend-19 ELSE qstart END AS first_q, tleft+19 AS first_t FROM aln")
def _(spark, d):
    lines = joined(
        aln(spark, d), "qend-qstart+1-mismatch", "mismatch", "0", "0", "0", "0", "1", "5", "strand", "concat(query,'_',aln_no)", "query_len", "qstart-1", "qend", "concat('chr',chrom)", "1000000", "tleft-1", "tright", "2",
        "concat('20,', qend-qstart-19, ',')", "CASE WHEN strand='-' THEN concat(query_len-qend,',',query_len-qend+20,',') ELSE concat(qstart-1,',',qstart+19,',') END", "concat(tleft-1,',',tleft+24,',')",
    )
    p = R.read_psl(spark, as_text(lines, "psl"))
    first = F.when(F.col("strand") == "-", F.element_at("query_blocks", -1)["s"]).otherwise(F.col("query_blocks")[0]["s"])
    return p.select("query", "qstart", "qend", "tstart", "tend", "strand", first.alias("first_q"), F.col("blocks")[0]["e"].alias("first_t"))


@query("s03_read_sam", "reads", "SELECT 'r'||CAST(read_id//2 AS VARCHAR) AS qname, CAST(read_id%2+1 AS INT) AS number, rleft AS pos, mapq, CAST(nm AS VARCHAR) AS nm FROM reads")
def _(spark, d):
    r = fixtures.view(spark, d, fixtures.READS)
    lines = joined(r, "concat('r',read_id div 2,'/',read_id%2+1)", "CASE WHEN read_id%2=1 THEN 129 ELSE 65 END", "concat('c',contig)", "rleft", "mapq", "'75M'", "'='", "1", "0", "'ACGT'", "'IIII'", "concat('NM:i:',nm)", "'XT:A:U'")
    s = R.read_sam(spark, as_text(lines, "sam"))
    return s.select("qname", "number", F.col("pos").cast("long").alias("pos"), "mapq", F.col("tags")["NM"].alias("nm"))


@query("s04_read_gene_pred", "feat", "SELECT 'T'||feat_id AS transcript, gene, fstart AS tx_s, fend AS tx_e, fstart+5 AS cds_s, fstart+14 AS first_e FROM feat")
def _(spark, d):
    f = fixtures.view(spark, d, fixtures.FEAT)
    lines = joined(f, "0", "concat('T',feat_id)", "concat('chr',chrom)", "strand", "fstart-1", "fend", "fstart+4", "fend-3", "2", "concat(fstart-1,',',fstart+19,',')", "concat(fstart+14,',',fend,',')", "0", "gene", "'cmpl'", "'cmpl'", "'0,'")
    g = R.read_gene_pred(spark, as_text(lines, "genepred"), "ensembl")
    return g.select("transcript", "gene", "tx_s", "tx_e", "cds_s", F.col("exons")[0]["e"].alias("first_e"))


@query("s05_read_gtf", "feat", "SELECT 'T'||feat_id AS transcript, gene, fstart AS tx_s, fend+40 AS tx_e, CASE WHEN feat_id%3=0 THEN fstart ELSE fstart+5 END AS cds_s, CASE WHEN feat_id%3=0 THEN fstart ELSE fstart+9 END AS cds_e, 2 AS n_exons, false AS conflict FROM feat")
def _(spark, d):
    f = fixtures.view(spark, d, fixtures.FEAT)
    attr = "concat('gene_id \"',gene,'\"; transcript_id \"T',feat_id,'\";')"
    line = lambda kind, s, e: joined(f.where("feat_id%3<>0") if kind == "CDS" else f, "concat('chr',chrom)", "'x'", f"'{kind}'", s, e, "'.'", "strand", "'.'", attr)
    lines = line("exon", "fstart", "fstart+14").unionByName(line("exon", "fend", "fend+40")).unionByName(line("CDS", "fstart+5", "fstart+9"))
    g = R.read_gtf(spark, as_text(lines, "gtf"))
    return g.select("transcript", "gene", "tx_s", "tx_e", "cds_s", "cds_e", F.size("exons").alias("n_exons"), "conflict")


@query("s06_read_fasta", "seqs", "SELECT CAST(seq_id AS VARCHAR) AS id, 'len' AS extra, seq AS sequence FROM seqs WHERE length(seq)>0")
def _(spark, d):
    s = fixtures.view(spark, d, fixtures.SEQS).where("length(seq)>0")
    lines = W.contig_fasta(s.select(F.expr("concat(seq_id,' len')").alias("id"), F.lower("seq").alias("sequence")), s.select(F.expr("concat(seq_id,' len')").alias("id")))
    return R.read_fasta(spark, as_text(lines, "fasta"))


@query("s07_read_groups", "split", BP_SQL + "SELECT CAST(floor(contig/5.0) AS BIGINT) AS group_id, 'm' AS member_id, topology, CAST(contig AS VARCHAR) AS contig FROM junction")
def _(spark, d):
    j = junctions(spark, d).withColumn("group_id", F.expr("CAST(floor(contig/5.0) AS BIGINT)"))
    j = j.withColumn("line", F.expr("concat(group_id,'m) TOPOLOGY:',topology,' CONTIG:',contig,' free text')")).withColumn("member_no", F.expr("contig*10000+no1*100+no2"))
    e = j.select("group_id").distinct().withColumn("line", F.expr("concat('GRP:',group_id,' RNA:N')"))
    _, m = R.read_groups(spark, as_text(W.group_lines(e, j), "groups"))
    return m.select("group_id", "member_id", F.col("fields")["TOPOLOGY"].alias("topology"), F.col("fields")["CONTIG"].alias("contig"))


@query("s08_read_coords", "feat", "SELECT 'chr'||chrom AS chrom, fstart AS s, fend AS e, gene||' '||feature AS label FROM feat")
def _(spark, d):
    return R.read_coords(spark, as_text(joined(fixtures.view(spark, d, fixtures.FEAT), "concat('chr',chrom)", "fstart", "fend", "concat(gene,' ',feature)", sep=" "), "coords"))


@query("s09_read_libraries", "lib", "SELECT 'L'||contig AS lib, 'ver_1' AS assembly_ver, 'ver_'||(contig%3) AS output_ver, CASE WHEN contig%2=0 THEN '/data/L'||contig||'/ver_1/ver_'||(contig%3) ELSE '/given/'||contig END AS path FROM lib")
def _(spark, d):
    x = fixtures.view(spark, d, fixtures.LIB)
    lines = joined(x, "concat('L',contig)", "'ver_1'", "concat(' ',contig%3)", "CASE WHEN contig%2=0 THEN '' ELSE concat('/given/',contig) END", sep=",")
    return R.read_libraries(spark, as_text(lines.unionByName(lines.limit(1).select(F.lit("# note").alias("value"))), "libraries"), "/data/{lib}/{assembly}/{output}")


@query("s10_read_defuse", "split", BP_SQL + "SELECT contig*10000+no1*100+no2 AS cluster_id, coord_a AS pos1, coord_b AS pos2, CAST(contig%100 AS DOUBLE)/100 AS probability, contig%2=0 AS read_through, 5 AS break_in_sequence FROM junction")
def _(spark, d):
    names = "cluster_id genomic_break_pos1 genomic_break_pos2 probability read_through splitr_sequence"
    t = junctions(spark, d).selectExpr("contig*10000+no1*100+no2 AS cluster_id", "coord_a AS genomic_break_pos1", "coord_b AS genomic_break_pos2", "cast(contig%100 as double)/100 AS probability", "CASE WHEN contig%2=0 THEN 'Y' ELSE 'N' END AS read_through", "'ACGT|ACG' AS splitr_sequence").select(*names.split())
    path = f"{shared_dir(spark).rstrip('/')}/junctura-defuse-{uuid.uuid4().hex}"
    t.write.option("sep", "\t").option("header", True).csv(path)
    return R.read_defuse(spark, path).selectExpr("cast(cluster_id as bigint) AS cluster_id", "genomic_break_pos1 AS pos1", "genomic_break_pos2 AS pos2", "probability", "read_through", "break_in_sequence")


@query("s11_read_tophat_fusion", "split", BP_SQL + "SELECT 'chr'||chrom_a AS chrom_a, 'chr'||chrom_b AS chrom_b, coord_a, coord_b, CASE WHEN dir_a='up' THEN '+' ELSE '-' END AS strand_a, CASE WHEN dir_b='up' THEN '+' ELSE '-' END AS strand_b, contig%50 AS reads, 'G'||no1 AS gene1, 'G'||no2 AS gene2 FROM junction")
def _(spark, d):
    j = junctions(spark, d)
    letter = lambda s: f"CASE WHEN dir_{s}='up' THEN 'f' ELSE 'r' END"
    lines = joined(j, f"concat('allAtOnce chr',chrom_a,'-chr',chrom_b,' ',coord_a,' ',coord_b,' ',{letter('a')},{letter('b')},' ',contig%50)", "'@ 1 2'", "'ACGTACGT'", "'TTTTCCCC'", "'0 1 2'", "concat('G',no1,' G',no2)", sep="\n")
    return R.read_tophat_fusion(spark, as_text(lines, "tophat"))


@query("s12_annotation_reference", "feat", "SELECT f.feat_id AS transcript, gene, 'N'||feat_id AS name FROM feat f WHERE feat_id%2=0 UNION ALL SELECT feat_id, gene, NULL FROM feat WHERE feat_id%2=1")
def _(spark, d):
    f = fixtures.view(spark, d, fixtures.FEAT)
    t = f.selectExpr("feat_id AS transcript", "gene")
    names = f.where("feat_id%2=0").selectExpr("feat_id AS transcript", "concat('N',feat_id) AS name")
    rep = f.selectExpr("chrom", "fstart AS s", "fend AS e", "gene AS name", "feature AS class")
    return R.build_annotation_reference(t, names, t, names, rep)["transcripts"]


VCF = BP_SQL + ", e AS (SELECT contig*10000+no1*100+no2 AS group_id, *, GREATEST(0,ctg_overlap) AS w FROM junction), p AS (SELECT *, CASE WHEN dir_a='down' THEN coord_a-w ELSE coord_a END AS pa, CASE WHEN dir_b='down' THEN coord_b-w ELSE coord_b END AS pb FROM e) "
ALT = "CASE WHEN {o}='up' THEN 'N'||(CASE WHEN {m}='up' THEN ']' ELSE '[' END)||{c}||':'||{p}||(CASE WHEN {m}='up' THEN ']' ELSE '[' END) ELSE (CASE WHEN {m}='up' THEN ']' ELSE '[' END)||{c}||':'||{p}||(CASE WHEN {m}='up' THEN ']' ELSE '[' END)||'N' END"


def events(spark, d):
    j = junctions(spark, d)
    return j.withColumn("group_id", F.expr("contig*10000+no1*100+no2")).withColumn("support", F.expr("contig%13")).withColumn("contigs", F.array(F.col("contig").cast("string")))


@query("k03_vcf_fusion", "split", VCF + f"SELECT group_id||'a' AS id, CAST(chrom_a AS VARCHAR) AS chrom, pa AS pos, {ALT.format(o='dir_a', m='dir_b', c='chrom_b', p='pb')} AS alt FROM p UNION ALL SELECT group_id||'b', CAST(chrom_b AS VARCHAR), pb, {ALT.format(o='dir_b', m='dir_a', c='chrom_a', p='pa')} FROM p")
def _(spark, d):
    return W.to_vcf_fusion(events(spark, d)).select("id", "chrom", "pos", "alt")


@query("k04_vcf_dup", "split", VCF + "SELECT CAST(group_id AS VARCHAR) AS id, CASE WHEN no1%2=0 THEN coord_a WHEN dir_a='down' THEN coord_a ELSE coord_b END AS pos, 'SVTYPE=DUP;END='||(CASE WHEN no1%2=0 THEN coord_a+5 WHEN dir_a='down' THEN coord_b ELSE coord_a END)||';SR='||(contig%13) AS info FROM p")
def _(spark, d):
    e = events(spark, d).withColumn("event_type", F.expr("CASE WHEN no1%2=0 THEN 'itd' ELSE 'ptd' END")).withColumn("event_seq", F.lit("ACGTAC"))
    return W.to_vcf_dup(e).select("id", "pos", "info")


@query("k05_bed12", "aln", "SELECT 'a'||query||'_'||aln_no AS name, chrom||chr(9)||(tleft-1)||chr(9)||tright||chr(9)||'a'||query||'_'||aln_no||chr(9)||'0'||chr(9)||strand||chr(9)||(tleft-1)||chr(9)||tright||chr(9)||'0,0,0'||chr(9)||'2'||chr(9)||'20,'||(tright-tleft-24)||chr(9)||'0,25' AS value FROM aln")
def _(spark, d):
    b = F.expr("array(struct(tleft AS s, tleft+19 AS e), struct(tleft+25 AS s, tright AS e))")
    return W.to_bed12(aln(spark, d).withColumn("name", F.expr("concat('a',query,'_',aln_no)")).withColumn("blocks", b))


@query("k06_event_coords", "split", VCF + "SELECT group_id, chrom_a AS chrom, coord_a AS s, coord_a AS e FROM p WHERE no1%2=0 UNION ALL SELECT group_id, chrom_b, coord_b, coord_b FROM p WHERE no1%2=0 UNION ALL SELECT group_id, chrom_a, LEAST(coord_a,coord_b), GREATEST(coord_a,coord_b) FROM p WHERE no1%2<>0")
def _(spark, d):
    return W.event_coords(events(spark, d).withColumn("event_type", F.expr("CASE WHEN no1%2=0 THEN 'fusion' ELSE 'itd' END")))


@query("k02_split_outputs", "split", "SELECT CAST(contig AS VARCHAR) AS value, CASE WHEN contig%2=0 THEN 'pass' ELSE 'fail' END AS status, CASE WHEN count(DISTINCT topology)>1 THEN 'multi' ELSE min(topology) END AS topology FROM split GROUP BY contig")
def _(spark, d):
    g = junctions(spark, d).groupBy("contig").agg(F.array_sort(F.collect_set("topology")).alias("topologies"))
    path = f"{shared_dir(spark).rstrip('/')}/junctura-outputs-{uuid.uuid4().hex}"
    W.write_split_outputs(g.withColumn("value", F.col("contig").cast("string")).withColumn("status", F.expr("CASE WHEN contig%2=0 THEN 'pass' ELSE 'fail' END")), path)
    return spark.read.text(path).select("value", "status", "topology")


@query("k07_contigs_fasta", "seqs", "SELECT CAST(seq_id AS VARCHAR) AS id, '>'||seq_id||chr(10)||rtrim(regexp_replace(seq,'(.{{60}})','\\1'||chr(10),'g'),chr(10)) AS value FROM seqs WHERE seq_id%3=0 AND length(seq)>0")
def _(spark, d):
    s = fixtures.view(spark, d, fixtures.SEQS).where("length(seq)>0").selectExpr("cast(seq_id as string) AS id", "seq AS sequence", "seq_id")
    return W.contig_fasta(s, s.where("seq_id%3=0"))

"""Alignment, feature, read, library and sequence tables derived from the given ones.

The texts are SQL that Spark and DuckDB both run; ``{name}`` stands for a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ALN = """SELECT *, qend-qstart+1-2*mismatch AS score, CASE WHEN strand='+' THEN tleft ELSE tright END AS tstart,
 CASE WHEN strand='+' THEN tright ELSE tleft END AS tend FROM (
 SELECT l_orderkey AS query,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,l_extendedprice) AS INT) AS aln_no,
  CAST(200+(l_orderkey%5)*20 AS BIGINT) AS query_len,
  CAST(1+(l_linenumber-1)*30 AS BIGINT) AS qstart,
  LEAST(CAST(200+(l_orderkey%5)*20 AS BIGINT), CAST((l_linenumber-1)*30+60+CAST(l_quantity AS INT) AS BIGINT)) AS qend,
  CAST(l_suppkey%4+1 AS BIGINT) AS chrom,
  CASE WHEN l_linestatus='F' THEN '+' ELSE '-' END AS strand,
  CAST(1+l_partkey*50+CAST(l_quantity AS INT)*7 AS BIGINT) AS tleft,
  CAST(1+l_partkey*50+CAST(l_quantity AS INT)*7+60+CAST(l_quantity AS INT) AS BIGINT) AS tright,
  CAST(CAST(round(l_tax*100) AS INT) AS BIGINT) AS mismatch,
  1000-CAST(round(l_discount*100) AS INT)*2 AS identity_x10
 FROM {lineitem}) x"""

#: For Spark the same with numbers given first: rows are shuffled by their contig as they are read, and stay there for joins by it.
_NO = "CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,l_extendedprice) AS INT) AS aln_no"
ALN_IN_PLACE = ALN.replace(_NO, "aln_no").replace("{lineitem}", f"(SELECT *, {_NO} FROM {{lineitem}}) l")

FEAT = """SELECT p_partkey AS feat_id, p_name AS gene,
 CASE WHEN p_type IN ('SMALL','MEDIUM') THEN 'exon' WHEN p_type='PROMO' THEN 'utr' ELSE 'intron' END AS feature,
 CAST(p_partkey%4+1 AS BIGINT) AS chrom, CAST(1+p_partkey*50 AS BIGINT) AS fstart,
 CAST(p_partkey*50+40+p_size*10 AS BIGINT) AS fend,
 CASE WHEN p_size%2=0 THEN '+' ELSE '-' END AS strand FROM {part}"""

READS = """SELECT event_id AS read_id, (event_id*7)%1500 AS contig,
 CAST(1+CAST(floor(value) AS BIGINT)%200 AS BIGINT) AS rleft,
 CAST(75+CAST(floor(value) AS BIGINT)%200 AS BIGINT) AS rright,
 CASE WHEN event_type='error' THEN 1 ELSE 0 END AS nm,
 CAST(regexp_extract(props,'([0-9]+)',1) AS INT) AS mapq FROM {events}"""

LIB = "SELECT o_orderkey AS contig, o_orderpriority AS lib FROM {orders}"

SEQS = """SELECT doc_id AS seq_id, translate(upper(regexp_replace(text,'[^A-Za-z]',''GLOBAL)),
 'ABCDEFGHIJKLMNOPQRSTUVWXYZ','ACGTACGTACGTACGTACGTACGTAC') AS seq FROM {documents}"""

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(text.replace("GLOBAL", "").format(**{t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}))


def oracle(text: str) -> str:
    return text.replace("GLOBAL", ",'g'").format(**{t: t for t in TABLES})


#: Split candidates for the oracle: pairs of alignments of one contig.
SPLIT = """SELECT *, CASE WHEN chrom1<>chrom2 THEN 'interchr'
  WHEN strand1=strand2 THEN CASE WHEN subset_fraction>0.8 THEN 'end-duplication'
   WHEN NOT ((strand1='+' AND tstart1<tstart2) OR (strand1='-' AND tstart1>tstart2)) THEN CASE WHEN bp_distance>5000 THEN 'intrachr-non-colinear' ELSE 'junction-duplication' END
   WHEN bp_distance>5000 THEN 'intrachr-same-strand' ELSE 'read-through' END
  WHEN bp_distance>5000 THEN 'intrachr-opp-strand' ELSE 'local-inversion' END AS topology FROM (
 SELECT a.query AS contig, a.query_len AS ctg_len, a.aln_no AS no1, b.aln_no AS no2, a.chrom AS chrom1, b.chrom AS chrom2, a.strand AS strand1, b.strand AS strand2,
  a.qstart AS qs1, a.qend AS qe1, b.qstart AS qs2, b.qend AS qe2, a.tstart AS tstart1, a.tend AS tend1, b.tstart AS tstart2, b.tend AS tend2,
  a.tleft AS tleft1, a.tright AS tright1, b.tleft AS tleft2, b.tright AS tright2, a.identity_x10 AS pid1, b.identity_x10 AS pid2,
  LEAST(a.qend,b.qend)-GREATEST(a.qstart,b.qstart)+1 AS ctg_overlap,
  CASE WHEN a.chrom=b.chrom THEN abs(a.tend-b.tstart) END AS bp_distance, CASE WHEN a.chrom=b.chrom THEN CASE WHEN a.tleft<b.tleft THEN b.tleft-a.tright ELSE a.tleft-b.tright END END AS target_distance,
  CASE WHEN a.chrom=b.chrom THEN CAST(CASE WHEN a.tleft<b.tleft THEN a.tright-b.tleft+1 ELSE b.tright-a.tleft+1 END AS DOUBLE)/LEAST(a.tright-a.tleft+1,b.tright-b.tleft+1) END AS subset_fraction
 FROM aln a JOIN aln b ON a.query=b.query AND (a.qstart<b.qstart OR (a.qstart=b.qstart AND a.aln_no<b.aln_no))
 WHERE CAST(LEAST(a.qend,b.qend)-GREATEST(a.qstart,b.qstart)+1 AS DOUBLE)/LEAST(a.qend-a.qstart+1,b.qend-b.qstart+1)<0.8
  AND CAST((a.qend-a.qstart+1)+(b.qend-b.qstart+1)-GREATEST(0,LEAST(a.qend,b.qend)-GREATEST(a.qstart,b.qstart)+1) AS DOUBLE)/a.query_len>=0.6) p"""


def ctes(**more: str) -> str:
    """WITH clause of the views that a query names, in order."""
    return "WITH RECURSIVE " + ", ".join(f"{k} AS ({oracle(v)})" for k, v in more.items()) + " "

"""Queries of the scalar functions, screening and split candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import candidates as C
from ..operators import screening as A
from . import fixtures
from .registry import query


def aln(spark: SparkSession, d: str, in_place: bool = True) -> DataFrame:
    """Alignments; those ``in_place`` are joined by their contig without another shuffle."""
    return fixtures.view(spark, d, fixtures.ALN_IN_PLACE if in_place else fixtures.ALN)


def split(spark: SparkSession, d: str, in_place: bool = True) -> DataFrame:
    return C.split_candidates(aln(spark, d, in_place), min_represented=0.6)


CHROM = "CASE query%7 WHEN 0 THEN 'chrMT' WHEN 1 THEN 'chrX' WHEN 2 THEN 'Y' WHEN 3 THEN 'chr6_hap' WHEN 4 THEN 'M' ELSE 'chr'||CAST(chrom AS {s}) END"


@query(
    "f01_normalize_chrom", "aln",
    "SELECT query, aln_no, CASE query%7 WHEN 0 THEN 'M' WHEN 1 THEN 'X' WHEN 2 THEN 'Y' WHEN 3 THEN '6_HAP' WHEN 4 THEN 'M' ELSE CAST(chrom AS VARCHAR) END AS bare, query%7<>3 AS standard,"
    " CASE query%7 WHEN 0 THEN -2 WHEN 1 THEN 0 WHEN 2 THEN -1 WHEN 3 THEN NULL WHEN 4 THEN -2 ELSE CAST(chrom AS INT) END AS ord FROM aln",
)
def _(spark, d):
    a = aln(spark, d).withColumn("c", F.expr(CHROM.format(s="STRING")))
    return a.select("query", "aln_no", S.normalize_chrom("c").alias("bare"), S.is_standard_chrom("c").alias("standard"), S.chrom_order("c").alias("ord"))


@query("f04_psl_score", "aln", "SELECT query, aln_no, (qend-qstart+1-mismatch)-mismatch-(aln_no%3)-(aln_no%2) AS psl_score FROM aln")
def _(spark, d):
    return aln(spark, d).select("query", "aln_no", S.psl_score(F.expr("qend-qstart+1-mismatch"), "mismatch", F.expr("aln_no%3"), F.expr("aln_no%2")).cast("long").alias("psl_score"))


@query(
    "f05_percent_identity", "aln",
    "SELECT query, aln_no, CASE WHEN LEAST(qend-qstart, tright-tleft)<=0 THEN 0.0 ELSE round(100.0-0.1*(1000.0*(mismatch+aln_no%2+round(3*ln(1+GREATEST(0,(qend-qstart)-(tright-tleft)))))/CAST(qend-qstart+1 AS DOUBLE)),1) END AS pid,"
    " 100.0-0.1*floor(1000.0*(mismatch+aln_no%2+round(3*ln(1+GREATEST(0,(qend-qstart)-(tright-tleft)))))/CAST(qend-qstart+1 AS DOUBLE)) AS pid_cut FROM aln",
)
def _(spark, d):
    size = F.expr("qend-qstart+1")
    return aln(spark, d).select(
        "query", "aln_no",
        S.percent_identity("qstart", "qend", "tstart", "tend", F.expr("aln_no%2"), "mismatch", size).alias("pid"),
        S.pid_truncated(F.expr("qend-qstart"), F.expr("tright-tleft"), F.expr("aln_no%2"), F.col("mismatch"), size).alias("pid_cut"),
    )


@query(
    "f08_interval_ops", "aln",
    "SELECT query, aln_no, CAST(qend-qstart+1 AS DOUBLE)/query_len AS fraction, LEAST(qend,150)-GREATEST(qstart,80)+1 AS overlap, CAST(LEAST(qend,150)-GREATEST(qstart,80)+1 AS DOUBLE)/LEAST(qend-qstart+1,71) AS overlap_fraction,"
    " qstart<80 AND qend>150 AS inside, LEAST(qstart,80) AS union_s, GREATEST(qend,150) AS union_e, CASE WHEN GREATEST(qstart,80)<=LEAST(qend,150) THEN GREATEST(qstart,80) END AS both_s,"
    " CASE WHEN LEAST(qend,150)+1<=GREATEST(qstart,80)-1 THEN LEAST(qend,150)+1 END AS between_s, abs(qend-qstart)+1 AS width FROM aln",
)
def _(spark, d):
    a = aln(spark, d).withColumn("lo", F.lit(80).cast("long")).withColumn("hi", F.lit(150).cast("long"))
    i = ("qstart", "qend", "lo", "hi")
    return a.select(
        "query", "aln_no", S.align_fraction("qstart", "qend", "query_len").alias("fraction"), S.interval_overlap(*i).alias("overlap"), S.overlap_fraction(*i).alias("overlap_fraction"),
        S.contains_strictly(*i).alias("inside"), S.union_interval(*i)["s"].alias("union_s"), S.union_interval(*i)["e"].alias("union_e"),
        S.intersect_interval(*i)["s"].alias("both_s"), S.between_interval(*i)["s"].alias("between_s"), S.span("qstart", "qend").alias("width"),
    )


@query("f09_fix_align", "aln", "SELECT query, aln_no, tstart, tend, aln_no%3>0 AS qgap, aln_no%2>0 AS spliced FROM aln")
def _(spark, d):
    a = aln(spark, d).withColumn("qi", F.expr("aln_no%3")).withColumn("ti", F.expr("aln_no%2"))
    return a.select("query", "aln_no", S.fix_align("strand", "tleft", "tright", "qi", "ti").alias("f")).select("query", "aln_no", "f.*")


def seqs(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.view(spark, d, fixtures.SEQS)


@query(
    "f10_sequences", "seqs",
    "SELECT seq_id, reverse(translate(s,'ACGTNacgtn','TGCANtgcan')) AS revcomp, CAST(length(s)-length(replace(s,'A','')) AS DOUBLE)/length(s) AS a_share, length(s)>0 AND length(replace(s,left(s,1),''))=0 AS homopolymer,"
    " length(s)>0 AND (length(replace(s,'A',''))=0 OR length(replace(s,'T',''))=0) AS poly_at, contains(seq, substr(s,2)) OR contains(seq, substr(s,1,length(s)-1)) AS within"
    " FROM (SELECT seq_id, seq, substr(seq, CAST(1+seq_id%17 AS INT), CAST(2+seq_id%5 AS INT)) AS s FROM seqs WHERE length(seq)>=30) x",
)
def _(spark, d):
    s = seqs(spark, d).where("length(seq)>=30").withColumn("s", F.expr("substr(seq, cast(1+seq_id%17 as int), cast(2+seq_id%5 as int))"))
    a_as_n = F.translate("s", "A", "N")
    return s.select(
        "seq_id", S.reverse_complement("s").alias("revcomp"), S.n_fraction(a_as_n).alias("a_share"), S.is_homopolymer("s").alias("homopolymer"),
        S.is_poly_at("s").alias("poly_at"), S.contains_but_edge("seq", "s").alias("within"),
    )


@query(
    "f14_cigar_blocks", "reads",
    "SELECT read_id, CASE kind WHEN 0 THEN rleft WHEN 1 THEN rleft WHEN 2 THEN rleft ELSE rleft END AS first_s, CASE kind WHEN 0 THEN rleft+74 WHEN 1 THEN rleft+34 WHEN 2 THEN rleft+69 ELSE rleft+76 END AS last_e,"
    " CASE kind WHEN 1 THEN 2 WHEN 3 THEN 2 ELSE 1 END AS n, kind=0 AND nm=0 AS perfect, (kind=0 OR kind=2) AND nm=0 AS soft FROM (SELECT *, read_id%4 AS kind FROM reads) x",
)
def _(spark, d):
    r = fixtures.view(spark, d, fixtures.READS).withColumn("cigar", F.expr("element_at(array('75M','10M5N20M','5S70M','30M2D45M'), cast(read_id%4+1 as int))")).withColumn("n75", F.lit(75).cast("long"))
    b = S.cigar_blocks("cigar", "rleft")
    return r.withColumn("b", b).select(
        "read_id", F.col("b")[0]["s"].alias("first_s"), F.element_at("b", -1)["e"].alias("last_e"), F.size("b").alias("n"),
        S.is_perfect("cigar", "n75", "nm").alias("perfect"), S.is_perfect_softclipped("cigar", "n75", "nm").alias("soft"),
    )


@query(
    "f16_sam_flags", "reads",
    "SELECT read_id, CAST(read_id%2048 AS INT)&(4|512|1024|8)=0 AS paired_kept, CAST(read_id%2048 AS INT)&(4|512|1024|256)=0 AS single_kept FROM reads",
)
def _(spark, d):
    r = fixtures.view(spark, d, fixtures.READS).withColumn("flag", F.expr("cast(read_id%2048 as int)"))
    return r.select("read_id", S.sam_flag_kept("flag", True).alias("paired_kept"), S.sam_flag_kept("flag", False).alias("single_kept"))


@query(
    "f17_pair_orientation", "reads",
    "SELECT a.read_id AS id1, b.read_id AS id2, CASE WHEN a.rleft<=b.rleft THEN (CASE WHEN a.mapq%2=0 THEN 'F' ELSE 'R' END)||(CASE WHEN b.mapq%2=0 THEN 'F' ELSE 'R' END)"
    " ELSE (CASE WHEN b.mapq%2=0 THEN 'F' ELSE 'R' END)||(CASE WHEN a.mapq%2=0 THEN 'F' ELSE 'R' END) END AS orientation FROM reads a JOIN reads b ON a.read_id//2=b.read_id//2 AND a.read_id%2=0 AND b.read_id%2=1",
)
def _(spark, d):
    from ..operators.support import mate_join

    return mate_join(mates(spark, d)).select("id1", "id2", S.pair_orientation("left1", "strand1", "left2", "strand2").alias("orientation"))


def mates(spark: SparkSession, d: str) -> DataFrame:
    """Reads as mates: read ids of a pair differ in their last bit."""
    r = fixtures.view(spark, d, fixtures.READS)
    return r.select(F.expr("read_id div 2").alias("pair_id"), F.expr("cast(read_id%2+1 as int)").alias("number"), F.col("read_id").alias("id"), "contig", F.col("rleft").alias("left"), F.col("rright").alias("right"), F.expr("CASE WHEN mapq%2=0 THEN '+' ELSE '-' END").alias("strand"), "mapq")


BLOCKS = "array(struct(qstart AS s, qstart+9 AS e), struct(qstart+10 AS s, qstart+24 AS e), struct(qstart+40 AS s, qend+20 AS e))"


@query(
    "f19_blocks", "aln",
    "SELECT query, aln_no, qstart AS l_s, CASE WHEN n<=10 THEN qstart+n-1 WHEN n<=25 THEN qstart+n-1 ELSE qstart+40+(n-25)-1 END AS l_e,"
    " CASE WHEN n<=qend-qstart-19 THEN qend+20-n+1 WHEN n<=qend-qstart-19+15 THEN qstart+24-(n-(qend-qstart-19))+1 ELSE qstart+9-(n-(qend-qstart-19)-15)+1 END AS r_s, 2 AS merged"
    " FROM (SELECT *, 5+aln_no*9 AS n FROM aln WHERE qend-qstart>=50) x",
)
def _(spark, d):
    a = aln(spark, d).where("qend-qstart>=50").withColumn("b", F.expr(BLOCKS)).withColumn("n", F.expr("cast(5+aln_no*9 as bigint)"))
    left, right = S.cut_or_extend_blocks("b", "n"), S.cut_or_extend_blocks("b", "n", from_left=False)
    return a.select("query", "aln_no", left[0]["s"].alias("l_s"), F.element_at(left, -1)["e"].alias("l_e"), right[0]["s"].alias("r_s"), F.size(S.merge_blocks("b", False)).alias("merged"))


@query(
    "f24_query_to_target", "aln",
    "SELECT query, aln_no, CASE WHEN p<=19 THEN CASE WHEN strand='+' THEN 1000+p ELSE 1019-p END WHEN p<30 THEN CASE WHEN strand='+' THEN 1019 ELSE 1000 END"
    " WHEN p<=59 THEN CASE WHEN strand='+' THEN 2000+p-30 ELSE 2029-(p-30) END ELSE CASE WHEN strand='+' THEN 2029 ELSE 2000 END END AS pos, p<=19 OR (p>=30 AND p<=59) AS within FROM (SELECT *, qstart%80 AS p FROM aln) x",
)
def _(spark, d):
    a = aln(spark, d).withColumn("p", F.expr("qstart%80"))
    q = F.expr("array(struct(cast(0 as bigint) AS s, cast(19 as bigint) AS e), struct(cast(30 as bigint) AS s, cast(59 as bigint) AS e))")
    t = F.expr("array(struct(cast(1000 as bigint) AS s, cast(1019 as bigint) AS e), struct(cast(2000 as bigint) AS s, cast(2029 as bigint) AS e))")
    return a.select("query", "aln_no", S.query_to_target_pos(q, t, "p", "strand").alias("pos"), S.query_to_target_pos(q, t, "p", "strand", strict=True).isNotNull().alias("within"))


@query(
    "f21_labels", "lib",
    "SELECT contig, '2k'||(CASE WHEN contig%120-50<0 THEN '-' ELSE '+' END)||CAST(abs(contig%120-50) AS VARCHAR) AS k_form, 'c'||CAST(contig AS VARCHAR) AS clean, lib AS gene, contig%2=0 AS is_utr,"
    " 'T'||CAST(contig AS VARCHAR) AS transcript, CAST(contig%9 AS INT) AS num, contig AS group_id, 'ab' AS member, 'A' AS region FROM lib",
)
def _(spark, d):
    x = fixtures.view(spark, d, fixtures.LIB)
    label = S.gene_label(F.concat(F.col("lib"), F.expr("CASE WHEN contig%2=0 THEN '.UTR' ELSE '' END")))
    desc = S.feature_from_descriptor(F.expr("concat('T',contig,'>G~exon~',contig%9)"))
    ids = S.member_region_ids(F.expr("concat(contig,'ab)A')"))
    return x.select(
        "contig", S.k_form(F.expr("contig%120"), F.lit(25)).alias("k_form"), S.clean_contig_id(F.expr("concat(lib,':c_',contig)"), "lib").alias("clean"), label["name"].alias("gene"), label["is_utr"].alias("is_utr"),
        desc["transcript"].alias("transcript"), desc["num"].alias("num"), ids["group_id"].alias("group_id"), ids["member"].alias("member"), ids["region"].alias("region"),
    )


@query("f26_variance", "aln", "SELECT query, round(var_samp(score),4) AS sample, round(var_pop(score),4) AS population FROM aln GROUP BY query")
def _(spark, d):
    return aln(spark, d).groupBy("query").agg(F.round(F.var_samp("score"), 4).alias("sample"), F.round(F.var_pop("score"), 4).alias("population"))


# --- screening ---------------------------------------------------------------


@query(
    "c01_screen_top_n", "aln",
    "SELECT query, aln_no, CAST(r AS INT) AS score_rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, aln_no) AS k FROM"
    " (SELECT *, dense_rank() OVER (PARTITION BY query ORDER BY score DESC) AS r FROM aln) x WHERE r<=4 AND identity_x10>=850) y WHERE k<=3",
)
def _(spark, d):
    return A.screen_top_n(aln(spark, d), n=3, min_identity=85.0, best=4).select("query", "aln_no", "score_rank")


@query(
    "c01_screen_unique", "aln",
    "SELECT a.query, a.aln_no FROM aln a JOIN (SELECT query, max(score) AS m FROM aln GROUP BY query) t ON a.query=t.query"
    " WHERE a.query IN (SELECT b.query FROM aln b JOIN (SELECT query, max(score) AS m FROM aln GROUP BY query) u ON b.query=u.query AND b.score=u.m GROUP BY b.query HAVING count(*)=1) AND a.identity_x10>=400",
)
def _(spark, d):
    return A.screen_top_n(aln(spark, d), unique=True).select("query", "aln_no")


@query(
    "c02_explained_contigs", "aln",
    "SELECT query, bool_or(qend-qstart+1=query_len AND identity_x10=1000) AS perfect, bool_or(CAST(qend-qstart+1 AS DOUBLE)/query_len>=0.45 AND CAST(qend-qstart+1-mismatch AS DOUBLE)/query_len>=0.44) AS single"
    " FROM aln GROUP BY query HAVING bool_or(CAST(qend-qstart+1 AS DOUBLE)/query_len>=0.45 AND CAST(qend-qstart+1-mismatch AS DOUBLE)/query_len>=0.44) OR bool_or(qend-qstart+1=query_len AND identity_x10=1000)",
)
def _(spark, d):
    return A.explained_contigs(aln(spark, d), 0.45, 0.44)


@query(
    "c03_group_alignments", "aln",
    """, link AS (SELECT a.query AS q, a.aln_no AS u, b.aln_no AS v FROM aln a JOIN aln b ON a.query=b.query AND
      CAST(LEAST(a.qend,b.qend)-GREATEST(a.qstart,b.qstart)+1 AS DOUBLE)/LEAST(a.qend-a.qstart+1,b.qend-b.qstart+1)>=0.8),
     reach(q,u,v) AS (SELECT q,u,v FROM link UNION SELECT r.q, r.u, l.v FROM reach r JOIN link l ON r.q=l.q AND r.v=l.u)
     SELECT q AS query, u AS aln_no, CAST(min(v) AS INT) AS group_no FROM reach GROUP BY q,u""",
)
def _(spark, d):
    return A.group_alignments(aln(spark, d)).select("query", "aln_no", "group_no")


GROUPED = "(SELECT *, qstart//60 AS g FROM aln)"


def grouped(spark, d):
    return aln(spark, d).withColumn("g", F.expr("qstart div 60"))


@query("c04_pare_by_score", "aln", f"SELECT query, aln_no, CASE WHEN r>=0.85 THEN 'best' WHEN r>=0.8 THEN 'multi' ELSE 'dropped' END AS role FROM (SELECT *, CAST(score AS DOUBLE)/max(score) OVER (PARTITION BY query,g) AS r FROM {GROUPED} x) y")
def _(spark, d):
    return A.pare_by_score(grouped(spark, d), ["query", "g"]).select("query", "aln_no", "role")


@query("c05_pare_by_identity", "aln", f"SELECT query, aln_no, CASE WHEN b<0.5 THEN 'best' WHEN b<1.0 THEN 'multi' ELSE 'dropped' END AS role FROM (SELECT *, (max(identity_x10) OVER (PARTITION BY query,g)-identity_x10)/10.0 AS b FROM {GROUPED} x) y")
def _(spark, d):
    return A.pare_by_identity(grouped(spark, d), ["query", "g"]).select("query", "aln_no", "role")


@query("c06_prefer_spliced", "aln", f"SELECT query, aln_no, CASE WHEN a AND NOT spliced THEN 'multi' ELSE 'best' END AS role FROM (SELECT *, bool_or(spliced) OVER (PARTITION BY query,g) AS a FROM (SELECT *, mismatch>5 AS spliced FROM {GROUPED} w) x) y")
def _(spark, d):
    return A.prefer(grouped(spark, d).withColumn("spliced", F.col("mismatch") > 5), ["query", "g"], "spliced").select("query", "aln_no", "role")


@query("c07_mark_multi_mapped", "aln", f"SELECT query, aln_no, count(*) FILTER (r>=0.8) OVER (PARTITION BY query,g)>1 AS multi_mapped FROM (SELECT *, CAST(score AS DOUBLE)/max(score) OVER (PARTITION BY query,g) AS r FROM {GROUPED} x) y")
def _(spark, d):
    return A.mark_multi_mapped(A.pare_by_score(grouped(spark, d), ["query", "g"]), ["query", "g"]).select("query", "aln_no", "multi_mapped")


@query("c08_pick_one_group", "aln", "SELECT query, aln_no, qstart//60 AS g FROM aln")
def _(spark, d):
    both = aln(spark, d).withColumn("g", F.explode(F.expr("array(qstart div 60, qend div 60)")))
    return A.pick_one_group(both, ["query", "aln_no"], "g").select("query", "aln_no", "g")


@query(
    "c09_quick_best", "aln",
    "SELECT query, aln_no FROM aln a WHERE NOT EXISTS (SELECT 1 FROM aln b WHERE a.query=b.query AND a.aln_no<>b.aln_no AND a.score<0.85*b.score"
    " AND CAST(LEAST(a.qend,b.qend)-GREATEST(a.qstart,b.qstart)+1 AS DOUBLE)/LEAST(a.qend-a.qstart+1,b.qend-b.qstart+1)>=0.8)",
)
def _(spark, d):
    return A.quick_best(aln(spark, d)).select("query", "aln_no")


# --- split candidates --------------------------------------------------------


@query("c10_pair_alignments", "split", "SELECT contig, no1, no2 FROM split")
def _(spark, d):
    return C.pair_alignments(aln(spark, d), min_represented=0.6).select("contig", "no1", "no2")


@query("c11_split_metrics", "split", "SELECT contig, no1, no2, ctg_overlap, bp_distance, target_distance, round(subset_fraction,6) AS subset_fraction FROM split")
def _(spark, d):
    return split(spark, d).select("contig", "no1", "no2", "ctg_overlap", "bp_distance", "target_distance", F.round("subset_fraction", 6).alias("subset_fraction"))


@query("c12_topology", "split", "SELECT contig, no1, no2, topology FROM split")
def _(spark, d):
    return split(spark, d).select("contig", "no1", "no2", "topology")


@query("c12_topology_counts", "split", "SELECT topology, count(*) AS n FROM split GROUP BY topology")
def topology_counts(spark, d):
    return split(spark, d).groupBy("topology").agg(F.count(F.lit(1)).alias("n"))


BP_SQL = """, bp AS (SELECT *, chrom1<chrom2 OR (chrom1=chrom2 AND (tend1<tstart2 OR (tend1=tstart2 AND (d1='up' OR d2='down')))) AS fst FROM
 (SELECT *, CASE WHEN strand1='+' THEN 'up' ELSE 'down' END AS d1, CASE WHEN strand2='+' THEN 'down' ELSE 'up' END AS d2 FROM split) x),
 junction AS (SELECT contig, ctg_len, no1, no2, topology, ctg_overlap, CASE WHEN fst THEN chrom1 ELSE chrom2 END AS chrom_a, CASE WHEN fst THEN tend1 ELSE tstart2 END AS coord_a, CASE WHEN fst THEN d1 ELSE d2 END AS dir_a,
  CASE WHEN fst THEN chrom2 ELSE chrom1 END AS chrom_b, CASE WHEN fst THEN tstart2 ELSE tend1 END AS coord_b, CASE WHEN fst THEN d2 ELSE d1 END AS dir_b FROM bp) """


def junctions(spark: SparkSession, d: str, in_place: bool = True) -> DataFrame:
    b = C.breakpoints(split(spark, d, in_place))
    return b.select("contig", "ctg_len", "no1", "no2", "topology", "ctg_overlap", *[F.col(f"bp_{s}")[f].alias(f"{f}_{s}") for s in "ab" for f in ("chrom", "coord", "dir")])


@query("c13_breakpoints", "split", BP_SQL + "SELECT contig, no1, no2, chrom_a, coord_a, dir_a, chrom_b, coord_b, dir_b FROM junction")
def _(spark, d):
    return junctions(spark, d).drop("ctg_len", "topology", "ctg_overlap")


@query("g01_drop_contiguous", "split", BP_SQL + "SELECT contig, no1, no2 FROM junction WHERE NOT (chrom_a=chrom_b AND abs(coord_a-coord_b)<2 AND dir_a='up' AND dir_b='down')")
def _(spark, d):
    return C.drop_contiguous(C.breakpoints(split(spark, d))).select("contig", "no1", "no2")


@query("g02_dedupe_candidates", "split", BP_SQL + "SELECT chrom_a, coord_a, dir_a, chrom_b, coord_b, dir_b, count(*) AS n FROM junction GROUP BY ALL HAVING count(*)>1")
def _(spark, d):
    keys = [f"{f}_{s}" for s in "ab" for f in ("chrom", "coord", "dir")]
    return junctions(spark, d).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n>1")

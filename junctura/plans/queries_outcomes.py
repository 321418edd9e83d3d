"""Queries of filters, prediction, gaps, recurrence, comparison, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import candidates as C
from ..operators import compare as X
from ..operators import filters as L
from ..operators import gaps as D
from ..operators import intervals as I
from ..operators import predict as E
from ..operators import recurrence as R
from ..operators.grouping import group_events
from . import fixtures
from .queries_candidates import BP_SQL, aln, junctions, split
from .queries_events import MATCHED, MGENE, MKEY, OURS, POINTS, RANGE, feat, member_gene, our_part, ours, places, their_part, theirs
from .registry import query
from .session import cut, stored

#: Member columns over split candidates, for both engines.
MEMBER = """CAST(floor(contig/5.0) AS BIGINT) AS group_id, contig, ctg_len, no1, no2, topology, ctg_overlap, strand1, strand2, qs1, qs2, contig%13 AS strong,
 CASE WHEN chrom1=4 AND no1%5=0 THEN CASE WHEN contig%2=0 THEN 'chrMT' ELSE 'M' END ELSE concat('chr',chrom1) END AS chrom1, concat('chr',chrom2) AS chrom2, tright1-tleft1+1-no2%9 AS tspan_a, qe1-qs1+1-no2%4 AS aligned_a, 1+contig%2 AS num_aligners, contig%13+(contig*7+no1)%150 AS reads_all,
 (contig+no2)%6 AS num_groups, CAST(pid1 AS DOUBLE)/10 AS pid_a, CAST(pid2 AS DOUBLE)/10 AS pid_b, qe1-qs1+1 AS span_a, qe2-qs2+1 AS span_b, (no1+no2)%3 AS multi_mapped,
 CAST((qe1-qs1+1)+(qe2-qs2+1)-GREATEST(0,ctg_overlap) AS DOUBLE)/ctg_len AS represented, no1%4=0 AS gap, CASE WHEN no1%8=0 THEN 'AAAAAA' WHEN no2%3=0 THEN 'AAGAAA' ELSE 'ACGTAC' END AS event_seq, no2%2=0 AS edge_gap,
 contig%7 AS pairs, contig%5 AS pairs_filtered, contig%3 AS pairs_exonic, (contig%3)*(no2%2) AS pairs_filtered_exonic, contig%17=0 AS has_repeat, contig%11=0 AS rna"""
M = f", m AS (SELECT {MEMBER} FROM split) "


def members(spark: SparkSession, d: str) -> DataFrame:
    return split(spark, d).selectExpr(*_columns(MEMBER))


def _columns(text: str) -> list[str]:
    out, depth, now = [], 0, ""
    for ch in text.replace("\n", " "):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(now)
            now = ""
        else:
            now += ch
    return [*out, now]


#: A member filter in SQL, by reason.
SQL = {
    "READS_TO_CONTIG": "strong>=5 OR reads_all>=100",
    "TOO_MANY_GROUPS": "num_groups<=3",
    "PERCENT_IDENTITY": "pid_a>=CASE WHEN gap THEN LEAST(floor((100.0-1000.0*(1+CASE WHEN edge_gap THEN 0 ELSE 1 END+round(3*ln(1.0+GREATEST(0,span_a-tspan_a))))/aligned_a*0.1)*10)/10.0,"
    "LEAST(floor(1000.0*GREATEST(1,span_a-1)/span_a)/10.0,99.0)) ELSE LEAST(floor(1000.0*GREATEST(1,span_a-1)/span_a)/10.0,99.0) END AND pid_b>=LEAST(floor(1000.0*GREATEST(1,span_b-1)/span_b)/10.0,99.0)",
    "GAP_RUN": "NOT gap OR event_seq='ACGTAC'",
    "CONTIG_OVERLAP": "gap OR ctg_overlap<=75",
    "CONTIG_REPRESENTED": "represented>=0.9",
    "MULTI_MAPS": "multi_mapped=0",
    "POLY_A": "NOT (gap AND edge_gap AND event_seq='AAAAAA')",
    "IGNORED_TOPOLOGY": "topology<>'end-duplication'",
}
GROUP_SQL = {
    "PAIR_SUPPORT": "max(pairs_exonic)<1 OR max(pairs_filtered_exonic)<0",
    "RNA_REPEAT": "bool_or(rna)",
    "MITOCHONDRIAL": "bool_or(replace(upper(chrom1),'CHR','') IN ('M','MT') OR replace(upper(chrom2),'CHR','') IN ('M','MT'))",
    "REPEAT_SEQ": "bool_or(has_repeat)",
    "SINGLE_ALIGN": "max(num_aligners)<2 AND NOT bool_or(gap)",
}
ALL = " AND ".join(f"({v})" for v in SQL.values())


def _member_filter(reason: str):
    return lambda spark, d: members(spark, d).groupBy("group_id").agg((~F.bool_or(L.member_filters()[reason])).alias("failed"))


def _group_filter(reason: str):
    return lambda spark, d: members(spark, d).groupBy("group_id").agg(L.group_filters()[reason].alias("failed"))


for _i, (_reason, _test) in enumerate(SQL.items(), 1):
    query(f"p{_i:02d}_{_reason.lower()}", "split", M + f"SELECT group_id, NOT bool_or({_test}) AS failed FROM m GROUP BY group_id")(_member_filter(_reason))
for _i, (_reason, _test) in enumerate(GROUP_SQL.items(), 10):
    _name = "p06_single_align" if _reason == "SINGLE_ALIGN" else f"p{_i:02d}_{_reason.lower()}"
    query(_name, "split", M + f"SELECT group_id, {_test} AS failed FROM m GROUP BY group_id")(_group_filter(_reason))


@query("p02_pair_support_filtered", "split", M + "SELECT group_id, max(pairs)<3 OR max(pairs_filtered)<2 AS failed FROM m GROUP BY group_id")
def _(spark, d):
    o = L.Options(pairs=3, pairs_filtered=2, ignore_introns=False)
    return members(spark, d).groupBy("group_id").agg(L.group_filters(o)["PAIR_SUPPORT"].alias("failed"))


GAPPED = "SELECT contig, no1, no2, ctg_len, qs1 AS ctg_s, qe1 AS ctg_e, qs1+10 AS gap_s, qs1+10+no2%40 AS gap_e, qs1+5+no1%60 AS part_s, qs1+25+no2%50 AS part_e, qs1+12 AS dup_s, qs1+18 AS dup_e, CASE WHEN no2%3=0 THEN 'gap-internal_inversion' ELSE 'gap-tandem-duplication' END AS topology FROM split"
_INSIDE = "LEAST(gap_e,{0}_e)-GREATEST(gap_s,{0}_s)+1"


@query(
    "p10_gap_represented", "split",
    f"SELECT contig, no1, no2, round(CAST(CASE WHEN gap_s-1<=ctg_s THEN 0 ELSE gap_s-ctg_s END+CASE WHEN ctg_e<=gap_e+1 THEN 0 ELSE ctg_e-gap_e END+GREATEST(0,CASE WHEN {_INSIDE.format('part')}<1 AND topology LIKE '%dup%' THEN {_INSIDE.format('dup')} ELSE {_INSIDE.format('part')} END) AS DOUBLE)/ctg_len,9) AS represented FROM ({GAPPED}) x",
)
def _(spark, d):
    g = split(spark, d).selectExpr(*_columns(GAPPED[len("SELECT ") : -len(" FROM split")]))
    return g.select("contig", "no1", "no2", F.round(L.gap_represented(), 9).alias("represented"))

LENIENT = L.Options(min_identity=90.0, min_represented=0.6, all_reads=20)
SOFT = ALL.replace("99.0", "90.0").replace(">=0.9)", ">=0.6)").replace("reads_all>=100", "reads_all>=20")
REASONS = sorted([*SQL, "PAIR_SUPPORT", "RNA_REPEAT", "MITOCHONDRIAL", "NO_GOOD_MEMBERS"])
_TESTS = {k: f"NOT bool_or({v})" for k, v in SQL.items()} | {k: v for k, v in GROUP_SQL.items() if k not in ("REPEAT_SEQ", "SINGLE_ALIGN")} | {"NO_GOOD_MEMBERS": f"NOT bool_or({ALL})"}
_SOFT = {k: v.replace("99.0", "90.0").replace(">=0.9)", ">=0.6)").replace("reads_all>=100", "reads_all>=20") for k, v in _TESTS.items()}


@query("p15_filter_groups", "split", M + ", r AS (SELECT group_id, concat_ws(',', " + ", ".join(f"CASE WHEN {_SOFT[k]} THEN '{k}' END" for k in REASONS) + ") AS fail_reasons FROM m GROUP BY group_id) SELECT group_id, CASE WHEN fail_reasons='' THEN 'pass' ELSE 'fail' END AS status, fail_reasons FROM r")
def filtered(spark, d):
    return L.filter_groups(members(spark, d), LENIENT)


@query("p17_prune_members", "split", M + f"SELECT group_id, count(*) AS n_members, list_sort(list(DISTINCT topology)) AS topologies FROM m WHERE {SOFT} GROUP BY group_id")
def _(spark, d):
    return L.rebuilt(L.prune_members(members(spark, d), LENIENT))


@query("p18_low_score_members", "split", M + "SELECT group_id, count(*) AS n_members FROM m WHERE strong>=6 GROUP BY group_id")
def _(spark, d):
    return L.low_score_members(members(spark, d), "strong", 6)


@query("p19_restrict_genes", "split feat", POINTS + MGENE + "SELECT contig, no1, no2, region, gene, feature FROM mg WHERE gene IN (SELECT gene FROM feat WHERE feature='utr' AND chrom=2)")
def _(spark, d):
    return L.restrict_genes(member_gene(spark, d), feat(spark, d).where("feature='utr' AND chrom=2")).select(*MKEY, "gene", "feature")


@query("p20_sort_groups", "split", M + "SELECT group_id, max(strong) AS support FROM m GROUP BY group_id ORDER BY support DESC, group_id")
def _(spark, d):
    return L.sort_groups(members(spark, d))


@query("p21_check_events", "split", M + "SELECT contig, no1, no2, concat_ws(',', CASE WHEN group_id<0 THEN 'bad group id' END, CASE WHEN strong-contig%4>reads_all-contig%150 OR strong-contig%4<0 THEN 'bad counts' END) AS problems FROM m")
def _(spark, d):
    m = members(spark, d).withColumn("strong", F.expr("strong-contig%4")).withColumn("reads_all", F.expr("reads_all-contig%150"))
    return L.check_events(m).select("contig", "no1", "no2", F.array_join("problems", ",").alias("problems"))


#: Gapped members with what the format says of them, some of it wrong.
CHECKED = "SELECT contig, no1, no2, 1 AS group_id, 1 AS strong, 2 AS reads_all, 'ACGT' AS event_seq, no1%2=0 AS gap, contig%4 AS exon_bounds, strand1, strand2, CASE WHEN contig%9=0 THEN strand2 ELSE strand1 END AS ctg_strand, CASE WHEN contig%8=0 THEN strand1 ELSE strand2 END AS event_strand, qs1, qe1, qs2, qe2, qs1+contig%70-5 AS gap_s, qs1+contig%60+2 AS gap_e, CASE WHEN no2%2=0 THEN qs1 END AS bg_s, CASE WHEN no2%3=0 THEN qe1 END AS ag_s, CASE WHEN contig%5<>0 THEN qs1+contig%50 END AS dup_s, CASE WHEN contig%5<>0 THEN qs1+20 END AS dup_e, qs2-qs1-20+contig%2-1 AS dist FROM split"
BROKEN = {
    "exon bounds": "exon_bounds NOT IN (0,1,2)", "contig strand": "gap AND ctg_strand<>strand1", "event strand": "gap AND event_strand<>strand2", "gap order": "gap AND gap_s>=gap_e",
    "no bases before gap": "gap AND bg_s IS NULL AND gap_e>=qs1", "no bases after gap": "gap AND ag_s IS NULL AND gap_s<=qe1", "copy order": "gap AND dup_s>=dup_e",
    "copy distance": "gap AND dist<>CASE WHEN qs2<=dup_s THEN dup_s-qe2-1 ELSE qs2-dup_e-1 END",
}


@query("p21_check_gaps", "split", f", ck AS ({CHECKED}) SELECT contig, no1, no2, concat_ws(',', " + ", ".join(f"CASE WHEN {v} THEN '{k}' END" for k, v in {"contig order": "qs1>qs2", **BROKEN}.items()) + ") AS problems FROM ck")
def _(spark, d):
    m = split(spark, d).selectExpr(*_columns(CHECKED[len("SELECT ") : -len(" FROM split")]))
    return L.check_events(m).select("contig", "no1", "no2", F.array_join("problems", ",").alias("problems"))


# --- prediction --------------------------------------------------------------

PKEY = ["contig", "no1", "no2"]
SIDES = (
    POINTS
    + MGENE
    + """, sd AS (SELECT contig, no1, no2, list_sort(CASE WHEN len(xa)>0 THEN xa ELSE aa END) AS genes_a, list_sort(CASE WHEN len(xb)>0 THEN xb ELSE ab END) AS genes_b, list_sort(ca) AS coding_a, list_sort(cb) AS coding_b FROM (
 SELECT contig, no1, no2, coalesce(list(DISTINCT gene) FILTER (region='A' AND feature<>'intron'),[]) AS xa, coalesce(list(DISTINCT gene) FILTER (region='A'),[]) AS aa, coalesce(list(DISTINCT gene) FILTER (region='B' AND feature<>'intron'),[]) AS xb,
  coalesce(list(DISTINCT gene) FILTER (region='B'),[]) AS ab, coalesce(list(DISTINCT gene) FILTER (region='A' AND feature='exon'),[]) AS ca, coalesce(list(DISTINCT gene) FILTER (region='B' AND feature='exon'),[]) AS cb FROM mg GROUP BY ALL) x) """
)


def with_sides(spark, d, how="left"):
    """Split candidates with the genes of both sides; ``how='inner'``: those near features on both sides."""
    b = C.breakpoints(split(spark, d))
    b = b.select("*", *[F.col(f"bp_{s}")[f].alias(f"{f}_{s}") for s in "ab" for f in ("chrom", "coord")]).drop("bp_a", "bp_b")
    # Read for both sides.
    genes = stored(E.place_genes(places(spark, d, 60), RANGE), "genes")
    return E.at_places(b, genes, how)


def sided(spark, d, how="left"):
    """Split candidates that have genes, with those of both sides; ``how='inner'``: on both sides."""
    return with_sides(spark, d, how).where("size(genes_a) > 0 OR size(genes_b) > 0")


@query("e03_overlaps_gene", "split feat", POINTS + MGENE + "SELECT DISTINCT contig, no1, no2, region FROM mg WHERE feature IN ('exon','utr')")
def _(spark, d):
    return E.overlaps_gene(member_gene(spark, d), MKEY)


@query("e04_gene_sets_overlap", "split feat", SIDES + "SELECT contig, no1, no2, len(list_intersect(genes_a,genes_b))>0 AS shared FROM sd")
def sides(spark, d):
    return E.gene_sets_overlap(sided(spark, d)).select(*PKEY, "shared")


ORIENT = (
    SIDES
    + """, gd AS (SELECT gene, CASE WHEN min(strand)=max(strand) THEN min(strand) ELSE '*' END AS direction FROM feat GROUP BY gene),
 orr AS (SELECT m.contig, m.no1, m.no2, m.region, list(DISTINCT CASE WHEN direction='*' THEN '*' WHEN direction=(CASE WHEN m.region='A' THEN s.strand1 ELSE s.strand2 END) THEN '+' ELSE '-' END) AS o
  FROM (SELECT * FROM (SELECT *, bool_or(feature<>'intron') OVER (PARTITION BY contig,no1,no2,region) AS ex FROM mg) y WHERE NOT ex OR feature<>'intron') m JOIN gd USING (gene) JOIN split s ON s.contig=m.contig AND s.no1=m.no1 AND s.no2=m.no2 GROUP BY ALL),
 orn AS (SELECT contig, no1, no2, coalesce(max(CASE WHEN region='A' THEN CASE WHEN len(o)=1 THEN o[1] ELSE '*' END END),'?') AS orient_a, coalesce(max(CASE WHEN region='B' THEN CASE WHEN len(o)=1 THEN o[1] ELSE '*' END END),'?') AS orient_b FROM orr GROUP BY ALL),
 fu AS (SELECT s.*, sd.genes_a, sd.genes_b, orient_a, orient_b, CASE WHEN orient_a IN ('+','*') AND orient_b IN ('+','*') THEN '53' WHEN orient_a IN ('-','*') AND orient_b IN ('-','*') THEN '35' WHEN orient_a='+' THEN '55' ELSE '33' END AS ends
  FROM split s JOIN sd USING (contig,no1,no2) JOIN orn USING (contig,no1,no2) WHERE s.no1%4<>0 AND (chrom1<>chrom2 OR NOT ((tleft1<=tleft2 AND tleft2<tright1) OR (tleft2<tleft1 AND tleft1<tright2))) AND topology NOT IN ('end-duplication','junction-duplication')
  AND len(genes_a)>0 AND len(genes_b)>0 AND LEAST(qe1-qs1,qe2-qs2)+1-ctg_overlap>=5 AND (topology='interchr' OR len(list_intersect(genes_a,genes_b))=0) AND orient_a<>'?' AND orient_b<>'?') """
)


def fusions(spark, d):
    return E.fusion_ends(E.predict_fusion(sided(spark, d, "inner").withColumn("gap", F.expr("no1%4=0"))))


@query("e05_predict_fusion", "split feat", ORIENT + "SELECT contig, no1, no2, genes_a, genes_b FROM fu")
def _(spark, d):
    return fusions(spark, d).select(*PKEY, "genes_a", "genes_b")


@query("e06_fusion_ends", "split feat", ORIENT + "SELECT contig, no1, no2, substr(ends,1,1) AS end_a, substr(ends,2,1) AS end_b FROM fu")
def _(spark, d):
    return fusions(spark, d).select(*PKEY, "end_a", "end_b")


#: Genes of a breakpoint by how far they are: at it, of its region, nearby.
FOUND = "CASE WHEN fstart<=coord+5 AND fend>=coord-5 THEN 0 WHEN fstart<=coord+60 AND fend>=coord-60 THEN 1 ELSE 2 END"


@query(
    "e06_preferred_ends", "split feat",
    POINTS + f""", fo AS (SELECT DISTINCT p.contig, p.no1, p.no2, p.region, f.gene, f.feature, {FOUND} AS source FROM pts p JOIN feat f ON f.chrom=p.chrom AND f.fstart<=p.coord+300 AND f.fend>=p.coord-300),
     pr AS (SELECT contig, no1, no2, region, gene, CASE source WHEN 2 THEN 'nearby' ELSE feature END AS feature FROM (SELECT *, min(source) OVER (PARTITION BY contig,no1,no2,region) AS least FROM fo) x WHERE source=least),
     gd AS (SELECT gene, CASE WHEN min(strand)=max(strand) THEN min(strand) ELSE '*' END AS direction FROM feat GROUP BY gene),
     orr AS (SELECT m.contig, m.no1, m.no2, m.region, list(DISTINCT CASE WHEN direction='*' THEN '*' WHEN direction=(CASE WHEN m.region='A' THEN s.strand1 ELSE s.strand2 END) THEN '+' ELSE '-' END) AS o
      FROM (SELECT * FROM (SELECT *, bool_or(feature<>'intron') OVER (PARTITION BY contig,no1,no2,region) AS ex FROM pr) y WHERE NOT ex OR feature<>'intron') m JOIN gd USING (gene) JOIN split s ON s.contig=m.contig AND s.no1=m.no1 AND s.no2=m.no2 GROUP BY ALL),
     orn AS (SELECT contig, no1, no2, max(CASE WHEN region='A' THEN CASE WHEN len(o)=1 THEN o[1] ELSE '*' END END) AS a, max(CASE WHEN region='B' THEN CASE WHEN len(o)=1 THEN o[1] ELSE '*' END END) AS b FROM orr GROUP BY ALL)
     SELECT contig, no1, no2, CASE WHEN a IN ('+','*') AND b IN ('+','*') THEN '5' WHEN a IN ('-','*') AND b IN ('-','*') THEN '3' WHEN a='+' THEN '5' ELSE '3' END AS end_a,
      CASE WHEN a IN ('+','*') AND b IN ('+','*') THEN '3' WHEN a IN ('-','*') AND b IN ('-','*') THEN '5' WHEN a='+' THEN '5' ELSE '3' END AS end_b FROM orn WHERE a IS NOT NULL AND b IS NOT NULL""",
)
def _(spark, d):
    source = FOUND.replace("fstart", "fs").replace("fend", "fe").replace("coord", "s")
    found = stored(E.place_directions(places(spark, d, 5, 60, 300).withColumn("source", F.expr(source)), RANGE), "directions")
    b = C.breakpoints(split(spark, d)).select(*PKEY, "strand1", "strand2", *[F.col(f"bp_{s}")[f].alias(f"{f}_{s}") for s in "ab" for f in ("chrom", "coord")])
    return E.fusion_ends(E.at_places(b, found, "inner")).where("orient_a <> '?' AND orient_b <> '?'").select(*PKEY, "end_a", "end_b")


ROUTE = """, tr AS (SELECT *, contig*10000+no1*100+no2 AS o, CAST(floor(contig/5.0) AS BIGINT) AS group_id, CASE WHEN topology IN ('read-through','intrachr-same-strand') AND target_distance<50000 THEN 'read_through'
  WHEN topology='interchr' AND len(list_intersect(genes_a,genes_b))>0 THEN 'duplicate_gene' END AS special FROM fu) """


@query(
    "e07_route_fusions", "split feat",
    ORIENT + ROUTE + "SELECT group_id, coalesce(arg_min(special, o) FILTER (special IS NOT NULL), CASE WHEN bool_and(ends IN ('55','33')) THEN 'mixed_sense' ELSE 'main' END) AS route, count(*) AS n_members FROM tr GROUP BY group_id",
)
def _(spark, d):
    return E.route_fusions(fusions(spark, d).withColumn("group_id", F.expr("CAST(floor(contig/5.0) AS BIGINT)")), "group_id", PKEY)


BOUNDS = "CAST((contig+no1)%3 AS INT)"


def with_genes(spark, d):
    return sided(spark, d).withColumn("exon_bounds", F.expr(BOUNDS.replace("INT", "int"))).withColumn("group_id", F.expr("CAST(floor(contig/5.0) AS BIGINT)"))


@query("e08_predict_ptd", "split feat", SIDES + f"SELECT contig, no1, no2 FROM split JOIN sd USING (contig,no1,no2) WHERE topology IN ('junction-duplication','end-duplication','intrachr-non-colinear') AND {BOUNDS}=2 AND len(list_intersect(coding_a,coding_b))>0")
def _(spark, d):
    return E.predict_ptd(with_genes(spark, d)).select(*PKEY)


#: Gapped members: the gap's span and what of it is aligned, and the aligned shares of the contig.
ITD_COLUMNS = "qe2-qs2+1 AS aligned_span, qe2-qs2+1+(contig%4)*10 AS gap_span, CAST(qe1-qs1+1 AS DOUBLE)/ctg_len AS fraction_a, CAST(qe2-qs2+1 AS DOUBLE)/(ctg_len*(1+no1%3)) AS fraction_b, no2%2=0 AS edge_gap, contig%17=0 AS has_repeat, 1+no1%2 AS n_exons, 'gap-tandem-duplication' AS topology"
ITD = f"SELECT *, contig*10000+no1*100+no2 AS o FROM (SELECT contig, no1, no2, coding_a, {ITD_COLUMNS}, {BOUNDS} AS exon_bounds, CAST(floor(contig/5.0) AS BIGINT) AS group_id FROM split s JOIN sd USING (contig,no1,no2) WHERE no1%4=0) z WHERE exon_bounds<>2 AND (NOT edge_gap OR CAST(aligned_span AS DOUBLE)/gap_span>=0.8) AND NOT has_repeat AND len(coding_a)>0"


def itds(spark, d):
    g = with_genes(spark, d).where("no1%4=0").drop("topology")
    return E.predict_itd(g.selectExpr("*", *_columns(ITD_COLUMNS)).withColumn("gap", F.lit(True)))


@query("e09_predict_itd", "split feat", SIDES + f"SELECT contig, no1, no2 FROM ({ITD}) x")
def _(spark, d):
    return itds(spark, d).select(*PKEY)


@query(
    "e10_route_itds", "split feat",
    SIDES + f"""SELECT group_id, CASE WHEN fe IS NULL THEN 'internal'||(CASE WHEN fm IS NOT NULL THEN '_multi_exon' ELSE '' END) ELSE (CASE WHEN ff>=0.25 THEN 'full' ELSE 'edge' END)||(CASE WHEN fm<=fe THEN '_multi_exon' ELSE '' END) END AS route FROM (
     SELECT group_id, min(o) FILTER (edge_gap) AS fe, arg_min(LEAST(fraction_a,fraction_b), o) FILTER (edge_gap) AS ff, min(o) FILTER (n_exons>1) AS fm FROM ({ITD}) x GROUP BY group_id) y""",
)
def _(spark, d):
    return E.route_itds(itds(spark, d), "group_id", PKEY)


@query("e11_process_groups", "split feat", ORIENT + f"SELECT CAST(floor(contig/5.0) AS BIGINT) AS group_id, count(*) AS n_members, 'fusion' AS event_type FROM fu GROUP BY 1 UNION ALL SELECT group_id, count(*), 'itd' FROM ({ITD}) x GROUP BY 1")
def _(spark, d):
    return E.process_groups({"fusion": fusions(spark, d).withColumn("group_id", F.expr("CAST(floor(contig/5.0) AS BIGINT)")), "itd": itds(spark, d)})


BEST = """, bc AS (SELECT query, arg_min(aln_no, -(qend-qstart+1-mismatch)*1000+aln_no) AS best_no, max(qend-qstart+1-mismatch) AS matches, max(qend-qstart+1-mismatch)>max(query_len)-5 AS perfect, bool_or(qstart-1<5) AS starts, bool_or(query_len-qend<5) AS ends FROM aln GROUP BY query) """


@query("e12_best_contig_alignment", "split", BEST + "SELECT * FROM bc")
def _(spark, d):
    return E.best_contig_alignment(aln(spark, d))


@query("e13_region_gene_sets", "aln feat", "SELECT query, aln_no, list_sort(list(DISTINCT gene)) AS genes FROM (SELECT *, max(m) OVER (PARTITION BY query,aln_no) AS b FROM (SELECT a.query, a.aln_no, f.gene, LEAST(a.tright,f.fend)-GREATEST(a.tleft,f.fstart)+1 AS m, CAST(LEAST(a.tright,f.fend)-GREATEST(a.tleft,f.fstart)+1 AS DOUBLE)/(a.tright-a.tleft+1) AS fr FROM aln a JOIN feat f ON a.chrom=f.chrom AND a.tleft<=f.fend AND f.fstart<=a.tright) x WHERE fr>0.7) y WHERE m>=b-10 GROUP BY ALL")
def _(spark, d):
    from .queries_events import KEY, ranges

    h = I.overlap_join(ranges(spark, d), feat(spark, d)).withColumn("match", F.expr("least(e,fe)-greatest(s,fs)+1"))
    return E.region_gene_sets(h.withColumn("fraction", F.expr("cast(match as double)/(e-s+1)")), KEY)


REST = "lower(substr(seq, CAST(qe1+1 AS INT)))", "lower(substr(seq, 1, CAST(qs2-1 AS INT)))"
_AGAIN = "contains({0}, substr({1},2)) OR contains({0}, left({1}, CAST(GREATEST(0,length({1})-1) AS INT)))"


@query(
    "e14_recheck_fusion", "split feat seqs",
    ORIENT + BEST + f""", rs AS (SELECT fu.*, {REST[0]} AS past, {REST[1]} AS ahead, lower(substr(seq, CAST(qs1 AS INT), CAST(qe1-qs1+1 AS INT))) AS one, lower(substr(seq, CAST(qs2 AS INT), CAST(qe2-qs2+1 AS INT))) AS two FROM fu LEFT JOIN seqs ON seq_id=fu.contig)
    SELECT contig, no1, no2 FROM rs JOIN bc ON bc.query=rs.contig WHERE NOT perfect AND NOT matches>1.1*(GREATEST(qe1-qs1,qe2-qs2)+1)
     AND NOT coalesce(regexp_full_match(past,'.?a*') OR regexp_full_match(ahead,'t*.?') OR {_AGAIN.format("one", "past")} OR {_AGAIN.format("two", "ahead")}, false)""",
)
def _(spark, d):
    s = fixtures.view(spark, d, fixtures.SEQS).select(F.col("seq_id").alias("contig"), "seq")
    return E.recheck_fusion(fusions(spark, d), E.best_contig_alignment(aln(spark, d)), 1.1, s).select(*PKEY)


#: Hits of contigs in transcripts: alignments of one chromosome and parity share one, and some transcripts are the contig or its reverse.
HITS = "SELECT query AS contig, query*10+chrom*2+aln_no%2 AS target, qstart, qend, qend-qstart+1-mismatch AS match FROM {0}"
TARGETS = "SELECT seq_id*10+4+seq_id%2 AS target, seq FROM {0} UNION ALL SELECT seq_id*10+6+seq_id%2, reverse(translate(seq,'ACGT','TGCA')) FROM {0}"
_DROPPED = "contains({0}, substr({1},2)) OR contains({0}, left({1}, CAST(GREATEST(0,length({1})-1) AS INT)))"


@query(
    "e14_transcript_recheck", "split feat seqs",
    ORIENT + BEST + f""", hi AS ({HITS.format("aln")}), tr AS ({TARGETS.format("seqs")}),
    rs AS MATERIALIZED (SELECT * FROM (SELECT fu.*, lower(seq) AS seq, {REST[0]} AS past, {REST[1]} AS ahead, lower(substr(seq, CAST(qs1 AS INT), CAST(qe1-qs1+1 AS INT))) AS one, lower(substr(seq, CAST(qs2 AS INT), CAST(qe2-qs2+1 AS INT))) AS two FROM fu LEFT JOIN seqs ON seq_id=fu.contig) q
     JOIN bc ON bc.query=q.contig WHERE NOT perfect AND NOT matches>1.1*(GREATEST(qe1-qs1,qe2-qs2)+1)
     AND NOT coalesce(regexp_full_match(past,'.?a*') OR regexp_full_match(ahead,'t*.?') OR {_AGAIN.format("one", "past")} OR {_AGAIN.format("two", "ahead")}, false)),
    sd2 AS (SELECT contig, no1, no2, 'A' AS region, 1 AS s, qe1 AS e, seq FROM rs UNION ALL SELECT contig, no1, no2, 'B', qs2, ctg_len, seq FROM rs),
    sh AS (SELECT *, max(match) OVER (PARTITION BY contig,no1,no2,region) AS top FROM (SELECT sd2.*, target, qstart, qend, match FROM sd2 JOIN hi USING (contig) WHERE CAST(LEAST(e,qend)-GREATEST(s,qstart)+1 AS DOUBLE)/LEAST(e-s+1,qend-qstart+1)>0.7) y),
    ok AS (SELECT * FROM sh WHERE match>top-10), bt AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY contig,no1,no2,region ORDER BY match DESC, target, qstart, qend)=1),
    re AS (SELECT contig, no1, no2, target, substr(seq, CAST(qstart AS INT), CAST(qend-qstart+1 AS INT)) AS hit, CASE WHEN region='A' THEN substr(seq, CAST(qend+1 AS INT)) ELSE substr(seq, 1, CAST(qstart-1 AS INT)) END AS rest FROM bt),
    r2 AS (SELECT re.*, lower(tr.seq) AS t, reverse(translate(rest,'acgt','tgca')) AS back FROM re LEFT JOIN tr USING (target)),
    ba AS (SELECT contig, no1, no2 FROM r2 WHERE ({_DROPPED.format("hit", "rest")}) OR coalesce({_DROPPED.format("t", "rest")} OR {_DROPPED.format("t", "back")}, false)
     UNION ALL SELECT a.contig, a.no1, a.no2 FROM ok a JOIN ok b ON a.contig=b.contig AND a.no1=b.no1 AND a.no2=b.no2 AND a.region='A' AND b.region='B' AND a.target=b.target)
    SELECT contig, no1, no2 FROM rs WHERE NOT EXISTS (SELECT 1 FROM ba WHERE ba.contig=rs.contig AND ba.no1=rs.no1 AND ba.no2=rs.no2)""",
)
def _(spark, d):
    s = fixtures.view(spark, d, fixtures.SEQS)
    a = aln(spark, d)
    hits, targets = spark.sql(HITS.format("{a}"), a=a), spark.sql(TARGETS.format("{s}"), s=s)
    return E.recheck_fusion(fusions(spark, d), E.best_contig_alignment(a), 1.1, s.selectExpr("seq_id AS contig", "seq"), hits, targets).select(*PKEY)


@query("e15_recheck_ptd", "split feat", SIDES + BEST + f"SELECT contig, no1, no2 FROM split s JOIN sd USING (contig,no1,no2) JOIN bc ON bc.query=s.contig WHERE topology IN ('junction-duplication','end-duplication','intrachr-non-colinear') AND {BOUNDS}=2 AND len(list_intersect(coding_a,coding_b))>0 AND NOT perfect AND NOT matches>1.5*(GREATEST(qe1-qs1,qe2-qs2)+1)")
def _(spark, d):
    return E.recheck_ptd(E.predict_ptd(with_genes(spark, d)), E.best_contig_alignment(aln(spark, d))).select(*PKEY)


CUT = "SELECT seq_id AS contig, substr(seq, CAST(1+seq_id%50 AS INT), CAST(4+seq_id%17 AS INT)) AS dup_seq, seq_id%20 AS gene FROM seqs WHERE length(seq)>=60"


@query("e16_recheck_itd", "seqs", f", x AS ({CUT}), t AS (SELECT seq_id%20 AS gene, seq FROM seqs) SELECT contig, dup_seq, gene FROM x WHERE length(replace(dup_seq,left(dup_seq,1),''))>0 AND NOT EXISTS (SELECT 1 FROM t WHERE t.gene=x.gene AND contains(t.seq, dup_seq||dup_seq))")
def _(spark, d):
    # Made of texts once; what is cut out of them is read several times.
    s = stored(fixtures.view(spark, d, fixtures.SEQS), "seqs")
    x = stored(s.where("length(seq)>=60").selectExpr("seq_id AS contig", "substr(seq, cast(1+seq_id%50 as int), cast(4+seq_id%17 as int)) AS dup_seq", "seq_id%20 AS gene"), "cuts")
    t = s.selectExpr("seq_id%20 AS gene", "seq")
    return E.recheck_itd(x, s, t).select("contig", "dup_seq", "gene")


#: Contigs made of a text and, in its middle (shape 0 and 3) or in place of what follows or precedes it (1, 2), a copy, its reverse, one base, two copies or something else.
ITDS = """SELECT *, CASE shape WHEN 1 THEN left(seq,h)||ins WHEN 2 THEN ins||substr(seq,h+1) ELSE left(seq,h)||ins||substr(seq,h+1) END AS ctg, CASE shape WHEN 2 THEN 1 ELSE h+1 END AS gap_s, CASE shape WHEN 2 THEN 0 ELSE h END+length(ins) AS gap_e,
  CASE shape WHEN 2 THEN length(ins)+1 ELSE GREATEST(1,h-size+1) END AS b_s, CASE shape WHEN 2 THEN length(ins)+size ELSE h END AS b_e FROM (
 SELECT *, CASE kind WHEN 0 THEN copy WHEN 1 THEN reverse(translate(copy,'ACGT','TGCA')) WHEN 2 THEN repeat('A',size) WHEN 3 THEN copy||copy ELSE translate(copy,'ACGT','CGTA') END AS ins FROM (
 SELECT *, CASE WHEN shape=2 THEN substr(seq,h+1,size) ELSE substr(seq,GREATEST(1,h-size+1),LEAST(size,h)) END AS copy FROM (
 SELECT seq_id AS contig, seq, CAST(floor(length(seq)/2) AS INT) AS h, CAST(4+seq_id%37 AS INT) AS size, CAST(seq_id%5 AS INT) AS kind, CAST(floor(seq_id/5)%4 AS INT) AS shape, seq_id%11<>0 AS gap FROM {0}) w) x) y"""
ITD_BEST = """SELECT contig, contig AS target, CASE WHEN contig%2=0 THEN '+' ELSE '-' END AS strand, CASE shape WHEN 2 THEN CAST(length(ins)+1 AS INT) WHEN 3 THEN CAST(1+contig%7 AS INT) ELSE 1 END AS qstart, CASE shape WHEN 1 THEN h ELSE CAST(length(ctg) AS INT) END AS qend,
 contig%29=0 AS perfect, CASE shape WHEN 0 THEN 1 ELSE 0 END AS n_gaps, h, CAST(h+length(ins)+1 AS INT) AS h2, shape FROM {0} WHERE contig%31<>0"""
ITD_HITS = """SELECT contig, target, strand, qstart, qend, n_gaps, qend-qstart+1 AS match FROM {0} UNION ALL SELECT contig, target, CASE WHEN strand='+' THEN '-' ELSE '+' END, CAST(1+contig%6 AS INT), CAST(contig%400 AS INT), 0, CAST(contig%400 AS INT) FROM {0} WHERE contig%6=1 AND contig%400>10"""
ITD_TARGETS = "SELECT contig AS target, CASE WHEN contig%13=0 THEN ctg WHEN contig%2=0 THEN seq ELSE reverse(translate(seq,'ACGT','TGCA')) END AS seq FROM {0}"
_RUN = "coalesce(len(list_filter(range(1, CAST(length({0})-({2})+2 AS BIGINT)), lambda i: contains({1}, substr({0}, CAST(i AS INT), CAST({2} AS INT)))))>0, false)"
_SKIP = "((NOT (part=lower(ins) AND b_e-b_s=gap_e-gap_s) AND (contains(s,back) OR coalesce(contains(t,back),false))) OR length(replace(part,left(part,1),''))=0)"


def _itd_part(name: str, part: str, rest: str, beside: str, turned: str) -> str:
    big = "(CASE WHEN floor(floor(length(part)/15)/3)=0 THEN true ELSE contains(rest,substr(part,CAST(floor(floor(length(part)/15)/3) AS INT)+1)) OR contains(rest,left(part,CAST(length(part)-floor(floor(length(part)/15)/3) AS INT))) END)"
    least = "GREATEST(4,CAST(floor(CAST(LEAST(length(part),qend-qstart+1) AS DOUBLE)*0.8) AS BIGINT))"
    return f"""{name} AS (SELECT contig, CASE WHEN length(part)<4 THEN NULL WHEN turned THEN 'turned' WHEN (length(part)>15 AND {big}) OR (NOT {_SKIP} AND {_RUN.format("part", "beside", least)}) THEN 'duplicated' END AS v
     FROM (SELECT *, reverse(translate(part,'acgt','tgca')) AS back FROM (SELECT *, {part} AS part, {rest} AS rest, {beside} AS beside, coalesce({turned},false) AS turned FROM j WHERE qstart IS NOT NULL) p) q)"""


@query(
    "e16_itd_outcomes", "seqs",
    f""", it AS MATERIALIZED ({ITDS.format("seqs")}), be AS ({ITD_BEST.format("it")}), hi AS ({ITD_HITS.format("be")}), tg AS ({ITD_TARGETS.format("it")}),
    j AS MATERIALIZED (SELECT it.*, be.* EXCLUDE (contig, h, shape), lower(ctg) AS s, length(ctg) AS n, CASE WHEN strand='-' THEN reverse(translate(lower(tg.seq),'acgt','tgca')) ELSE lower(tg.seq) END AS t,
     (SELECT max(qend) FROM hi WHERE hi.contig=it.contig AND hi.strand<>be.strand AND hi.n_gaps=0 AND hi.qstart<5) AS reach, (SELECT min(qstart) FROM hi WHERE hi.contig=it.contig AND hi.strand<>be.strand AND hi.n_gaps=0 AND length(it.ctg)-hi.qend<5) AS back_from
     FROM it LEFT JOIN be ON be.contig=it.contig LEFT JOIN tg ON tg.target=be.target),
    {_itd_part("va", "left(s,CAST(qstart-1 AS INT))", "substr(s,qstart)", "substr(s,qstart,CAST(qstart-1 AS INT))", "reach>=qstart")},
    {_itd_part("vb", "substr(s,CAST(qend+1 AS INT))", "left(s,qend)", "substr(s,CAST(GREATEST(1,qend-(n-qend)+1) AS INT),CAST(LEAST(n-qend,qend) AS INT))", "back_from<=qend")},
    vc AS (SELECT contig, CASE WHEN shape<>0 OR length(part)<4 THEN NULL WHEN coalesce(CASE WHEN h<50 THEN reach>=h2-1 WHEN n-h2+1<50 THEN back_from<=h END,false) THEN 'turned'
     WHEN NOT {_SKIP} AND ({_RUN.format("part", "substr(s,CAST(GREATEST(1,h-length(part)+1) AS INT),CAST(LEAST(length(part),h) AS INT))", "4")} OR {_RUN.format("part", "substr(s,h2,CAST(length(part) AS INT))", "4")}) THEN 'duplicated' END AS v
     FROM (SELECT *, reverse(translate(part,'acgt','tgca')) AS back FROM (SELECT *, lower(ins) AS part FROM j WHERE qstart IS NOT NULL) p) q),
    lo AS (SELECT j.*, LEAST(gap_s,b_s) AS lo, GREATEST(gap_e,b_e) AS hi FROM j WHERE gap AND gap_s<>1 AND gap_e<>n),
    ex AS (SELECT *, substr(s,CAST(lo AS INT),CAST(hi-lo+1 AS INT)) AS whole, substr(s,CAST(b_s AS INT),CAST(b_e-b_s+1 AS INT)) AS unit FROM lo),
    kn AS (SELECT DISTINCT contig FROM (SELECT *, whole||repeat(unit, CASE WHEN length(unit)=0 THEN 0 ELSE coalesce(list_max(list_filter(range(0, CAST(1+GREATEST(0,floor((length(s)-length(whole))/length(unit))) AS BIGINT)), lambda k: contains(s, whole||repeat(unit,CAST(k AS INT))))),0) END) AS f FROM ex) e
     WHERE EXISTS (SELECT 1 FROM hi h2 JOIN tg ON tg.target=h2.target WHERE h2.contig=e.contig AND h2.qstart<=e.lo AND h2.qend>=e.hi AND h2.match>=75 AND (contains(lower(tg.seq),f) OR contains(lower(tg.seq),reverse(translate(f,'acgt','tgca'))))))
    SELECT j.contig, CASE WHEN qstart IS NULL OR s IS NULL THEN 'unaligned' WHEN j.contig IN (SELECT contig FROM kn) THEN 'known' WHEN perfect THEN 'perfect' WHEN gap AND gap_s<>1 AND gap_e<>n AND n_gaps=0 AND qstart<=gap_s AND qend>=gap_e THEN 'ungapped'
     ELSE coalesce(va.v, vb.v, vc.v, CASE WHEN gap THEN 'unrepeated' ELSE 'split' END) END AS outcome FROM j LEFT JOIN va USING (contig) LEFT JOIN vb USING (contig) LEFT JOIN vc USING (contig)""",
)
def _(spark, d):
    s = fixtures.view(spark, d, fixtures.SEQS)
    # Read several times below, and made of nested texts.
    x = stored(spark.sql(ITDS.format("{s}"), s=s), "itds")
    b = spark.sql(ITD_BEST.format("{x}"), x=x)
    hits, targets = spark.sql(ITD_HITS.format("{b}"), b=b), spark.sql(ITD_TARGETS.format("{x}"), x=x)
    b = b.withColumn("blocks", F.expr("CASE WHEN shape = 0 THEN array(named_struct('s', qstart, 'e', h), named_struct('s', h2, 'e', qend)) ELSE array(named_struct('s', qstart, 'e', qend)) END"))
    events = x.selectExpr("contig", "gap", "gap_s", "gap_e", "b_s AS dup_s", "b_e AS dup_e", "b_s", "b_e", "ins AS event_seq")
    return E.itd_outcomes(events, b, hits, x.selectExpr("contig", "ctg AS seq"), targets, read_length=75).select("contig", "outcome")


@query("e17_full_dup_alignments", "split", "SELECT s.contig, no1, no2, a.aln_no AS transcript FROM split s JOIN aln a ON a.query=s.contig AND a.qstart<=LEAST(qs1+20,qe2-30) AND a.qend>=GREATEST(qs1+25,qe2-20)")
def _(spark, d):
    s = split(spark, d).selectExpr("contig", "no1", "no2", "qs1+20 AS gap_s", "qs1+25 AS gap_e", "qe2-30 AS dup_s", "qe2-20 AS dup_e")
    return E.full_dup_alignments(s, aln(spark, d).selectExpr("query AS contig", "aln_no AS transcript", "qstart", "qend")).select(*PKEY, "transcript")


# --- gaps --------------------------------------------------------------------


@query(
    "c14_gap_eligible", "aln",
    "SELECT query, aln_no FROM (SELECT *, count(*) OVER (PARTITION BY query) AS n, max(score) OVER (PARTITION BY query) AS t FROM aln) x WHERE n<=3 AND CAST(qend-qstart+1 AS DOUBLE)/query_len>=0.2 AND query_len-(qend-qstart+1)>=4 AND score>=0.85*t AND CAST(score AS DOUBLE)/query_len>=0.4 AND identity_x10>400",
)
def _(spark, d):
    return D.gap_eligible(aln(spark, d), min_span=0.2).select("query", "aln_no")


def contigs(spark, d):
    return contigs_of(fixtures.view(spark, d, fixtures.SEQS))


def contigs_of(seqs: DataFrame, size: int = 300) -> DataFrame:
    """All of each text as consecutive contigs of ``size`` bases, the last one shorter: seq_id, contig_no from 0, seq, blocks.

    Two aligned blocks a contig, clipped to it; before, between and after them are gaps. What is shorter than its first block's
    start has no block, and is one gap.
    """
    s = seqs.select("seq_id", F.posexplode(F.expr(f"regexp_extract_all(seq, '.{{1,{size}}}', 0)")).alias("contig_no", "seq"))
    blocks = "array(struct(cast(1+seq_id%3*5 as bigint) AS s, cast(least(120, length(seq)) as bigint) AS e), struct(cast(121+seq_id%40 as bigint) AS s, cast(least(290+seq_id%11, length(seq)) as bigint) AS e))"
    s = s.selectExpr("seq_id", "cast(contig_no as bigint) AS contig_no", "seq", f"filter({blocks}, b -> b.s <= b.e) AS blocks")
    # A third of the contigs get the bases before the inner gap once more in it, a third their reverse complement.
    w = F.expr("cast(seq_id%40 as int)")
    copy = F.substring("seq", 121 - w, w)
    from ..functions.scalars import reverse_complement

    turned = reverse_complement(F.expr("substr(seq, 121 - cast(seq_id%40 as int), cast(seq_id%40 as int))"))
    put = F.when(F.expr("seq_id%3=0"), copy).when(F.expr("seq_id%3=1"), turned).otherwise(F.expr("substr(seq,121,cast(seq_id%40 as int))"))
    put = F.substring(put, F.lit(1), F.greatest(F.lit(0), F.length("seq") - 120))
    return s.withColumn("seq", F.concat(F.expr("substr(seq,1,120)"), put, F.expr("substr(seq, 121+cast(seq_id%40 as int))")))


#: The same contigs in SQL: seq, and first and last base of each block (null: clipped away).
CONTIGS = """SELECT seq_id, contig_no, CASE WHEN seq_id%3=0 THEN substr(raw,1,120)||left(substr(raw, CAST(121-w AS INT), CAST(w AS INT)), CAST(GREATEST(0,n-120) AS INT))||substr(raw, CAST(121+w AS INT)) WHEN seq_id%3=1 THEN substr(raw,1,120)||left(reverse(translate(substr(raw, CAST(121-w AS INT), CAST(w AS INT)),'ACGT','TGCA')), CAST(GREATEST(0,n-120) AS INT))||substr(raw, CAST(121+w AS INT)) ELSE raw END AS seq,
 n, 1+seq_id%3*5 AS s1, LEAST(120,n) AS e1, 121+seq_id%40 AS s2, LEAST(290+seq_id%11,n) AS e2 FROM (
 SELECT seq_id, k AS contig_no, substr(seq, CAST(k*300+1 AS INT), 300) AS raw, length(substr(seq, CAST(k*300+1 AS INT), 300)) AS n, seq_id%40 AS w FROM seqs, LATERAL (SELECT unnest(generate_series(0, (length(seq)-1)//300)) AS k) u WHERE length(seq)>0) x"""
EDGE = "(length(replace(g,'A',''))=0 OR length(replace(g,'T',''))=0)"
GAPS_WITH_BASES = f"""SELECT * FROM (SELECT *, substr(seq, CAST(gap_s AS INT), CAST(gap_e-gap_s+1 AS INT)) AS g, gap_s=1 OR gap_e=n AS edge FROM (
 SELECT seq_id, contig_no, seq, n, 1 AS gap_s, CASE WHEN s1<=e1 THEN s1-1 WHEN s2<=e2 THEN s2-1 ELSE n END AS gap_e FROM ct
 UNION ALL SELECT seq_id, contig_no, seq, n, e1+1, s2-1 FROM ct WHERE s1<=e1 AND s2<=e2
 UNION ALL SELECT seq_id, contig_no, seq, n, CASE WHEN s2<=e2 THEN e2 ELSE e1 END+1, n FROM ct WHERE s1<=e1 OR s2<=e2) y) z WHERE gap_e-gap_s+1>=4 AND NOT (edge AND {EDGE})"""
GAPS = f"SELECT seq_id, contig_no, gap_s, gap_e FROM ({GAPS_WITH_BASES}) v"
_TURNED = "reverse(translate({},'ACGT','TGCA'))"


def _runs(turns: str) -> str:
    """Best run of each diagonal that shares four bases: tables of rows ``tn`` (tid, gg the gap's turn, w the window) to ``run`` (tid, d, top, rs, re)."""
    words = "SELECT tid, i, substr({0}, CAST(i AS INT), 4) AS word FROM (SELECT tid, {0}, unnest(range(1, length({0})-2)) AS i FROM tn) v"
    return f"""tn AS MATERIALIZED ({turns}),
 dg AS (SELECT DISTINCT a.tid, b.i-a.i AS d FROM ({words.format("gg")}) a JOIN ({words.format("w")}) b ON a.tid=b.tid AND a.word=b.word),
 ce AS (SELECT tid, d, i, CASE WHEN i+d BETWEEN 1 AND length(w) AND substr(gg, CAST(i AS INT), 1)=substr(w, CAST(i+d AS INT), 1) THEN 1 ELSE -1 END AS v
  FROM (SELECT tid, d, gg, w, unnest(range(1, length(gg)+1)) AS i FROM dg JOIN tn USING (tid)) u),
 cs AS (SELECT tid, d, i, sum(v) OVER (PARTITION BY tid, d ORDER BY i) AS c FROM ce),
 cn AS (SELECT tid, d, i, c-LEAST(0, min(c) OVER (PARTITION BY tid, d ORDER BY i)) AS now FROM cs),
 cz AS (SELECT tid, d, i, now, coalesce(max(CASE WHEN now=0 THEN i END) OVER (PARTITION BY tid, d ORDER BY i), 0)+1 AS since FROM cn),
 run AS (SELECT tid, d, CAST(max(now) AS BIGINT) AS top, arg_max(since, now*100000-i) AS rs, arg_max(i, now*100000-i) AS re FROM cz GROUP BY tid, d)"""


#: The best copy of each gap, with its contig.
DUPS = f""", ct AS ({CONTIGS}), gx AS MATERIALIZED ({GAPS_WITH_BASES}), """ + _runs(
    f"""SELECT row_number() OVER () AS tid, * FROM (SELECT sd.*, o.inverted, CASE WHEN o.inverted THEN {_TURNED.format("g")} ELSE g END AS gg FROM (
   SELECT *, gap_e-gap_s+1 AS size, GREATEST(1, gap_s-2*(gap_e-gap_s+1)) AS from_base, substr(seq, CAST(GREATEST(1, gap_s-2*(gap_e-gap_s+1)) AS INT), CAST(gap_s-GREATEST(1, gap_s-2*(gap_e-gap_s+1)) AS INT)) AS w FROM gx
   UNION ALL SELECT *, gap_e-gap_s+1, gap_e+1, substr(seq, CAST(gap_e+1 AS INT), CAST(2*(gap_e-gap_s+1) AS INT)) FROM gx) sd, (VALUES (FALSE), (TRUE)) o(inverted) WHERE length(w)>=4) q"""
) + """,
 hit AS (SELECT seq_id, contig_no, gap_s, gap_e, size, n AS len, seq, top, inverted, re-rs+1 AS n, from_base+d+rs-1 AS ds, CASE WHEN inverted THEN gap_e-re+1 ELSE gap_s+rs-1 END AS us FROM run JOIN tn USING (tid)
  WHERE top>=4 AND top>=CAST(0.3 AS DOUBLE)*size AND top>=CAST(0.95 AS DOUBLE)*(re-rs+1)),
 hd AS (SELECT *, CASE WHEN ds>us+n-1 THEN ds-us-n ELSE us-ds-n END AS distance FROM hit),
 du AS MATERIALIZED (SELECT seq_id, contig_no, gap_s, gap_e, seq, len, ds AS dup_s, ds+n-1 AS dup_e, us AS used_s, us+n-1 AS used_e, distance, top AS score, inverted FROM hd
  QUALIFY row_number() OVER (PARTITION BY seq_id, contig_no, gap_s, gap_e ORDER BY top DESC, inverted, distance, ds)=1) """
#: With its kind of tandem, edit distances of what would go on.
TANDEM = DUPS + f""", ta AS (SELECT *, dup_e-dup_s+1 AS n, gap_e-gap_s+1 AS gap, CASE WHEN inverted THEN 2 ELSE 1 END AS two, LEAST(used_e,dup_e)+1 AS mid_s, GREATEST(used_s,dup_s)-1 AS mid_e,
  CASE WHEN inverted THEN distance//2 ELSE distance END AS step, distance*100<=CASE WHEN inverted THEN 2 ELSE 1 END*5*(gap_e-gap_s+1) AS short, NOT inverted AND (dup_e+distance>len OR dup_s-distance<1) AS no_room FROM du),
 tb AS (SELECT ta.*, distance>two*ta.n OR (s1<=e1 AND s1>=mid_s AND e1<=mid_e) OR (s2<=e2 AND s2>=mid_s AND e2<=mid_e) AS apart FROM ta JOIN ct USING (seq_id, contig_no)),
 tc AS (SELECT *, CASE WHEN NOT apart AND NOT no_room THEN levenshtein(substr(seq, CAST(CASE WHEN inverted THEN mid_s ELSE dup_e+1 END AS INT), CAST(step AS INT)),
  CASE WHEN inverted THEN {_TURNED.format("substr(seq, CAST(mid_e+1-step AS INT), CAST(step AS INT))")} ELSE substr(seq, CAST(dup_s-distance AS INT), CAST(step AS INT)) END) END AS diff FROM tb),
 td AS (SELECT *, CASE WHEN apart OR (no_room AND NOT short) THEN '' WHEN no_room THEN 'TAN(Sh&Ir)' WHEN short AND distance<=2*two THEN 'TAN(Sh&Neg)' ELSE concat('TAN(', CASE WHEN short THEN 'Sh&' ELSE '' END, CASE WHEN diff<=15*distance//100 THEN 'Mod)' ELSE 'NMod)' END) END AS how FROM tc),
 te AS (SELECT *, how<>'' AND (short OR diff<=GREATEST(2, 5*gap//100)) AS tandem FROM td),
 tf AS (SELECT *, CASE WHEN tandem AND how IN ('TAN(Sh&Neg)','TAN(Sh&Mod)','TAN(Mod)') THEN step ELSE 0 END AS moved FROM te) """


@query("c15_explode_gaps", "seqs", f", ct AS ({CONTIGS}) {GAPS}")
def _(spark, d):
    return gaps(spark, d).select(*GKEY)


def gaps(spark, d):
    return D.explode_gaps(contigs(spark, d))


GKEY = ["seq_id", "contig_no", "gap_s", "gap_e"]


@query("c16_gap_duplication", "seqs", DUPS + "SELECT seq_id, contig_no, gap_s, gap_e, dup_s, dup_e, used_s, used_e, distance, score, inverted FROM du")
def _(spark, d):
    return dups(spark, d).drop("seq", "blocks")


def dups(spark, d):
    return D.find_gap_duplication(gaps(spark, d), GKEY, keep=["seq", "blocks"])


@query(
    "c17_classify_tandem", "seqs",
    TANDEM + """SELECT seq_id, contig_no, gap_s, gap_e, tandem, how, CASE WHEN inverted THEN 'gap-inverted_duplication' WHEN tandem THEN 'gap-tandem-duplication' ELSE 'gap-nontandem-duplication' END AS topology,
     used_s-CASE WHEN dup_s<used_s THEN moved ELSE 0 END AS border_s, used_e+CASE WHEN dup_s<used_s THEN 0 ELSE moved END AS border_e FROM tf""",
)
def _(spark, d):
    return D.classify_tandem(dups(spark, d)).select(*GKEY, "tandem", "how", "topology", "border_s", "border_e")


@query("c18_tandem_spanning_gap", "seqs", DUPS + "SELECT seq_id, contig_no, gap_s, gap_e, NOT inverted AND (dup_e=gap_s-1 OR dup_s=gap_e+1) AND seq_id%8<=5 AS spanning FROM du")
def _(spark, d):
    return D.tandem_spanning_gap(dups(spark, d).withColumn("genome_gap", F.expr("seq_id%8"))).select(*GKEY, "spanning")


@query(
    "c19_gap_inversion", "seqs",
    f", ct AS ({CONTIGS}), gx AS ({GAPS_WITH_BASES}), "
    + _runs(f"SELECT row_number() OVER () AS tid, *, {_TURNED.format('g')} AS gg, substr(seq,200,60)||{_TURNED.format('g')}||substr(seq,1,30) AS w FROM gx WHERE NOT edge AND length(g)>=6")
    + """ SELECT seq_id, contig_no, gap_s, gap_e, d+1 AS at, top AS score FROM run JOIN tn USING (tid) WHERE d BETWEEN 0 AND length(w)-length(gg) AND top>=CAST(0.95 AS DOUBLE)*length(g)
     QUALIFY row_number() OVER (PARTITION BY seq_id, contig_no, gap_s, gap_e ORDER BY top DESC, d)=1""",
)
def _(spark, d):
    g = gaps(spark, d).withColumn("intron", F.expr("concat(substr(seq,200,60), reverse(translate(gap_seq,'ACGT','TGCA')), substr(seq,1,30))"))
    return D.gap_inversion(g, GKEY)


@query(
    "c20_formation_tags", "seqs",
    TANDEM + """SELECT seq_id, contig_no, gap_s, gap_e, concat_ws(';', CASE WHEN tandem THEN concat('TAN(',n,')') END, CASE WHEN tandem AND distance>0 THEN concat('NOVEL_INS(',distance,')') END, CASE WHEN gap>n THEN concat('TRIM(',gap-n,')') END) AS tags FROM tf""",
)
def _(spark, d):
    return D.formation_tags(D.classify_tandem(dups(spark, d))).select(*GKEY, "tags")


_SUB = "CASE WHEN {1}>={0} THEN substr(seq, CAST({0} AS INT), CAST({1}-{0}+1 AS INT)) ELSE '' END"


@query(
    "c21_gap_event_columns", "seqs",
    DUPS + f"SELECT seq_id, contig_no, gap_s, gap_e, used_s AS event_s, used_e AS event_e, {_SUB.format('used_s', 'used_e')} AS event_seq, {_SUB.format('dup_s', 'dup_e')} AS dup_seq, {_SUB.format('(LEAST(used_e,dup_e)+1)', '(GREATEST(used_s,dup_s)-1)')} AS ins_seq FROM du",
)
def _(spark, d):
    return D.gap_event_columns(dups(spark, d)).select(*GKEY, "event_s", "event_e", "event_seq", "dup_seq", "ins_seq")


# --- recurrence and comparison -----------------------------------------------

KEYED = ORIENT + ", kd AS MATERIALIZED (SELECT fu.contig*10000+no1*100+no2 AS event_id, CASE WHEN topology='interchr' THEN 'fusion' ELSE 'local' END AS event_type, l.lib, list_sort(list_distinct(list_concat(genes_a,genes_b))) AS gene_key FROM fu JOIN lib l ON l.contig=fu.contig) "
MERGED = ", ky AS MATERIALIZED (SELECT DISTINCT event_type, gene_key FROM kd), mk AS MATERIALIZED (SELECT a.event_type, a.gene_key, arg_min(b.gene_key, lpad(CAST(100-len(b.gene_key) AS VARCHAR),3,'0')||list_aggregate(b.gene_key,'string_agg',',')) AS key FROM ky a JOIN (SELECT *, unnest(gene_key) AS g FROM ky) b ON a.event_type=b.event_type AND b.g=a.gene_key[1] AND list_has_all(b.gene_key,a.gene_key) GROUP BY ALL) "


def keyed(spark, d):
    f = fusions(spark, d).withColumn("event_type", F.expr("CASE WHEN topology='interchr' THEN 'fusion' ELSE 'local' END")).withColumn("event_id", F.expr("contig*10000+no1*100+no2"))
    # Both sides' genes are one key before they are moved to their library.
    f = R.gene_keys(f).select("contig", "event_id", "event_type", "gene_key")
    return f.join(fixtures.view(spark, d, fixtures.LIB).hint("merge"), "contig").select("event_id", "event_type", "lib", "gene_key")


@query("g24_recurrence", "split feat lib", KEYED + MERGED + "SELECT event_type, key, list_sort(list(DISTINCT lib)) AS libraries, count(*) AS n_events, count(DISTINCT lib)>1 AS recurrent FROM kd JOIN mk USING (event_type, gene_key) GROUP BY ALL")
def _(spark, d):
    return R.recurrence(keyed(spark, d)).drop("n_libraries")


@query(
    "g24_recurrence_totals", "split feat lib",
    KEYED + MERGED + """, bk AS MATERIALIZED (SELECT event_type, key, lib, count(*) AS n FROM (SELECT DISTINCT event_type, gene_key, lib FROM kd) x JOIN mk USING (event_type, gene_key) GROUP BY event_type, key, lib),
     ag AS (SELECT *, count(*) OVER (PARTITION BY event_type, key)>1 AS again FROM bk), wh AS (SELECT event_type, key, again, sum(n) AS n FROM ag GROUP BY event_type, key, again)
     SELECT event_type, lib, CAST(sum(n) AS BIGINT) AS n_predictions, CAST(sum(CASE WHEN again THEN n ELSE 0 END) AS BIGINT) AS n_recurrent_predictions, count(*) AS n_genes, count(*) FILTER (again) AS n_recurrent_genes FROM ag GROUP BY event_type, lib
     UNION ALL SELECT event_type, NULL, CAST(sum(n) AS BIGINT), CAST(sum(CASE WHEN again THEN n ELSE 0 END) AS BIGINT), count(*), count(*) FILTER (again) FROM wh GROUP BY event_type""",
)
def _(spark, d):
    return R.recurrence_totals(keyed(spark, d))


@query(
    "g25_split_recurrent", "split feat lib",
    KEYED + MERGED + """, named AS MATERIALIZED (SELECT event_id, event_type, lib, key FROM kd JOIN mk USING (event_type, gene_key)),
     rc AS MATERIALIZED (SELECT event_type, key, min(lib)<>max(lib) AS recurrent FROM named GROUP BY event_type, key)
     SELECT event_id, recurrent FROM named JOIN rc USING (event_type, key)""",
)
def _(spark, d):
    return R.split_recurrent(keyed(spark, d)).select("event_id", "recurrent")


@query("k08_counts", "split feat lib", KEYED + "SELECT event_type, lib, count(DISTINCT event_id) AS n_events, count(DISTINCT g) AS n_genes, list_sort(list(DISTINCT g)) AS genes FROM (SELECT *, unnest(gene_key) AS g FROM kd) x GROUP BY ROLLUP(event_type, lib) HAVING event_type IS NOT NULL")
def _(spark, d):
    return R.counts(keyed(spark, d))


CALLS = "SELECT contig*10000+no1*100+no2 AS call_id, no1%3=0 AS multi, topology='read-through' AS readthrough, CAST(contig%100 AS DOUBLE)/100 AS probability, no2%6 AS coverage, contig%2=0 AS located, contig%5=0 AS gened FROM split"
LADDER = "CASE WHEN multi THEN 0 WHEN readthrough THEN 1 WHEN NOT probability>0.75 THEN 2 WHEN NOT probability>0.9 THEN 3 WHEN NOT coverage>3 THEN 4 ELSE 5 END"


def calls(spark, d):
    return X.caller_quality(split(spark, d).selectExpr(*_columns(CALLS[len("SELECT ") : -len(" FROM split")])))


CALL_ID = "contig*10000+no1*100+no2"


def compared_calls(spark, d):
    """The other caller's calls, each with a gene a side, by quality and by matches with our events."""
    columns = [*PKEY, "topology", "chrom_a", "coord_a", "chrom_b", "coord_b", "genes_a", "genes_b"]
    every = stored(with_sides(spark, d).select(*columns), "members")  # read for both callers
    quality = X.caller_quality(every.selectExpr(*_columns(CALLS[len("SELECT ") : -len(" FROM split")]))).select("call_id", "quality")
    other = their_part(every).select(F.expr(CALL_ID).alias("call_id"), *columns, F.get("genes_a", F.lit(0)).alias("gene1"), F.get("genes_b", F.lit(0)).alias("gene2"))
    located = I.location_match(our_part(every).select("id", *columns[4:8]), other, 1000, other="call_id")
    calls = other.select("call_id", "gene1", "gene2").join(quality.hint("merge"), "call_id")
    return X.matched_calls(calls, located, X.gene_partners(every.where("contig%2=0")), "call_id")


@query("g28_caller_quality", "split", f"SELECT call_id, CAST({LADDER} AS INT) AS quality FROM ({CALLS}) x")
def _(spark, d):
    return calls(spark, d).select("call_id", "quality")


COMPARED = (
    SIDES
    + OURS
    + f""", th AS (SELECT t.contig*10000+t.no1*100+t.no2 AS call_id, genes_a[1] AS gene1, genes_b[1] AS gene2 FROM theirs t LEFT JOIN sd USING (contig,no1,no2)),
 hit AS (SELECT DISTINCT t.contig*10000+t.no1*100+t.no2 AS call_id {MATCHED}),
 gp AS (SELECT DISTINCT g1, unnest(genes_b) AS g2 FROM (SELECT DISTINCT unnest(genes_a) AS g1, genes_b FROM sd WHERE contig%2=0) x),
 cq AS (SELECT th.*, {LADDER} AS quality, th.call_id IN (SELECT call_id FROM hit) AS located, EXISTS (SELECT 1 FROM gp WHERE (g1=gene1 AND g2=gene2) OR (g1=gene2 AND g2=gene1)) AS gened FROM th JOIN ({CALLS}) c USING (call_id)),
 qq AS (SELECT *, CASE WHEN gene1 IS NOT NULL AND gene2 IS NOT NULL THEN LEAST(gene1,gene2)||','||GREATEST(gene1,gene2) END AS pair FROM cq, (SELECT unnest([0,1,2,3,4,5]) AS q) z WHERE quality>=q) """
)


@query(
    "g26_comparison_counts", "split feat",
    COMPARED + "SELECT CAST(q AS INT) AS q, count(*) AS total, count(*) FILTER (located) AS lcom, count(*) FILTER (gened) AS gcom, count(*) FILTER (located AND gened) AS bcom,"
    " count(DISTINCT pair) AS total_partners, count(DISTINCT pair) FILTER (located) AS lcom_partners, count(DISTINCT pair) FILTER (gened) AS gcom_partners, count(DISTINCT pair) FILTER (located AND gened) AS bcom_partners FROM qq GROUP BY q",
)
def _(spark, d):
    return X.comparison_counts(compared_calls(spark, d))


CLUSTERED = (
    BP_SQL
    + OURS
    + """, bo AS (SELECT contig, no1, no2, chrom_a, coord_a, dir_a, chrom_b, coord_b, dir_b, contig*10000+no1*100+no2 AS node, no1%3=0 AS multi FROM ours UNION ALL SELECT contig, no1, no2, chrom_a, coord_a, dir_a, chrom_b, coord_b, dir_b, contig*10000+no1*100+no2, no1%3=0 FROM theirs),
 link AS (SELECT a.node AS u, b.node AS v FROM bo a JOIN bo b ON a.chrom_a=b.chrom_a AND a.dir_a=b.dir_a AND a.chrom_b=b.chrom_b AND a.dir_b=b.dir_b AND abs(a.coord_a-b.coord_a)<=50 AND abs(a.coord_b-b.coord_b)<=50),
 reach(u,v) AS (SELECT u,v FROM link UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v=l.u), cl AS (SELECT u AS node, min(v) AS group_key FROM reach GROUP BY u) """
)


@query(
    "g27_breakpoint_clusters", "split",
    CLUSTERED + """, cm AS MATERIALIZED (SELECT node, group_key, contig, multi, contig%2=1 AS other FROM cl JOIN bo USING (node)),
     rep AS (SELECT contig, arg_min(group_key, node) AS group_key FROM cm WHERE multi AND NOT other GROUP BY contig),
     st AS MATERIALIZED (SELECT group_key, bool_or(NOT other AND NOT multi) OR group_key IN (SELECT group_key FROM rep) OR bool_and(other) AS held, bool_or(other) AS theirs FROM cm GROUP BY group_key),
     tk AS (SELECT DISTINCT contig FROM cm JOIN st USING (group_key) WHERE NOT other AND NOT held AND theirs)
     SELECT node, group_key, NOT held AND theirs OR held AND group_key NOT IN (SELECT group_key FROM rep JOIN tk USING (contig)) AS "primary" FROM cm JOIN st USING (group_key)""",
)
def _(spark, d):
    return clusters(ours(spark, d), theirs(spark, d)).select("node", "group_key", "primary")


def clusters(ours: DataFrame, theirs: DataFrame, buffer: int = 50) -> DataFrame:
    """Breakpoint pairs of both callers in clusters of pairs at most ``buffer`` apart, with the primary one of each."""
    both = ours.drop("id").withColumn("other", F.lit(False)).unionByName(theirs.drop("id2").withColumn("other", F.lit(True))).withColumn("node", F.expr(CALL_ID)).withColumn("multi", F.expr("no1%3=0"))
    return X.primary_of_cluster(group_events(both, read_length=buffer))


#: Two blocks an alignment, with unaligned bases between them on either side, over a breakpoint at 100.
CLASSED = "SELECT *, 100 AS bp, qstart AS s1, qstart+29 AS e1, qstart+30+aln_no%4*3 AS s2, qend AS e2, 1+aln_no%3*2 AS t1, aln_no%4*3 AS q_insert, query%3*3 AS t_insert, 1+aln_no%3*2+qend-qstart-aln_no%4*3+query%3*3 AS t_end FROM aln"
_PART = "CASE WHEN e{0}<bp THEN {1} WHEN bp<s{0} THEN {2} ELSE {3} END"


@query(
    "g29_align_class", "aln",
    f"""SELECT query, aln_no, CASE WHEN qstart<3 AND query_len-qend<2 AND q_insert<3 AND t_insert<3 THEN 'full' WHEN LEAST(bp-qstart+1,qend-bp+1)>=19 AND t1<3 AND t_len-t_end<2 AND t_insert<3 AND LEAST(b1+b2,a1+a2,cb,ca)>=19 THEN 'tfull'
     WHEN LEAST(bp-qstart+1,qend-bp+1)>=19 AND LEAST(b1+b2,a1+a2,cb,ca)>=23 THEN 'part' ELSE 'none' END AS align_class, b1+b2 AS before, a1+a2 AS after, cb AS joined_before, ca AS joined_after FROM (
     SELECT *, CASE WHEN s2<bp AND brk THEN b2 ELSE b1+b2 END AS cb, a1+CASE WHEN bp<s2 AND brk THEN 0 ELSE a2 END AS ca FROM (
      SELECT *, t_end+query%3 AS t_len, q_insert>=5 OR t_insert>=5 AS brk, {_PART.format(1, "e1-s1+1", "0", "bp-s1+1")} AS b1, {_PART.format(1, "0", "e1-s1+1", "e1-bp+1")} AS a1, {_PART.format(2, "e2-s2+1", "0", "bp-s2+1")} AS b2, {_PART.format(2, "0", "e2-s2+1", "e2-bp+1")} AS a2 FROM ({CLASSED}) w) x) y""",
)
def _(spark, d):
    h = aln(spark, d).selectExpr(*_columns(CLASSED[len("SELECT ") : -len(" FROM aln")]))
    h = h.withColumn("q_blocks", F.expr("array(struct(cast(s1 as bigint) AS s, cast(e1 as bigint) AS e), struct(cast(s2 as bigint) AS s, cast(e2 as bigint) AS e))"))
    h = h.withColumn("t_blocks", F.expr("array(struct(cast(t1 as bigint) AS s, cast(t1+29 as bigint) AS e), struct(cast(t1+30+t_insert as bigint) AS s, cast(t_end as bigint) AS e))"))
    h = h.withColumn("target_len", F.expr("t_end+query%3"))
    return X.align_class(h).select("query", "aln_no", "align_class", "before", "after", "joined_before", "joined_after")


@query("g30_select_primer_member", "split", M + "SELECT group_id, contig, no1, no2 FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY round(ps,9) DESC, contig, no1, no2) AS k FROM (SELECT *, ctg_len/CAST(max(ctg_len) OVER w AS DOUBLE)+LEAST(span_a,span_b)/CAST(max(LEAST(span_a,span_b)) OVER w AS DOUBLE) AS ps FROM m WINDOW w AS (PARTITION BY group_id)) x) y WHERE k=1")
def _(spark, d):
    return X.select_primer_member(members(spark, d)).select("group_id", *PKEY)


@query("g31_chimera_sequence", "seqs", "SELECT a.seq_id, left(a.seq, CAST(50+a.seq_id%100 AS INT))||'N'||substr(b.seq, CAST(10+a.seq_id%30 AS INT)) AS expected FROM seqs a JOIN seqs b ON b.seq_id=a.seq_id+1")
def _(spark, d):
    s = fixtures.view(spark, d, fixtures.SEQS).select("seq_id", "seq")
    j = s.selectExpr("seq_id", "seq AS left_seq").join(s.selectExpr("seq_id-1 AS seq_id", "seq AS right_seq"), "seq_id")
    e = j.selectExpr("*", "cast(50+seq_id%100 as int) AS left_bp", "'N' AS extra", "cast(10+seq_id%30 as int) AS right_bp")
    return X.chimera_sequence(e).select("seq_id", "expected")


@query("g31_duplicated_sequence", "seqs", "SELECT seq_id, left(seq, CAST(60+seq_id%40 AS INT))||'AC'||substr(seq, CAST(20+seq_id%30 AS INT)) AS expected, 20+seq_id%30 AS from_, 2*(60+seq_id%40)+2-(20+seq_id%30)+1 AS to_ FROM seqs WHERE length(seq)>=100")
def _(spark, d):
    s = fixtures.view(spark, d, fixtures.SEQS).where("length(seq)>=100")
    return X.duplicated_sequence(s.selectExpr("seq_id", "seq", "20+seq_id%30 AS left", "60+seq_id%40 AS right", "'AC' AS extra")).select("seq_id", "expected", "from_", "to_")


@query("j14_gene_partner_match", "split feat", SIDES + ", th AS (SELECT f.feat_id AS id2, f.gene AS gene1, g.gene AS gene2 FROM feat f JOIN feat g ON g.feat_id=f.feat_id+3) SELECT DISTINCT contig||':'||no1||':'||no2 AS id, id2 FROM sd, th WHERE (list_contains(genes_a,gene1) AND list_contains(genes_b,gene2)) OR (list_contains(genes_a,gene2) AND list_contains(genes_b,gene1))")
def _(spark, d):
    s = sided(spark, d).withColumn("id", F.concat_ws(":", *PKEY))
    f = feat(spark, d)
    pairs = f.selectExpr("feat_id AS id2", "gene AS gene1").join(f.selectExpr("feat_id-3 AS id2", "gene AS gene2").hint("merge"), "id2")
    return X.gene_partner_match(s, pairs)

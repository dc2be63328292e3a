"""Lookups, pharmacogenomics, repeats, HLA and pathogenic-variant screens."""

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import clinical as C
from ..functions import genotype as G
from ..operators import clinical as P
from ..operators import lookup as L
from ..operators.picks import never_broadcast
from ..sources import tables as T
from .registry import check

# requests: a sample asks for the five-variant tests in which it has a call; the wanted rows name rsID and position
WANT_SQL = """tv AS (SELECT variant_id // 5 AS test_no, CASE WHEN variant_id % 25 = 13 THEN NULL WHEN variant_id % 8 = 5 THEN concat('rsx', variant_id) ELSE rsid END AS rsid, gene, chrom,
     CASE WHEN variant_id % 10 = 7 THEN NULL ELSE pos END AS pos, ref, CASE WHEN variant_id % 6 = 3 THEN 'N' ELSE alt END AS alt FROM v_variant),
  want AS (SELECT r.sample_id, tv.* FROM (SELECT DISTINCT o_custkey AS sample_id, l_partkey // 5 AS test_no FROM lineitem JOIN orders ON l_orderkey = o_orderkey) r JOIN tv USING (test_no))"""
LOOK_SQL = f"""{WANT_SQL}, byid AS (SELECT sample_id, id, chrom, pos, ref, alt_csv, gt FROM v_record WHERE id <> '.' QUALIFY row_number() OVER (PARTITION BY sample_id, id ORDER BY pos, ref, alt_csv, gt) = 1),
  cand AS (
   SELECT w.*, 1 AS rk, 'rsID' AS source, 'rsid' AS match_type, true AS found, i.gt AS genotype, 0 AS tie FROM want w JOIN byid i ON i.sample_id = w.sample_id AND i.id = w.rsid
   UNION ALL SELECT w.*, CASE WHEN r.ref = w.ref AND (r.alt_csv = w.alt OR r.alt_csv = w.alt || ',<*>') THEN 2 ELSE 3 END, 'position',
     CASE WHEN r.ref = w.ref AND (r.alt_csv = w.alt OR r.alt_csv = w.alt || ',<*>') THEN 'exact' ELSE 'locus_mismatch' END, true, r.gt, 0
     FROM want w JOIN v_record r ON r.sample_id = w.sample_id AND r.chrom = w.chrom AND r.pos = w.pos WHERE w.rsid IS NOT NULL AND r.alt_csv NOT IN ('<*>', '<NON_REF>')
   UNION ALL SELECT w.*, 4, 'gvcf_refblock', 'ref_block', true, '0/0', 0 FROM want w JOIN v_block b ON b.sample_id = w.sample_id AND b.chrom = w.chrom AND w.pos BETWEEN b.pos AND b.end_pos WHERE w.rsid IS NOT NULL
   UNION ALL SELECT w.*, 9, CASE WHEN rsid IS NULL THEN 'cnv_only' WHEN pos IS NOT NULL THEN 'position-inferred' ELSE 'none' END, NULL, false,
     CASE WHEN rsid IS NOT NULL AND pos IS NOT NULL THEN '0/0' END, 0 FROM want w),
  looked AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY sample_id, test_no, rsid, gene, chrom, ref, alt, pos ORDER BY rk, genotype) = 1)"""


def test_variants(v):
    k = F.col("variant_id")
    return v.variant.select(
        G.whole(k, 5).alias("test_no"),
        F.when(k % 25 == 13, None).when(k % 8 == 5, F.concat(F.lit("rsx"), k.cast("string"))).otherwise(F.col("rsid")).alias("rsid"),
        "gene", "chrom", F.when(k % 10 == 7, None).otherwise(F.col("pos")).alias("pos"), "ref",
        F.when(k % 6 == 3, "N").otherwise(F.col("alt")).alias("alt"), k.alias("variant_no"),
    )


def lookup_requests(v):
    return v.call_raw.select("sample_id", G.whole(F.col("variant_id"), 5).alias("test_no")).distinct()


def wanted(v):
    return lookup_requests(v).join(never_broadcast(test_variants(v)), "test_no")


def looked(v):
    v.once("record")
    return L.look_up(lookup_requests(v), v.record, listed=never_broadcast(test_variants(v)))


LOOK_COLS = ["sample_id", "test_no", "gene", "source", "match_type", "found", "genotype"]


@check("jn5_variant_lookup", f"WITH {LOOK_SQL} SELECT sample_id, test_no, gene, source, coalesce(match_type, '') AS match_type, found, coalesce(genotype, '') AS genotype, coalesce(rsid, '') AS rsid, expected_alt FROM (SELECT *, alt AS expected_alt FROM looked)")
def jn5(v):
    return looked(v).select("sample_id", "test_no", "gene", "source", F.coalesce("match_type", F.lit("")).alias("match_type"), "found",
                            F.coalesce("genotype", F.lit("")).alias("genotype"), F.coalesce("rsid", F.lit("")).alias("rsid"), "expected_alt")


@check("jn6_allele_verification", f"WITH {LOOK_SQL} SELECT match_type, source, count(*) AS n, count(DISTINCT sample_id) AS samples FROM looked WHERE match_type IS NOT NULL GROUP BY 1, 2")
def jn6(v):
    return looked(v).where("match_type is not null").groupBy("match_type", "source").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("sample_id").alias("samples"))


@check("wn8_lookup_pick", f"WITH {LOOK_SQL} SELECT sample_id, test_no, gene, coalesce(rsid, '') AS rsid, source, genotype FROM looked")
def wn8_every(v):
    return looked(v).select("sample_id", "test_no", "gene", F.coalesce("rsid", F.lit("")).alias("rsid"), "source", "genotype")


@check("jn7_batch_lookup", f"""WITH {WANT_SQL}, asked AS (SELECT * FROM want WHERE rsid IS NOT NULL),
   ids AS (SELECT a.sample_id, test_no, a.rsid, min_by(gt, (r.pos, r.ref, alt_csv, gt)) AS gt FROM asked a JOIN v_record r ON r.sample_id = a.sample_id AND r.id = a.rsid GROUP BY 1, 2, 3),
   here AS (SELECT a.sample_id, test_no, a.rsid, r.gt, r.ref, r.alt_csv, r.ref = a.ref AND list_contains(string_split(r.alt_csv, ','), a.alt) AS same FROM asked a JOIN v_record r ON r.sample_id = a.sample_id AND r.chrom = a.chrom AND r.pos = a.pos WHERE r.info_end IS NULL),
   spots AS (SELECT sample_id, test_no, rsid, bool_or(same) AS same, coalesce(min_by(gt, (ref, alt_csv, gt)) FILTER (same), min_by(gt, (ref, alt_csv, gt))) AS gt FROM here GROUP BY 1, 2, 3),
   covered AS (SELECT DISTINCT a.sample_id, test_no, a.rsid FROM asked a JOIN v_block b ON b.sample_id = a.sample_id AND b.chrom = a.chrom AND a.pos BETWEEN b.pos AND b.end_pos)
   SELECT a.sample_id, a.test_no, a.rsid, coalesce(ids.gt, spots.gt, CASE WHEN pos IS NOT NULL THEN '0/0' END, '') AS genotype,
     CASE WHEN ids.gt IS NOT NULL THEN 'rsID' WHEN spots.gt IS NOT NULL THEN 'position' WHEN covered.rsid IS NOT NULL THEN 'gvcf_refblock' WHEN pos IS NOT NULL THEN 'position-inferred' ELSE 'none' END AS source,
     CASE WHEN ids.gt IS NOT NULL THEN 'rsid' WHEN spots.same THEN 'exact' WHEN spots.gt IS NOT NULL THEN 'locus_mismatch' WHEN covered.rsid IS NOT NULL THEN 'ref_block' ELSE '' END AS match_type
   FROM asked a LEFT JOIN ids USING (sample_id, test_no, rsid) LEFT JOIN spots USING (sample_id, test_no, rsid) LEFT JOIN covered USING (sample_id, test_no, rsid)""")
def jn7(v):
    return L.batch_genotypes(lookup_requests(v), v.record, listed=never_broadcast(test_variants(v)).where("rsid is not null")).select(
        "sample_id", "test_no", "rsid", F.coalesce("genotype", F.lit("")).alias("genotype"), "source", F.coalesce("match_type", F.lit("")).alias("match_type"))


ROLL_SQL = f"""{LOOK_SQL}, roll AS (SELECT sample_id, test_no, count(*) AS n_variants, count(*) FILTER (source IN ('rsID','position','position-inferred','gvcf_refblock')) AS n_resolved,
   count(*) FILTER (match_type = 'locus_mismatch') AS n_mismatch, count(*) FILTER (found AND coalesce(match_type, '') <> 'locus_mismatch' AND contains(genotype, '1')) AS n_alt,
   count(*) FILTER (source = 'none') AS n_unresolvable, count(*) FILTER (source = 'cnv_only') AS n_cnv,
   list_sort(list(concat(gene, ' ', rsid, '=', genotype)) FILTER (found AND coalesce(match_type, '') <> 'locus_mismatch' AND contains(genotype, '1'))) AS calls FROM looked GROUP BY 1, 2)"""


@check("ag30_lookup_rollup", f"""WITH {ROLL_SQL} SELECT sample_id, test_no, n_variants, n_resolved, n_mismatch, n_alt, n_unresolvable, n_cnv,
   CASE WHEN n_resolved = 0 AND n_cnv = 0 THEN 'failed' WHEN n_resolved = 0 OR (n_mismatch > 0 AND n_alt = 0) THEN 'warning' ELSE 'passed' END AS status FROM roll""")
def ag30(v):
    return L.lookup_rollup(looked(v), ["sample_id", "test_no"]).drop("headline")


@check("pl10_variant_lookup_panel", f"""WITH {ROLL_SQL} SELECT sample_id, test_no,
   CASE WHEN n_resolved = 0 AND n_cnv = 0 THEN concat('No data: ', n_variants, ' variant(s) unresolvable') WHEN n_resolved = 0 THEN 'Requires a dedicated assay'
     WHEN n_mismatch > 0 AND n_alt = 0 THEN concat('Inconclusive: ', n_mismatch, ' locus-only match(es)') WHEN n_alt = 0 THEN 'All ref/ref (no alt calls)'
     ELSE concat(n_alt, '/', n_variants, ' alt calls: ', array_to_string(calls[1:3], ', ')) END AS headline FROM roll""")
def pl10(v):
    return L.lookup_rollup(looked(v), ["sample_id", "test_no"]).select("sample_id", "test_no", "headline")


@check("jn27_position_genotypes", """SELECT r.sample_id, r.chrom, r.pos, r.gt FROM v_record r JOIN (SELECT DISTINCT sample_id, chrom, pos FROM v_genotype) q ON q.sample_id = r.sample_id AND q.chrom = r.chrom AND q.pos = r.pos
   QUALIFY row_number() OVER (PARTITION BY r.sample_id, r.chrom, r.pos ORDER BY ref DESC, alt_csv DESC, gt DESC) = 1""")
def jn27_every(v):
    return L.genotypes_by_position(v.genotype, v.record)


@check("src6_curated_positions", """SELECT rsid, CASE WHEN variant_id % 3 = 0 THEN 1 WHEN variant_id % 2 = 0 THEN 2 END AS tier, CASE WHEN variant_id % 3 = 0 THEN pos WHEN variant_id % 2 = 0 THEN pos + 1 END AS pos FROM v_variant""")
def src6(v):
    one = v.variant.where("variant_id % 3 = 0")
    two = v.variant.where("variant_id % 2 = 0").withColumn("pos", F.col("pos") + 1)
    return T.resolve_positions(v.variant.select("rsid"), one, two).select("rsid", "tier", "pos")


# ---- rule tables ---------------------------------------------------------------------------------------------------

APOE_SQL = "apoe(dose_e4, dose_e2, diplotype, risk) AS (VALUES " + ", ".join(str(r) for r in K.APOE_TABLE) + ")"


@check("sc6_apoe", f"""WITH {APOE_SQL}, d AS (SELECT sample_id, variant_id // 5 AS test_no, max(CASE WHEN variant_id % 2 = 0 THEN CASE WHEN gt NOT IN ('./.', '0/.') THEN dosage END END) AS e4,
     max(CASE WHEN variant_id % 2 = 1 THEN CASE WHEN gt NOT IN ('./.', '0/.') THEN dosage END END) AS e2 FROM v_genotype GROUP BY 1, 2)
   SELECT sample_id, test_no, coalesce(diplotype, 'Could not determine') AS diplotype, coalesce(risk, 'Unknown') AS risk FROM d LEFT JOIN apoe ON e4 = dose_e4 AND e2 = dose_e2""")
def sc6(v):
    calls = v.genotype.select(
        "sample_id", G.whole(F.col("variant_id"), 5).alias("test_no"),
        F.when(F.col("variant_id") % 2 == 0, "e4").otherwise("e2").alias("marker"), F.col("gt").alias("genotype"))
    return P.apoe_diplotypes(calls, ["sample_id", "test_no"])


DIP_SQL = "dip AS (SELECT o_orderkey AS call_id, concat('*', o_orderkey % 60 + 1, '/*', o_orderkey % 13 + 1, CASE WHEN o_orderkey % 10 = 0 THEN 'x2' ELSE '' END) AS diplotype FROM orders)"
ACT_SQL = "act(allele, activity) AS (VALUES " + ", ".join(f"('{a}', {b}::DOUBLE)" for a, b in K.CYP2D6_ACTIVITY) + ")"


def diplotypes(v):
    k = F.col("o_orderkey")
    return v.table("orders").select(k.alias("call_id"), F.concat(
        F.lit("*"), (k % 60 + 1).cast("string"), F.lit("/*"), (k % 13 + 1).cast("string"), F.when(k % 10 == 0, "x2").otherwise("")).alias("diplotype"))


@check("sc7_metabolizer", f"""WITH {DIP_SQL}, {ACT_SQL}, p AS (SELECT call_id, diplotype, unnest(string_split(diplotype, '/')) AS part FROM dip),
   s AS (SELECT call_id, diplotype, sum(coalesce(activity, 1.0) * coalesce(try_cast(nullif(regexp_extract(part, 'x([0-9]+)$', 1), '') AS INT), 1)) AS activity_score FROM p LEFT JOIN act ON act.allele = regexp_replace(part, 'x[0-9]+$', '') GROUP BY 1, 2)
   SELECT *, CASE WHEN activity_score = 0 THEN 'Poor metabolizer' WHEN activity_score <= 0.75 THEN 'Intermediate metabolizer' WHEN activity_score <= 2.25 THEN 'Normal metabolizer' ELSE 'Ultrarapid metabolizer' END AS phenotype FROM s""")
def sc7(v):
    return P.metabolizer_status(diplotypes(v), ["call_id"])


REP_SQL = "rep(gene, c1, c2, c3, n1, n2, n3, n4) AS (VALUES " + ", ".join(str((r[0], *r[2:])) for r in K.REPEAT_TABLE) + ")"


@check("sc8_repeat_class", f"""WITH {REP_SQL}, c AS (SELECT o_orderkey AS call_id, (['FMR1','HTT','DMPK','OTHER'])[o_orderkey % 4 + 1] AS gene, greatest(o_orderkey % 60, o_orderkey % 230) AS repeats FROM orders)
   SELECT call_id, gene, CAST(repeats AS INT) AS repeats, CASE WHEN c1 IS NULL THEN CASE WHEN repeats <= 44 THEN 'Normal' ELSE 'Expanded' END WHEN repeats <= c1 THEN n1 WHEN repeats <= c2 THEN n2 WHEN repeats <= c3 THEN n3 ELSE n4 END AS repeat_class,
     repeats > coalesce(c1, 44) AS carrier FROM c LEFT JOIN rep USING (gene)""")
def sc8(v):
    k = F.col("o_orderkey")
    gene = F.element_at(F.array(*[F.lit(g) for g in ("FMR1", "HTT", "DMPK", "OTHER")]), (k % 4 + 1).cast("int"))
    counts = v.table("orders").select(k.alias("call_id"), gene.alias("gene"), F.array((k % 60).cast("int"), (k % 230).cast("int")).alias("counts"))
    return P.repeat_classes(counts).select("call_id", "gene", "repeats", "repeat_class", "carrier")


def proxy_carriers(v, variants):
    proxies = variants.select("rsid", F.concat(F.lit("B*"), "gene").alias("hla_allele"))
    calls = v.genotype.select("sample_id", "rsid", F.col("gt").alias("genotype"))
    return P.hla_proxy_carriers(calls, proxies).select("sample_id", "rsid", "hla_allele", "carrier_state")


@check("sc9_hla_proxy", """SELECT sample_id, rsid, hla_allele, CASE WHEN gt IN ('0/0') THEN 'non-carrier' WHEN gt IN ('./.', '0/.') THEN 'undetermined' ELSE 'carrier' END AS carrier_state
   FROM v_genotype JOIN (SELECT rsid, concat('B*', gene) AS hla_allele FROM v_variant) USING (rsid)""")
def sc9_every(v):
    return proxy_carriers(v, v.variant)


@check("sc9_proxy_tests", f"""WITH {LOOK_SQL}, a AS (SELECT sample_id, test_no, rsid, concat('B*', gene) AS hla_allele, alt AS risk_base, found, coalesce(genotype, '') AS g FROM looked WHERE rsid IS NOT NULL),
   b AS (SELECT *, NOT found AND NOT contains(g, '0/0') AS unknown, regexp_matches(g, '0[/|]1|1[/|]0|1[/|]1') AS carries FROM a)
   SELECT sample_id, test_no, rsid, hla_allele, NOT unknown AND carries AS carrier, CASE WHEN unknown OR carries THEN 'warning' ELSE 'passed' END AS status,
     CASE WHEN unknown THEN concat(hla_allele, ': proxy SNP ', rsid, ' not in VCF') WHEN carries THEN concat(hla_allele, ': CARRIER (proxy ', rsid, ' = ', g, ')') ELSE concat(hla_allele, ': non-carrier (proxy ', rsid, ' = ', g, ')') END AS headline FROM b""")
def sc9_tests(v):
    """Proxies looked up by id, position, reference block or inferred reference, as the four of the rule table are."""
    answers = looked(v).where("rsid IS NOT NULL").withColumn("hla_allele", F.concat(F.lit("B*"), "gene")).withColumn("risk_base", F.col("expected_alt"))
    return P.hla_proxy_answers(answers).select("sample_id", "test_no", "rsid", "hla_allele", "carrier", "status", "headline")


HLA_GENES = ["HLA-B", "HLA-A", "HLA-DRB1", "HLA-E"]
HLA_SQL = """hla AS (SELECT o_orderkey // 4 AS sample_no, (['HLA-B','HLA-A','HLA-DRB1','HLA-E'])[o_orderkey % 4 + 1] AS gene, o_orderkey % 80 AS x, o_custkey % 90 AS y, 1 + o_orderkey % 2 AS n FROM orders)"""


def hla_lines(v):
    k = F.col("o_orderkey")
    gene = F.element_at(F.array(*[F.lit(g) for g in HLA_GENES]), (k % 4 + 1).cast("int"))
    x, y = (k % 80).cast("string"), (F.col("o_custkey") % 90).cast("string")
    first = F.concat(gene, F.lit("*"), x, F.lit(":01,"), gene, F.lit("*99:99"))
    return v.table("orders").select(G.whole(k, 4).alias("sample_no"), F.concat_ws(
        "\t", gene, (1 + k % 2).cast("string"), first, F.lit("10.0"), F.lit("60"), F.concat(gene, F.lit("*"), y, F.lit(":02")), F.lit("9"), F.lit("5")).alias("value"))


@check("sc10_hla_headline", f"""WITH {HLA_SQL}, t AS (SELECT sample_no, gene, concat(replace(gene, 'HLA-', ''), '*', x, ':01', CASE WHEN n = 2 THEN concat('/', y, ':02') ELSE '' END) AS txt,
     list_position(['HLA-A','HLA-B','HLA-C','HLA-DRB1','HLA-DQB1','HLA-DPB1'], gene) AS place FROM hla)
   SELECT sample_no, concat('HLA: ', string_agg(txt, ', ' ORDER BY place, txt)) AS headline FROM t WHERE place > 0 GROUP BY 1""")
def sc10(v):
    return P.hla_headline(T.parse_hla_calls(hla_lines(v)), ["sample_no"])


@check("src17_caller_output", f"""WITH {HLA_SQL} SELECT sample_no, gene, concat(gene, '*', x, ':01', CASE WHEN n = 2 THEN concat('|', gene, '*', y, ':02') ELSE '' END) AS alleles FROM hla""")
def src17(v):
    return T.parse_hla_calls(hla_lines(v)).select("sample_no", "gene", F.array_join("alleles", "|").alias("alleles"))


@check("ag29_impossible_diplotype", """SELECT sample_id, gene, string_agg(DISTINCT rsid, ',' ORDER BY rsid) AS alleles, count(DISTINCT rsid) AS n FROM v_genotype JOIN (SELECT variant_id, gene FROM v_variant) USING (variant_id)
   WHERE dosage = 2 GROUP BY 1, 2 HAVING count(DISTINCT rsid) > 1""")
def ag29(v):
    d = v.genotype.join(v.variant.select("variant_id", "gene"), "variant_id").withColumn("allele", F.col("rsid"))
    return L.impossible_diplotypes(d, ["sample_id", "gene"]).select("sample_id", "gene", F.array_join("alleles", ",").alias("alleles"), F.size("alleles").cast("bigint").alias("n"))


# ---- pathogenic-variant screens -------------------------------------------------------------------------------------

PANEL_GENE_SQL = "pg AS (SELECT DISTINCT CASE r_name WHEN 'AFRICA' THEN 'AFR' WHEN 'AMERICA' THEN 'AMR' WHEN 'ASIA' THEN 'EAS' WHEN 'EUROPE' THEN 'EUR' ELSE 'SAS' END AS panel, concat('Brand#', n_nationkey + 1) AS gene FROM nation JOIN region ON n_regionkey = r_regionkey)"
FIND_SQL = f"""{PANEL_GENE_SQL}, ann AS (SELECT r.sample_id, r.chrom, r.pos, r.ref, v.alt, r.gt, v.clnsig, v.geneinfo FROM (SELECT *, split_part(alt_csv, ',', 1) AS alt1 FROM v_record WHERE alt_csv NOT IN ('<*>','<NON_REF>')) r
    LEFT JOIN v_variant v ON v.chrom = r.chrom AND v.pos = r.pos AND v.ref = r.ref AND v.alt = r.alt1),
  gi AS (SELECT DISTINCT sample_id, chrom, pos, ref, alt, gt, clnsig, split_part(g, ':', 1) AS gene FROM (SELECT *, unnest(string_split(geneinfo, '|')) AS g FROM ann) WHERE contains(gt, '1') AND regexp_matches(clnsig, 'Pathogenic|Likely_pathogenic')),
  fnd AS (SELECT sample_id, panel, gene, chrom, pos, ref, alt, clnsig, gt FROM gi JOIN pg USING (gene)),
  req AS (SELECT sample_id, superpop AS panel FROM v_sample)"""


def panel_genes(v):
    return v.panel_sample.select(F.col("superpop").alias("panel"), F.concat(F.lit("Brand#"), (F.col("sample_id") + 1).cast("string")).alias("gene"))


def findings(v):
    return P.pathogenic_findings(P.annotate(v.record, v.variant), panel_genes(v))


def screen_requests(v):
    return v.sample.select("sample_id", F.col("superpop").alias("panel"))


@check("jn8_annotate", f"WITH {FIND_SQL} SELECT sample_id, chrom, pos, gt, coalesce(clnsig, '') AS clnsig, coalesce(geneinfo, '') AS geneinfo FROM ann")
def jn8(v):
    return P.annotate(v.record, v.variant).select("sample_id", "chrom", "pos", "gt", F.coalesce("clnsig", F.lit("")).alias("clnsig"), F.coalesce("geneinfo", F.lit("")).alias("geneinfo"))


@check("jn9_panel_genes", f"WITH {FIND_SQL} SELECT sample_id, panel, gene, chrom, pos, ref, alt, clnsig, gt FROM fnd")
def jn9(v):
    return findings(v)


@check("jn22_clean_genes", f"WITH {FIND_SQL} SELECT sample_id, panel, gene FROM req JOIN pg USING (panel) EXCEPT SELECT sample_id, panel, gene FROM fnd")
def jn22(v):
    return P.clean_genes(screen_requests(v), panel_genes(v), findings(v))


SCREEN_SQL = f"""{FIND_SQL}, scr AS (SELECT r.sample_id, r.panel, coalesce(n, 0) AS findings, coalesce(k, 0) AS genes_with_finding, ng AS genes_screened, genes
   FROM req r JOIN (SELECT panel, count(DISTINCT gene) AS ng FROM pg GROUP BY 1) USING (panel) LEFT JOIN (SELECT sample_id, panel, count(*) AS n, count(DISTINCT gene) AS k, list_sort(list(DISTINCT gene)) AS genes FROM fnd GROUP BY 1, 2) f USING (sample_id, panel))"""


@check("ag23_screen_rollup", f"WITH {SCREEN_SQL} SELECT sample_id, panel, findings, genes_with_finding, genes_screened FROM scr")
def ag23(v):
    return P.screen_rollup(screen_requests(v), panel_genes(v), findings(v)).select("sample_id", "panel", "findings", "genes_with_finding", "genes_screened")


@check("pl11_pathogenic_screen", f"""WITH {SCREEN_SQL} SELECT sample_id, panel, CASE WHEN findings > 0 THEN 'warning' ELSE 'passed' END AS status,
   CASE WHEN findings > 0 THEN concat(findings, ' pathogenic finding(s): ', array_to_string(genes[1:5], ', ')) ELSE concat('No pathogenic variants in ', genes_screened, ' genes') END AS headline FROM scr""")
def pl11(v):
    return P.screen_rollup(screen_requests(v), panel_genes(v), findings(v)).select("sample_id", "panel", "status", "headline")


@check("so5_gene_intersection", f"""WITH {PANEL_GENE_SQL}, g AS (SELECT DISTINCT variant_id, split_part(unnest(string_split(geneinfo, '|')), ':', 1) AS gene FROM v_variant)
   SELECT variant_id, panel, string_agg(gene, ',' ORDER BY gene) AS genes FROM g JOIN pg USING (gene) GROUP BY 1, 2""")
def so5(v):
    panels = panel_genes(v).groupBy("panel").agg(F.array_sort(F.collect_set("gene")).alias("panel_genes"))
    own = v.variant.withColumn("genes", G.gene_names(F.col("geneinfo"))).withColumn("gene", F.explode("genes"))
    hit = own.join(panel_genes(v), "gene").select("variant_id", "genes", "panel").distinct().join(panels, "panel")
    return hit.select("variant_id", "panel", F.array_join(F.array_sort(F.array_intersect("genes", "panel_genes")), ",").alias("genes"))

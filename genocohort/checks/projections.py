"""Projections, filters, dedupe, set operations and scalar genotype rules."""

from pyspark.sql import functions as F

from ..constants import AUTOSOMES, CHR1_LENGTHS
from ..functions import files as N
from ..functions import genotype as G
from ..operators import alleles as A
from ..operators import scoring as O
from ..operators.regions import in_regions
from ..session import shared_folder
from ..sources import layout as LY
from .registry import check

# ---- files and headers --------------------------------------------------------------------------------------------

FILE_SQL = """files AS (SELECT event_id AS file_no, concat('/data/', event_type, '_', user_id,
   (['.g.vcf.gz','.vcf.gz','.bam','.cram','.gvcf','.txt','.VCF','_hmPOS_GRCh38.txt.gz','_hmPOS_GRCh37.txt.gz','.bcf'])[event_id % 10 + 1]) AS path FROM events)"""
SUFFIXES = [".g.vcf.gz", ".vcf.gz", ".bam", ".cram", ".gvcf", ".txt", ".VCF", "_hmPOS_GRCh38.txt.gz", "_hmPOS_GRCh37.txt.gz", ".bcf"]


def files(v):
    suffix = F.element_at(F.array(*[F.lit(s) for s in SUFFIXES]), (F.col("event_id") % 10 + 1).cast("int"))
    return v.table("events").select(
        F.col("event_id").alias("file_no"),
        F.concat(F.lit("/data/"), "event_type", F.lit("_"), F.col("user_id").cast("string"), suffix).alias("path"),
    )


@check("pf16_file_class", f"""WITH {FILE_SQL} SELECT file_no, CASE WHEN lower(path) LIKE '%.g.vcf.gz' OR lower(path) LIKE '%.gvcf.gz' OR lower(path) LIKE '%.gvcf' THEN 'gvcf'
   WHEN lower(path) LIKE '%.vcf.gz' OR lower(path) LIKE '%.vcf' OR lower(path) LIKE '%.bcf' THEN 'vcf' WHEN lower(path) LIKE '%.bam' THEN 'bam'
   WHEN lower(path) LIKE '%.cram' THEN 'cram' ELSE '' END AS file_class FROM files""")
def pf16(v):
    return files(v).select("file_no", N.file_class(F.col("path")).alias("file_class"))


@check("pf18_scoring_file_source", f"""WITH {FILE_SQL} SELECT file_no, CASE WHEN contains(path, '_hmPOS_GRCh38') THEN 'harmonized_GRCh38'
   WHEN contains(path, '_hmPOS_GRCh37') THEN 'harmonized_GRCh37' ELSE 'original' END AS source FROM files""")
def pf18(v):
    return files(v).select("file_no", N.scoring_file_source(F.col("path")).alias("source"))


@check("sc40_scoring_build", f"""WITH {FILE_SQL} SELECT file_no, CASE WHEN NOT contains(path, '_GRCh3') THEN 'unknown' WHEN file_no % 3 = 0 THEN 'GRCh38'
   ELSE 'GRCh37' END AS build FROM files""")
def sc40(v):
    columns = F.when(F.col("file_no") % 3 == 0, F.array(F.lit("hm_chr"), F.lit("hm_pos"))).otherwise(F.array(F.lit("chr_position")))
    return files(v).select("file_no", N.scoring_file_build(F.col("path"), columns).alias("build"))


@check("sc43_sample_from_file", f"""WITH {FILE_SQL} SELECT file_no, regexp_replace(regexp_extract(path, '[^/]*$'),
   '\\.(g\\.vcf\\.gz|gvcf\\.gz|vcf\\.gz|g\\.vcf|gvcf|vcf|bcf|bam|cram|gz)$', '', 'i') AS sample_name FROM files""")
def sc43(v):
    return files(v).select("file_no", N.sample_from_file(N.base_name(F.col("path"))).alias("sample_name"))


BUILD_TEXTS = ["GRCh38", "hg19", "hs37d5", "hg38", "unknown", "GRCh37", "hs38DH"]


@check("pf17_header_build", """SELECT event_id AS file_no, CASE WHEN event_id % 11 = 0 THEN '' ELSE CASE (event_id % 7) WHEN 4 THEN ''
   ELSE (['GRCh38','hg19','hs37d5','hg38','','GRCh37','hs38DH'])[event_id % 7 + 1] END END AS declared,
   CASE WHEN event_id % 11 = 0 THEN '' ELSE (['GRCh38','GRCh37','GRCh37','GRCh38','','GRCh37','GRCh38'])[event_id % 7 + 1] END AS build FROM events""")
def pf17(v):
    name = F.element_at(F.array(*[F.lit(b) for b in BUILD_TEXTS]), (F.col("event_id") % 7 + 1).cast("int"))
    head = F.when(F.col("event_id") % 11 == 0, "##source=").when(F.col("event_id") % 2 == 0, "##reference=file:///").otherwise("##contig=<ID=chr1,assembly=")
    declared = N.header_build(F.concat(head, name))
    return v.table("events").select(
        F.col("event_id").alias("file_no"), F.coalesce(declared, F.lit("")).alias("declared"),
        F.coalesce(N.normal_build(declared), F.lit("")).alias("build"),
    )


@check("sc25_header_pairs", """SELECT event_id AS line_no, event_type AS key, concat('x', user_id, '=y') AS value FROM events WHERE event_id % 5 <> 0""")
def sc25(v):
    line = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("chr1\t"), "event_type")).otherwise(
        F.concat(F.lit("#"), "event_type", F.lit("=x"), F.col("user_id").cast("string"), F.lit("=y"))
    )
    return v.table("events").select(F.col("event_id").alias("line_no"), N.header_pairs(line).alias("p")).where(
        "p is not null").select("line_no", "p.key", "p.value")


@check("sc26_build_from_chr1_length", """SELECT s_suppkey AS file_no, (['GRCh38','GRCh37','hg18','unknown'])[s_suppkey % 4 + 1] AS build,
   s_suppkey % 2 = 0 AS has_chr FROM supplier""")
def sc26(v):
    from ..sources.headers import build_from_contigs

    length = F.element_at(F.array(*[F.lit(n) for n, _ in CHR1_LENGTHS], F.lit(1000)), (F.col("s_suppkey") % 4 + 1).cast("int"))
    contigs = v.table("supplier").select(
        F.col("s_suppkey").alias("file_no"),
        F.when(F.col("s_suppkey") % 2 == 0, "chr1").otherwise("1").alias("contig"), length.alias("length"),
    )
    return build_from_contigs(contigs, ["file_no"])


@check("sc36_score_id_check", """SELECT event_id, (event_id % 3 <> 1 AND user_id >= 0) AS valid, upper(CASE event_id % 3 WHEN 0 THEN concat('PGS', lpad(CAST(event_id AS VARCHAR), 9, '0'))
   WHEN 1 THEN concat('PGS', user_id % 100000) ELSE concat('pgs', lpad(CAST(event_id AS VARCHAR), 9, '0')) END) AS score_id FROM events""")
def sc36(v):
    e = F.col("event_id")
    padded = F.lpad(e.cast("string"), 9, "0")
    text = F.when(e % 3 == 0, F.concat(F.lit("PGS"), padded)).when(
        e % 3 == 1, F.concat(F.lit("PGS"), (F.col("user_id") % 100000).cast("string"))
    ).otherwise(F.concat(F.lit("pgs"), padded))
    return v.table("events").select("event_id", N.is_score_id(text).alias("valid"), F.upper(text).alias("score_id"))


# ---- columns and keys ---------------------------------------------------------------------------------------------

RAW_SQL = """raw AS (SELECT row_number() OVER () AS rn, l_orderkey, l_linenumber, l_quantity, l_extendedprice,
   CASE l_linenumber WHEN 1 THEN '' WHEN 2 THEN 'NA' ELSE v.chrom END AS hm_chr, concat('chr', v.chrom) AS chr_name,
   CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN 'NA' ELSE CAST(v.pos AS VARCHAR) END AS hm_pos,
   CASE WHEN l_quantity < 3 THEN '' ELSE CAST(v.pos + 5 AS VARCHAR) END AS chr_position,
   CASE WHEN l_returnflag = 'A' THEN '' WHEN l_returnflag = 'N' THEN 'NA' ELSE v.ref END AS other_allele, v.alt AS hm_infer,
   CASE WHEN l_quantity > 48 THEN 'x1' WHEN l_quantity > 46 THEN '' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS effect_weight
   FROM lineitem JOIN v_variant v ON l_partkey = variant_id)"""


def raw_rows(v):
    line, q = F.col("l_linenumber"), F.col("l_quantity")
    return v.lineitem.join(v.variant, F.col("l_partkey") == F.col("variant_id")).select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
        F.when(line == 1, "").when(line == 2, "NA").otherwise(F.col("chrom")).alias("hm_chr"),
        F.concat(F.lit("chr"), "chrom").alias("chr_name"),
        F.when(line == 1, None).when(line == 2, "NA").otherwise(F.col("pos").cast("string")).alias("hm_pos"),
        F.when(q < 3, "").otherwise((F.col("pos") + 5).cast("string")).alias("chr_position"),
        F.when(F.col("l_returnflag") == "A", "").when(F.col("l_returnflag") == "N", "NA").otherwise(F.col("ref")).alias("other_allele"),
        F.col("alt").alias("hm_infer"), F.col("alt").alias("effect_allele"),
        F.when(q > 48, "x1").when(q > 46, "").otherwise(q.cast("int").cast("string")).alias("effect_weight"),
    )


@check("pf1_column_fallback", f"""WITH {RAW_SQL} SELECT chrom, pos, other, count(*) AS n FROM (SELECT
   regexp_replace(CASE WHEN hm_chr IN ('', 'NA') THEN chr_name ELSE hm_chr END, '^chr', '') AS chrom,
   CASE WHEN hm_pos IS NULL OR hm_pos IN ('', 'NA') THEN chr_position ELSE hm_pos END AS pos,
   CASE WHEN other_allele IN ('', 'NA') THEN hm_infer ELSE other_allele END AS other FROM raw) WHERE pos <> '' GROUP BY 1, 2, 3""")
def pf1(v):
    r = raw_rows(v)
    return r.select(
        G.bare_chrom(G.first_present(F.col("hm_chr"), F.col("chr_name"))).alias("chrom"),
        G.first_present(F.col("hm_pos"), F.col("chr_position")).alias("pos"),
        G.first_present(F.col("other_allele"), F.col("hm_infer")).alias("other"),
    ).where("pos is not null").groupBy("chrom", "pos", "other").agg(F.count(F.lit(1)).alias("n"))


@check("pf2_valid_scoring_rows", f"""WITH {RAW_SQL} SELECT count(*) AS n_rows, count(DISTINCT l_orderkey) AS orders, CAST(sum(w) AS DOUBLE) AS weight_sum FROM (
   SELECT *, try_cast(effect_weight AS DOUBLE) AS w, CASE WHEN hm_pos IS NULL OR hm_pos IN ('', 'NA') THEN chr_position ELSE hm_pos END AS p FROM raw) WHERE w IS NOT NULL AND p <> ''""")
def pf2(v):
    from ..sources.scorefile import usable_rows

    r = raw_rows(v).withColumns({
        "chrom": G.first_present(F.col("hm_chr"), F.col("chr_name")),
        "pos": G.first_present(F.col("hm_pos"), F.col("chr_position")).try_cast("bigint"),
        "weight_text": F.col("effect_weight"),
    })
    return usable_rows(r).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("l_orderkey").alias("orders"), F.sum("weight").alias("weight_sum")
    )


@check("pf3_chromosome_names", """SELECT chrom, chr_name, count(*) AS n FROM (SELECT chrom, CASE WHEN chrom = 'MT' THEN 'chrM' ELSE 'chr' || chrom END AS chr_name FROM v_block) GROUP BY 1, 2""")
def pf3(v):
    spelled = F.when(F.col("chrom") == "MT", F.when(F.col("block_id") % 2 == 0, "chrM").otherwise("M")).otherwise(
        F.concat(F.when(F.col("block_id") % 3 == 0, "chr").otherwise(""), F.col("chrom"))
    )
    return v.block.select(G.bare_chrom(spelled).alias("chrom")).select(
        "chrom", G.chr_chrom(F.col("chrom")).alias("chr_name")
    ).groupBy("chrom", "chr_name").agg(F.count(F.lit(1)).alias("n"))


@check("pf4_variant_keys", """SELECT variant_id, concat('chr', chrom, ':', pos) AS position_key, concat(chrom, ':', pos, ':', ref, ':', alt) AS panel_key FROM v_variant""")
def pf4(v):
    return v.variant.select(
        "variant_id", G.position_key(F.col("chrom"), F.col("pos")).alias("position_key"),
        G.allele_key(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt")).alias("panel_key"),
    )


@check("pf5_two_orientations", """WITH o AS (SELECT pgs_id, concat(chrom, ':', pos, ':', effect_allele, ':', other) AS id, effect_allele, weight, 1 AS k FROM (SELECT *, CASE WHEN weight_h = 0 THEN 'N' ELSE other_allele END AS other FROM v_score)
    UNION ALL SELECT pgs_id, concat(chrom, ':', pos, ':', other, ':', effect_allele), effect_allele, weight, 2 FROM (SELECT *, CASE WHEN weight_h = 0 THEN 'N' ELSE other_allele END AS other FROM v_score))
   SELECT pgs_id, count(*) AS n, count(DISTINCT id) AS ids FROM (SELECT DISTINCT pgs_id, id, effect_allele FROM o) GROUP BY 1""")
def pf5(v):
    rows = v.score.withColumn("other_allele", F.when(F.col("weight_h") == 0, None).otherwise(F.col("other_allele")))
    return A.both_orientations(rows).groupBy("pgs_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids")
    )


@check("pf6_strip_symbolic", """SELECT sample_id, chrom, pos, id, gt, regexp_replace(alt_csv, '(,<\\*>|,<NON_REF>|^<\\*>$|^<NON_REF>$)', '') AS alts FROM v_record""")
def pf6(v):
    return v.record.select("sample_id", "chrom", "pos", "id", "gt", F.array_join(G.strip_symbolic(F.col("alts")), ",").alias("alts"))


@check("pf7_ref_block_predicate", """SELECT chrom, min_dp, count(*) AS records, CAST(sum(CASE WHEN alt_csv IN ('<*>', '<NON_REF>') THEN 1 ELSE 0 END) AS BIGINT) AS ref_blocks FROM v_record GROUP BY 1, 2""")
def pf7(v):
    flag = G.is_ref_block(F.col("alts"), F.col("gt"))
    return v.record.groupBy("chrom", "min_dp").agg(F.count(F.lit(1)).alias("records"), F.count_if(flag).alias("ref_blocks"))


@check("pf8_variants_only", """SELECT sample_id, chrom, pos, gt, regexp_replace(alt_csv, ',<\\*>', '') AS alts FROM v_record
   WHERE alt_csv NOT IN ('<*>', '<NON_REF>') AND gt NOT IN ('0/0', './.', '0/.')""")
def pf8(v):
    return A.variants_only(v.record).select("sample_id", "chrom", "pos", "gt", F.array_join("alts", ",").alias("alts"))


@check("pf9_drop_ref_blocks", "SELECT sample_id, chrom, pos, gt, alt_csv FROM v_record WHERE alt_csv NOT IN ('<*>', '<NON_REF>')")
def pf9(v):
    return A.without_ref_blocks(v.record).select("sample_id", "chrom", "pos", "gt", "alt_csv")


PF10_SQL = "SELECT sample_id, chrom, pos, gt FROM v_record WHERE chrom IN ('X', 'Y', 'MT') OR (chrom = '6' AND pos BETWEEN 200000 AND 700000)"
PF10_REGIONS = [("X", None, None), ("Y", None, None), ("MT", None, None), ("6", 200000, 700000)]


@check("pf10_region_filter", PF10_SQL)
def pf10(v):
    return v.record.where(in_regions(PF10_REGIONS)).select("sample_id", "chrom", "pos", "gt")


@check("pf10_stored_regions", PF10_SQL)
def pf10_stored(v):
    """The same from records stored by place: folders and row groups outside the regions are not read."""
    place = shared_folder(v.spark, "records-by-place")
    LY.write_by_place(v.record, place)
    return LY.read_regions(v.spark, place, PF10_REGIONS).select("sample_id", "chrom", "pos", "gt")


@check("pf13_variant_class", """SELECT variant_id, CASE WHEN length(ref) = length(alt) THEN 'snv' ELSE 'indel' END AS variant_class,
   CASE WHEN length(ref) > length(alt) THEN 'deletion' WHEN length(ref) < length(alt) THEN 'insertion' ELSE '' END AS indel_kind FROM v_variant""")
def pf13(v):
    r, a = F.col("ref"), F.col("alt")
    return v.variant.select("variant_id", G.variant_class(r, a).alias("variant_class"), F.coalesce(G.indel_kind(r, a), F.lit("")).alias("indel_kind"))


@check("pf14_pathogenic", "SELECT variant_id, clnsig FROM v_variant WHERE regexp_matches(clnsig, 'Pathogenic|Likely_pathogenic')")
def pf14(v):
    return v.variant.where(G.is_pathogenic(F.col("clnsig"))).select("variant_id", "clnsig")


@check("pf15_valid_sets", """SELECT chrom, count(*) AS n, CAST(sum(CASE WHEN effect_allele IN ('A','C','G','T') THEN 1 ELSE 0 END) AS BIGINT) AS valid_alleles FROM v_score WHERE chrom NOT IN ('X','Y','MT') GROUP BY 1""")
def pf15(v):
    return v.score.where(F.col("chrom").isin(AUTOSOMES)).groupBy("chrom").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(G.single_base(F.col("effect_allele"))).alias("valid_alleles"))


@check("pf21_half_calls", "SELECT sample_id, variant_id, gt, dosage FROM v_genotype WHERE gt IN ('0/.', './.')")
def pf21(v):
    return v.genotype.where(F.col("gt").contains(".") & F.col("dosage").isNull()).select("sample_id", "variant_id", "gt", "dosage")


# ---- dedupe and sets ----------------------------------------------------------------------------------------------


@check("wn1_first_weight", "SELECT pgs_id, chrom, pos, effect_allele, weight FROM v_score")
def wn1(v):
    rows = v.score_raw.withColumn("weight", F.col("weight_h") / 64)
    return O.distinct_weights(rows, v.SCORE_ORDER).select("pgs_id", "chrom", "pos", "effect_allele", "weight")


@check("wn2_first_call_per_position", """SELECT sample_id, chrom, pos, gt FROM v_call_raw JOIN v_variant USING (variant_id)
   QUALIFY row_number() OVER (PARTITION BY sample_id, chrom, pos ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice) = 1""")
def wn2(v):
    calls = v.call_raw.join(v.variant.select("variant_id", "chrom", "pos"), "variant_id")
    return O.first_call_per_position(calls, v.CALL_ORDER).select("sample_id", "chrom", "pos", "gt")


TARGET_SQL = "targets AS (SELECT DISTINCT chrom, pos FROM v_score UNION SELECT DISTINCT chrom, pos FROM v_panel)"


@check("so1_target_positions", f"WITH {TARGET_SQL} SELECT chrom, pos FROM targets")
def so1(v):
    return A.target_positions(v.score, v.panel)


@check("so4_piece_union", "SELECT chrom, count(*) AS n, CAST(sum(pos) AS BIGINT) AS pos_sum FROM v_record GROUP BY 1")
def so4(v):
    r = v.record
    pieces = r.where(F.col("chrom").isin(AUTOSOMES)).unionByName(r.where(~F.col("chrom").isin(AUTOSOMES)))
    return pieces.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos_sum"))


@check("sl1_natural_order", f"""WITH {TARGET_SQL} SELECT chrom, pos, row_number() OVER (ORDER BY coalesce(try_cast(chrom AS INT), 1000), chrom, pos) - 1 AS place FROM targets""")
def sl1(v):
    from ..operators.running import ordinal

    t = A.target_positions(v.score, v.panel).withColumn("rank", G.chrom_rank(F.col("chrom")))
    # ordered numbers without one global sort: count per chromosome, then per megabase
    per = t.groupBy("rank", "chrom").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    before = F.coalesce(F.sum("n").over(Window.orderBy("rank", "chrom").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = per.select("chrom", before.alias("offset"))
    placed = ordinal(t, ["chrom"], G.whole(F.col("pos"), 1000000), ["pos"], "inside")
    return placed.join(F.broadcast(offsets), "chrom").select("chrom", "pos", (F.col("offset") + F.col("inside")).alias("place"))


@check("sl8_score_ids", "SELECT DISTINCT pgs_id FROM v_score ORDER BY 1")
def sl8(v):
    return v.score.select("pgs_id").distinct().orderBy("pgs_id")


# ---- allele maps ---------------------------------------------------------------------------------------------------

MAP_SQL = """bases AS (SELECT chrom, pos, upper(effect_allele) AS b FROM v_score UNION SELECT chrom, pos, upper(other_allele) FROM v_score),
  amap AS (SELECT chrom, pos, string_agg(DISTINCT b, ',' ORDER BY b) AS alleles FROM bases WHERE b IN ('A','C','G','T') GROUP BY 1, 2)"""


@check("ag6_allele_map", f"WITH {MAP_SQL} SELECT chrom, pos, alleles FROM amap")
def ag6(v):
    return A.allele_map(v.score).select("chrom", "pos", F.array_join("alleles", ",").alias("alleles"))


FILL_SQL = f"""{MAP_SQL}, sites AS (SELECT b.sample_id, v.chrom, v.pos, v.ref, b.gt, b.block_id FROM v_block b JOIN v_variant v ON b.chrom = v.chrom AND v.pos BETWEEN b.pos AND b.end_pos),
  filled AS (SELECT s.*, amap.alleles, (SELECT min(x) FROM unnest(string_split(amap.alleles, ',')) t(x) WHERE x <> s.ref) AS pick FROM sites s LEFT JOIN amap ON amap.chrom = s.chrom AND amap.pos = s.pos)"""


def block_sites(v):
    from ..operators.intervals import interval_join

    sites = v.variant.select("chrom", F.col("pos").alias("site_pos"), F.col("ref").alias("site_ref"))
    blocks = v.block.select("sample_id", "chrom", "pos", "end_pos", "gt", "block_id")
    return interval_join(sites, blocks, "site_pos", "pos", "end_pos").select(
        "sample_id", "chrom", F.col("site_pos").alias("pos"), F.col("site_ref").alias("ref"), "gt", "block_id")


@check("jn13_fill_symbolic_alt", f"WITH {FILL_SQL} SELECT sample_id, chrom, pos, ref, pick AS alt, gt, block_id FROM filled WHERE ref IN ('A','C','G','T') AND pick IS NOT NULL")
def jn13(v):
    return A.fill_symbolic_alt(block_sites(v), A.allele_map(v.score)).select("sample_id", "chrom", "pos", "ref", "alt", "gt", "block_id")


@check("jn14_fill_missing_alt", f"""WITH {FILL_SQL} SELECT sample_id, chrom, pos, ref, coalesce(pick, CASE WHEN ref = 'N' THEN 'A' ELSE 'N' END) AS alt, block_id FROM filled WHERE alleles IS NOT NULL""")
def jn14(v):
    return A.fill_missing_alt(block_sites(v), A.allele_map(v.score)).select("sample_id", "chrom", "pos", "ref", "alt", "block_id")


# ---- scalar rules --------------------------------------------------------------------------------------------------


@check("sc1_genotype_class", """SELECT sample_id, variant_id, CASE WHEN gt = '0/0' THEN 'ref' WHEN gt IN ('1/1','1|1') THEN 'hom' WHEN gt IN ('0/1','0|1','1/0') THEN 'het' ELSE 'unknown' END AS genotype_class FROM v_genotype""")
def sc1(v):
    return v.genotype.select("sample_id", "variant_id", G.genotype_class(F.col("gt")).alias("genotype_class"))


@check("sc2_carries_alt", "SELECT sample_id, variant_id, (contains(gt, '1')) AS carries_alt FROM v_genotype")
def sc2(v):
    return v.genotype.select("sample_id", "variant_id", G.carries_alt(F.col("gt")).alias("carries_alt"))


@check("sc3_allele_dosage", """SELECT sample_id, variant_id, CASE WHEN contains(gt, '.') THEN NULL
    ELSE CASE WHEN substr(gt, 1, 1) = '0' THEN CAST(ref = alt AS INT) ELSE 1 END + CASE WHEN substr(gt, 3, 1) = '0' THEN 0 ELSE 1 END END AS copies FROM v_genotype""")
def sc3(v):
    g = v.genotype.withColumn("alts", F.array("alt", F.lit("<*>")))
    return g.select("sample_id", "variant_id", G.allele_dosage(F.col("ref"), F.col("alts"), F.col("gt"), F.col("alt")).alias("copies"))


@check("sc22_complement", "SELECT variant_id, translate(ref, 'ACGT', 'TGCA') AS ref_flip, translate(alt, 'ACGT', 'TGCA') AS alt_flip FROM v_variant")
def sc22(v):
    return v.variant.select("variant_id", G.complement(F.col("ref")).alias("ref_flip"), G.complement(F.col("alt")).alias("alt_flip"))


@check("sc23_cigar_parse", """WITH c(cigar, n_ops, ops, span) AS (VALUES ('50M', 1, '50M', 50), ('20M2D30M', 3, '20M|2D|30M', 52), ('20M2I28M', 3, '20M|2I|28M', 48),
    ('5S20M2D25M', 4, '5S|20M|2D|25M', 47), ('20M', 1, '20M', 20), ('20M3D30M', 3, '20M|3D|30M', 53), ('25M25M', 2, '25M|25M', 50))
   SELECT sample_id, cigar, n_ops, ops, span, count(*) AS reads FROM v_read JOIN c USING (cigar) GROUP BY ALL""")
def sc23(v):
    r = v.read.withColumn("p", G.parse_cigar(F.col("cigar")))
    text = F.array_join(F.transform("p", lambda o: F.concat(o["n"].cast("string"), o["op"])), "|")
    return r.groupBy("sample_id", "cigar", F.size("p").alias("n_ops"), text.alias("ops"), G.reference_span(F.col("p")).alias("span")).agg(F.count(F.lit(1)).alias("reads"))


@check("sc24_gene_names", """SELECT variant_id, string_agg(DISTINCT g, ',' ORDER BY g) AS genes FROM (SELECT variant_id, split_part(unnest(string_split(geneinfo, '|')), ':', 1) AS g FROM v_variant) GROUP BY 1""")
def sc24(v):
    return v.variant.select("variant_id", F.array_join(F.array_sort(G.gene_names(F.col("geneinfo"))), ",").alias("genes"))


@check("sc38_block_end", "SELECT sample_id, chrom, pos, id, alt_csv, gt, min_dp, coalesce(try_cast(info_end AS BIGINT), pos) AS end_pos FROM v_record")
def sc38(v):
    return v.record.select("sample_id", "chrom", "pos", "id", "alt_csv", "gt", "min_dp", G.block_end(F.col("info_end"), F.col("pos")).alias("end_pos"))


@check("sc42_chromosome_present", """SELECT sample_id, bool_or(chrom = 'X') AS has_x, bool_or(chrom = 'Y') AS has_y FROM v_record GROUP BY 1""")
def sc42(v):
    return v.record.groupBy("sample_id").agg(F.bool_or(F.col("chrom") == "X").alias("has_x"), F.bool_or(F.col("chrom") == "Y").alias("has_y"))

"""Fixed values the results depend on: populations, rule tables, cut-offs, name lists."""

# Code, label, minimum panel size, built from a panel or not.
POPULATIONS = [
    ("EUR", "European", 633, True),
    ("EAS", "East Asian", 585, True),
    ("AFR", "African", 893, True),
    ("SAS", "South Asian", 601, True),
    ("AMR", "Admixed American", 490, True),
    ("MIX", "Mixed (EUR+EAS)", 1170, True),
    ("MID", "Middle Eastern", 0, False),
]
BUILDABLE = [code for code, _, _, buildable in POPULATIONS if buildable]
MIX_PARTS = ("EUR", "EAS")
MIX_SEED = "42"

QUANTILE_PERCENTS = (1, 5, 10, 25, 50, 75, 90, 95, 99)

# Chromosomes, lengths, genome size.
AUTOSOMES = [str(n) for n in range(1, 23)]
SCORE_CHROMS = [*AUTOSOMES, "X", "Y", "MT", "M"]
CHR1_LENGTHS = [(248956422, "GRCh38"), (249250621, "GRCh37"), (247249719, "hg18")]
GENOME_LENGTH = 3088286401
CHR22_LENGTH = 50818468
AUTOSOME_LENGTH = 2881000000

# Sex regions (1-based inclusive) and cut-offs.
SRY_REGION = ("Y", 2786989, 2787603)
CHRY_HOMREF_MALE = 10000
CHRX_HET_FEMALE = 0.30
CHRY_READS_MALE = 500000
SRY_READS_MALE = 10
SRY_DEPTH_MALE = 5
XY_READ_RATIO_MALE = (1.5, 50.0)

# QC ranges.
TITV_RANGE = (1.9, 2.2)
HETHOM_RANGE = (1.3, 2.5)
SNP_RANGE = (3_000_000, 5_000_000)
INDEL_RANGE = (400_000, 1_000_000)

# Read filters and pileup cut-offs.
MIN_MAPQ = 20
MIN_BASEQ = 20
MIN_DEPTH = 8
FLAG_UNMAPPED, FLAG_SECONDARY, FLAG_QC_FAIL, FLAG_DUPLICATE, FLAG_SUPPLEMENTARY = 4, 256, 512, 1024, 2048

# Dose of rs429358-C, dose of rs7412-T, diplotype, risk.
APOE_TABLE = [
    (0, 0, "e3/e3", "average"),
    (0, 1, "e2/e3", "~0.6x (slightly reduced)"),
    (0, 2, "e2/e2", "~0.6x (reduced)"),
    (1, 0, "e3/e4", "~3-4x"),
    (1, 1, "e2/e4", "average to slightly elevated"),
    (1, 2, "e1/e2", "unknown (rare)"),
    (2, 0, "e4/e4", "~12-15x"),
    (2, 1, "e1/e4", "unknown (rare)"),
    (2, 2, "e1/e1", "unknown (rare)"),
]

# CYP2D6 star-allele activity; any other allele counts as 1.0.
CYP2D6_ACTIVITY = [
    ("*1", 1.0), ("*2", 1.0), ("*3", 0.0), ("*4", 0.0), ("*5", 0.0), ("*6", 0.0), ("*7", 0.0), ("*8", 0.0),
    ("*9", 0.5), ("*10", 0.25), ("*11", 0.0), ("*12", 0.0), ("*14", 0.0), ("*15", 0.0), ("*17", 0.5),
    ("*29", 0.5), ("*36", 0.0), ("*40", 0.0), ("*41", 0.5), ("*56", 0.0),
]

# Gene, repeat unit, three upper cut-offs, four class names.
REPEAT_TABLE = [
    ("FMR1", "CGG", 44, 54, 200, "Normal", "Intermediate (grey zone)", "Premutation carrier", "Full mutation"),
    ("HTT", "CAG", 26, 35, 39, "Normal", "Intermediate", "Reduced penetrance", "Full penetrance"),
    ("DMPK", "CTG", 34, 49, 150, "Normal", "Mildly expanded", "Premutation", "Classic DM1"),
]
REPEAT_DEFAULT_CUT = 44

# HLA allele, proxy rsID, risk base.
HLA_PROXIES = [
    ("B*57:01", "rs2395029", "G"),
    ("B*58:01", "rs9263726", "C"),
    ("B*15:02", "rs2844682", "G"),
    ("A*31:01", "rs1633021", "C"),
]
HLA_LOCUS_ORDER = ["HLA-A", "HLA-B", "HLA-C", "HLA-DRB1", "HLA-DQB1", "HLA-DPB1"]

# Archaic share range in percent by population.
ARCHAIC_RANGE = [("AFR", 0.0, 0.3), ("EUR", 1.8, 2.4), ("EAS", 1.8, 2.6), ("SAS", 1.7, 2.3), ("AMR", 1.5, 2.0)]

# Callers that a source line may name, and the name for a GATK command line.
VARIANT_CALLERS = ["deepvariant", "gatk", "dragen", "freebayes", "strelka", "octopus"]
GATK_NAME = "GATK HaplotypeCaller"

# File type order by kind of test.
FILE_PREFERENCE = [
    ("default", ["gvcf", "vcf", "bam", "cram"]),
    ("alignment_first", ["bam", "cram", "gvcf", "vcf"]),
    ("reads_only", ["bam", "cram"]),
]
# Tests that only reads can answer, by runner, and categories that prefer reads.
READS_ONLY_RUNNERS = [
    "expansion_hunter", "str_analysis", "cyp2d6", "t1k_hla", "coverage", "ancestry_mt_haplo", "ancestry_y_haplo", "ancestry_hla",
    "sex_y_reads", "sex_sry",
]
ALIGNMENT_FIRST_CATEGORIES = ["sex check", "carrier status", "pharmacogenomics", "monogenic", "ancestry"]
# Provenance of a score.
SCORING_TOOL = "grouped sums of dosage times weight"
REFERENCE_POPULATION = "EUR (European, n=503)"
REFERENCE_PANEL = "1000 Genomes Phase 3 (GRCh38, 3,202 samples)"
SIBLING_SUFFIX_RANK = [("annotated.vcf.gz", 1), ("merged.vcf.gz", 2), ("vcf.gz", 3), ("g.vcf.gz", 4)]

SYMBOLIC_ALTS = ["<*>", "<NON_REF>"]

# Runs of homozygosity.
ROH = {"window": 50, "max_het": 1, "max_missing": 5, "cover_rate": 0.05, "min_snps": 50, "min_kb": 500,
       "kb_per_snp": 50, "max_gap_kb": 1000}
ADMIXTURE_PCS = 4
ADMIXTURE_SCALE = 0.02

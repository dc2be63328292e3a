"""Genomic views over the driver's tables, once as DataFrames and once as portable SQL text."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import genotype as G
from .operators.picks import first_rows, never_broadcast
from .session import written

SLOT = 20000


def _chrom_of(code):
    return (
        F.when(code == 22, "X").when(code == 23, "Y").when(code == 24, "MT")
        .otherwise((code + 1).cast("string"))
    )


def _base(n):
    return F.lit("ACGT").substr(n.cast("int") + 1, F.lit(1))


class Views:
    """Lazy views; nothing is read until a query uses one."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def once(self, *names: str) -> None:
        """Works views out once, as files, for a query that reads them in several places: of a view read with other columns Spark would
        shuffle all again. Views made of others come after these."""
        for name in names:
            self.__dict__[name] = written(getattr(self, name), f"view-{name}")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def lineitem(self) -> DataFrame:
        return self.table("lineitem")

    @cached_property
    def sample(self) -> DataFrame:
        pop = (
            F.when(F.col("r_name") == "AFRICA", "AFR").when(F.col("r_name") == "AMERICA", "AMR")
            .when(F.col("r_name") == "ASIA", "EAS").when(F.col("r_name") == "EUROPE", "EUR").otherwise("SAS")
        )
        places = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return self.table("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("c_custkey").alias("sample_id"), pop.alias("superpop")
        )

    @cached_property
    def variant(self) -> DataFrame:
        k = F.col("p_partkey")
        ref, alt = _base(k % 4), _base((k + 1 + F.col("p_size") % 3) % 4)
        sig = (
            F.when(F.col("p_type") == "PROMO", "Pathogenic").when(F.col("p_type") == "ECONOMY", "Likely_pathogenic")
            .when(F.col("p_type") == "STANDARD", "Conflicting_classifications_of_pathogenicity").otherwise("Benign")
        )
        size = F.col("p_size").cast("string")
        return self.table("part").select(
            k.alias("variant_id"),
            F.concat(F.lit("rs"), k.cast("string")).alias("rsid"),
            _chrom_of(k % 25).alias("chrom"),
            (F.lit(1000) + G.whole(k, 25) * SLOT + F.col("p_size") * 7).cast("bigint").alias("pos"),
            F.when(F.col("p_type") == "LARGE", F.concat(ref, F.lit("GA"))).otherwise(ref).alias("ref"),
            F.when(F.col("p_type") == "LARGE", ref).when(F.col("p_type") == "SMALL", F.concat(ref, F.lit("TG")))
            .otherwise(alt).alias("alt"),
            F.col("p_brand").alias("gene"),
            F.concat(F.col("p_brand"), F.lit(":"), size, F.lit("|Brand#"), size, F.lit(":1")).alias("geneinfo"),
            sig.alias("clnsig"),
        )

    @cached_property
    def call_raw(self) -> DataFrame:
        q = F.col("l_quantity").cast("int")
        gt = F.element_at(
            F.array(*[F.lit(g) for g in ("0/0", "0/1", "1/1", "./.", "0|1", "1|1", "0/.", "1/0")]), q % 8 + 1
        )
        return self.lineitem.join(never_broadcast(self.table("orders")), F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("o_custkey").alias("sample_id"), F.col("l_partkey").alias("variant_id"), gt.alias("gt"),
            q.alias("dp"), "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
        )

    CALL_ORDER = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"]

    @cached_property
    def genotype(self) -> DataFrame:
        # dealt by variant, the first calls are picked where the variants are joined
        calls = first_rows(self.call_raw.repartition("variant_id"), ["sample_id", "variant_id"], self.CALL_ORDER)
        return calls.join(never_broadcast(self.variant), "variant_id").select(
            "sample_id", "variant_id", "rsid", "chrom", "pos", "ref", "alt", "gt", "dp",
            G.alt_dosage(F.col("gt")).alias("dosage"),
        )

    @cached_property
    def score_raw(self) -> DataFrame:
        line = F.col("l_linenumber") % 4
        return self.lineitem.join(never_broadcast(self.variant), F.col("l_partkey") == F.col("variant_id")).select(
            F.concat(F.lit("PGS"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0")).alias("pgs_id"),
            "chrom", "pos",
            F.when(line == 0, F.col("ref")).when(line == 3, "N").otherwise(F.col("alt")).alias("effect_allele"),
            F.when(line == 0, F.col("alt")).otherwise(F.col("ref")).alias("other_allele"),
            (F.round(F.col("l_discount") * 100).cast("int") - 5).alias("weight_h"),
            "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
        )

    SCORE_ORDER = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount"]

    @cached_property
    def score(self) -> DataFrame:
        return first_rows(
            self.score_raw.repartition("chrom", "pos"), ["pgs_id", "chrom", "pos", "effect_allele"], self.SCORE_ORDER
        ).select(
            "pgs_id", "chrom", "pos", "effect_allele", "other_allele",
            (F.col("weight_h") / 64).alias("weight"), "weight_h",
        )

    @cached_property
    def block(self) -> DataFrame:
        k = F.col("o_orderkey")
        pos = F.lit(1000) + G.whole(k, 200) * SLOT + (k % 11) * 30
        return self.table("orders").select(
            F.col("o_custkey").alias("sample_id"), _chrom_of(k % 25).alias("chrom"),
            pos.cast("bigint").alias("pos"), (pos + 500 + (k % 50) * 1000).cast("bigint").alias("end_pos"),
            (k % 40).cast("int").alias("min_dp"), _base(k % 4).alias("ref"), k.alias("block_id"),
            F.when(k % 2 == 0, "<*>").otherwise("<NON_REF>").alias("alt"),
            F.when(k % 17 == 0, "./.").otherwise("0/0").alias("gt"),
        )

    @cached_property
    def record(self) -> DataFrame:
        """Variant calls and reference blocks of every sample as one record table."""
        v = F.col("variant_id")
        calls = self.genotype.select(
            "sample_id", "chrom", "pos", F.lit(None).cast("string").alias("info_end"),
            F.when(v % 3 == 0, ".").otherwise(F.col("rsid")).alias("id"), "ref",
            F.when(v % 5 == 0, F.concat("alt", F.lit(",<*>"))).otherwise(F.col("alt")).alias("alt_csv"),
            "gt", F.col("dp").alias("min_dp"),
        )
        blocks = self.block.select(
            "sample_id", "chrom", "pos", F.col("end_pos").cast("string").alias("info_end"), F.lit(".").alias("id"),
            "ref", F.col("alt").alias("alt_csv"), "gt", "min_dp",
        )
        return calls.unionByName(blocks).withColumn("alts", F.split("alt_csv", ","))

    @cached_property
    def panel(self) -> DataFrame:
        """Dense genotypes: one pooled sample per nation, homozygous over long stretches."""
        slot, code = G.whole(F.col("variant_id"), 25), F.col("variant_id") % 25
        calls = self.lineitem.join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(
            F.col("s_nationkey").alias("sample_id"), F.col("l_partkey").alias("variant_id"),
            F.col("l_quantity").cast("int").alias("q"), *self.CALL_ORDER,
        )
        first = first_rows(calls.repartition("variant_id"), ["sample_id", "variant_id"], self.CALL_ORDER)
        run = (slot % 90 < 80) & ((code + F.col("sample_id")) % 3 == 0)
        dosage = (
            F.when(run, 2 * (F.col("variant_id") % 2)).when(F.col("q") % 20 == 0, None).otherwise(F.col("q") % 3)
        )
        return first.join(never_broadcast(self.variant), "variant_id").select(
            "sample_id", "variant_id", "chrom", "pos", "ref", "alt", dosage.cast("int").alias("dosage")
        )

    @cached_property
    def panel_sample(self) -> DataFrame:
        return self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
            F.col("n_nationkey").alias("sample_id"),
            F.when(F.col("r_name") == "AFRICA", "AFR").when(F.col("r_name") == "AMERICA", "AMR")
            .when(F.col("r_name") == "ASIA", "EAS").when(F.col("r_name") == "EUROPE", "EUR").otherwise("SAS")
            .alias("superpop"),
        )

    @cached_property
    def read(self) -> DataFrame:
        """Aligned reads: the variant's anchor base is the 20th aligned base."""
        cigar = F.element_at(
            F.array(*[F.lit(c) for c in ("50M", "20M2D30M", "20M2I28M", "5S20M2D25M", "20M", "20M3D30M", "25M25M")]),
            F.col("l_linenumber").cast("int"),
        )
        base = (
            F.when(F.col("variant_id") % 5 == 0, F.col("alt")).when(F.col("variant_id") % 5 == 1, F.col("ref"))
            .when(F.col("variant_id") % 5 == 2, G.complement(F.col("ref")))
            .when(F.col("l_returnflag") == "R", F.col("alt")).otherwise(F.col("ref")).substr(1, 1)
        )
        lead = F.when(cigar.startswith("5S"), F.lit("A" * 24)).otherwise(F.lit("A" * 19))
        return self.lineitem.join(never_broadcast(self.variant), F.col("l_partkey") == F.col("variant_id")).select(
            F.when(F.col("l_linestatus") == "F", 1).otherwise(2).alias("sample_id"),
            "chrom", (F.col("pos") - 19).alias("start_pos"), cigar.alias("cigar"),
            F.rpad(F.concat(lead, base, F.lit("TG")), 50, "C").alias("seq"),
            F.col("l_quantity").cast("int").alias("mapq"),
            (F.lit(10) + F.col("l_linenumber") * 6).cast("int").alias("baseq"),
            F.repeat(F.char(F.lit(43) + F.col("l_linenumber") * 6), F.lit(50)).alias("quals"),
            F.when(F.col("l_orderkey") % 2 == 0, 16).otherwise(0).alias("strand_flag"),
            (F.when(F.col("l_orderkey") % 2 == 0, 16).otherwise(0)
             + F.when(F.col("l_orderkey") % 29 == 0, 256).otherwise(0)
             + F.when(F.col("l_orderkey") % 31 == 0, 1024).otherwise(0)
             + F.when(F.col("l_orderkey") % 37 == 0, 2048).otherwise(0)
             + F.when(F.col("l_orderkey") % 41 == 0, 4).otherwise(0)).cast("int").alias("flag"),
            *self.CALL_ORDER,
        )

    @cached_property
    def chain(self) -> DataFrame:
        k = F.col("s_suppkey")
        start = G.whole(k, 25) * 400000
        return self.table("supplier").select(
            _chrom_of(k % 25).alias("chrom"), (start + 1).cast("bigint").alias("src_start"),
            (start + 250000 + (k % 7) * 20000).cast("bigint").alias("src_end"),
            (F.col("s_nationkey") * 137 - 1000).cast("bigint").alias("delta"),
        )

    @cached_property
    def stats(self) -> DataFrame:
        """Reference statistics derived per (supplier, region): some scores have no spread or few samples."""
        pops = {0: "EUR", 1: "EAS", 2: "AFR", 3: "SAS", 4: "AMR", 5: "MIX"}
        pop = F.element_at(
            F.create_map(*[x for k, v in pops.items() for x in (F.lit(k), F.lit(v))]), F.col("l_linenumber") % 6
        )
        h = F.round(F.col("l_discount") * 100).cast("int")
        scale = F.when(F.col("b") % 7 == 0, 10000).otherwise(1)
        return (
            self.lineitem
            .groupBy(
                F.concat(F.lit("PGS"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0")).alias("pgs_id"),
                pop.alias("population"),
            )
            .agg(F.sum(h - 5).alias("a"), F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("int")).alias("b"))
            .select(
                "pgs_id", "population",
                F.when(F.col("a") % 5 == 0, "GRCh37").otherwise("GRCh38").alias("genome_build"),
                (F.col("a") * scale / 10000).alias("mean"),
                (F.col("b") % 9 * scale / 1000).alias("std"),
                ((F.col("b") + F.col("n")) % 120).alias("n_samples"),
                (F.col("b") % 100 / 100).alias("match_rate"),
            )
        )

    @cached_property
    def report(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("task_id"), F.col("user_id").alias("file_id"),
            F.col("event_type").alias("test_id"), F.col("ts").alias("completed_at"),
            F.least(F.col("value"), F.lit(100.0)).alias("match_rate"), "props",
        )


CHROM_SQL = "CASE {k} WHEN 22 THEN 'X' WHEN 23 THEN 'Y' WHEN 24 THEN 'MT' ELSE CAST({k} + 1 AS VARCHAR) END"

VIEW_SQL = {
    "v_sample": """SELECT c_custkey AS sample_id, CASE r_name WHEN 'AFRICA' THEN 'AFR' WHEN 'AMERICA' THEN 'AMR'
        WHEN 'ASIA' THEN 'EAS' WHEN 'EUROPE' THEN 'EUR' ELSE 'SAS' END AS superpop
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "v_variant": f"""SELECT variant_id, concat('rs', variant_id) AS rsid, chrom, pos,
        CASE WHEN p_type = 'LARGE' THEN b || 'GA' ELSE b END AS ref,
        CASE WHEN p_type = 'LARGE' THEN b WHEN p_type = 'SMALL' THEN b || 'TG' ELSE a END AS alt,
        p_brand AS gene, concat(p_brand, ':', p_size, '|Brand#', p_size, ':1') AS geneinfo,
        CASE p_type WHEN 'PROMO' THEN 'Pathogenic' WHEN 'ECONOMY' THEN 'Likely_pathogenic'
          WHEN 'STANDARD' THEN 'Conflicting_classifications_of_pathogenicity' ELSE 'Benign' END AS clnsig
        FROM (SELECT *, p_partkey AS variant_id, {CHROM_SQL.format(k='(p_partkey % 25)')} AS chrom,
            CAST(1000 + (p_partkey // 25) * {SLOT} + p_size * 7 AS BIGINT) AS pos,
            substr('ACGT', CAST(p_partkey % 4 + 1 AS INT), 1) AS b,
            substr('ACGT', CAST((p_partkey + 1 + p_size % 3) % 4 + 1 AS INT), 1) AS a FROM part)""",
    "v_call_raw": """SELECT o_custkey AS sample_id, l_partkey AS variant_id,
        (['0/0','0/1','1/1','./.','0|1','1|1','0/.','1/0'])[CAST(l_quantity AS INT) % 8 + 1] AS gt,
        CAST(l_quantity AS INT) AS dp, l_orderkey, l_linenumber, l_quantity, l_extendedprice
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "v_genotype": """SELECT sample_id, c.variant_id, rsid, chrom, pos, ref, alt, gt, dp,
        CASE WHEN gt IN ('./.', '0/.') THEN NULL WHEN gt = '0/0' THEN 0 WHEN gt IN ('1/1', '1|1') THEN 2 ELSE 1 END AS dosage
        FROM (SELECT * FROM v_call_raw QUALIFY row_number() OVER (PARTITION BY sample_id, variant_id
            ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice) = 1) c
        JOIN v_variant v ON c.variant_id = v.variant_id""",
    "v_score_raw": """SELECT concat('PGS', lpad(CAST(l_suppkey AS VARCHAR), 6, '0')) AS pgs_id, chrom, pos,
        CASE l_linenumber % 4 WHEN 0 THEN ref WHEN 3 THEN 'N' ELSE alt END AS effect_allele,
        CASE l_linenumber % 4 WHEN 0 THEN alt ELSE ref END AS other_allele,
        CAST(round(l_discount * 100) AS INT) - 5 AS weight_h,
        l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount
        FROM lineitem JOIN v_variant ON l_partkey = variant_id""",
    "v_score": """SELECT pgs_id, chrom, pos, effect_allele, other_allele, weight_h / 64.0::DOUBLE AS weight, weight_h
        FROM v_score_raw QUALIFY row_number() OVER (PARTITION BY pgs_id, chrom, pos, effect_allele
            ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount) = 1""",
    "v_block": f"""SELECT sample_id, chrom, pos, pos + 500 + (k % 50) * 1000 AS end_pos, CAST(k % 40 AS INT) AS min_dp,
        substr('ACGT', CAST(k % 4 + 1 AS INT), 1) AS ref, k AS block_id,
        CASE WHEN k % 2 = 0 THEN '<*>' ELSE '<NON_REF>' END AS alt, CASE WHEN k % 17 = 0 THEN './.' ELSE '0/0' END AS gt
        FROM (SELECT o_orderkey AS k, o_custkey AS sample_id, {CHROM_SQL.format(k='(o_orderkey % 25)')} AS chrom,
            CAST(1000 + (o_orderkey // 200) * {SLOT} + (o_orderkey % 11) * 30 AS BIGINT) AS pos FROM orders)""",
    "v_record": """SELECT sample_id, chrom, pos, CAST(NULL AS VARCHAR) AS info_end,
        CASE WHEN variant_id % 3 = 0 THEN '.' ELSE rsid END AS id, ref,
        CASE WHEN variant_id % 5 = 0 THEN alt || ',<*>' ELSE alt END AS alt_csv, gt, dp AS min_dp FROM v_genotype
        UNION ALL SELECT sample_id, chrom, pos, CAST(end_pos AS VARCHAR), '.', ref, alt, gt, min_dp FROM v_block""",
    "v_panel": """SELECT sample_id, variant_id, chrom, pos, ref, alt, CAST(CASE
          WHEN (variant_id // 25) % 90 < 80 AND (variant_id % 25 + sample_id) % 3 = 0 THEN 2 * (variant_id % 2)
          WHEN q % 20 = 0 THEN NULL ELSE q % 3 END AS INT) AS dosage
        FROM (SELECT s_nationkey AS sample_id, l_partkey, CAST(l_quantity AS INT) AS q
            FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
            QUALIFY row_number() OVER (PARTITION BY s_nationkey, l_partkey
              ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice) = 1)
        JOIN v_variant ON l_partkey = variant_id""",
    "v_panel_sample": """SELECT n_nationkey AS sample_id, CASE r_name WHEN 'AFRICA' THEN 'AFR' WHEN 'AMERICA' THEN 'AMR'
        WHEN 'ASIA' THEN 'EAS' WHEN 'EUROPE' THEN 'EUR' ELSE 'SAS' END AS superpop
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "v_read": """SELECT sample_id, chrom, start_pos, cigar,
        rpad(concat(CASE WHEN cigar LIKE '5S%' THEN repeat('A', 24) ELSE repeat('A', 19) END, base, 'TG'), 50, 'C') AS seq,
        mapq, baseq, strand_flag, strand_flag + CASE WHEN l_orderkey % 29 = 0 THEN 256 ELSE 0 END
          + CASE WHEN l_orderkey % 31 = 0 THEN 1024 ELSE 0 END + CASE WHEN l_orderkey % 37 = 0 THEN 2048 ELSE 0 END
          + CASE WHEN l_orderkey % 41 = 0 THEN 4 ELSE 0 END AS flag,
        l_orderkey, l_linenumber, l_quantity, l_extendedprice, base
        FROM (SELECT CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS sample_id, chrom, pos - 19 AS start_pos,
          (['50M','20M2D30M','20M2I28M','5S20M2D25M','20M','20M3D30M','25M25M'])[l_linenumber] AS cigar,
          substr(CASE WHEN variant_id % 5 = 0 THEN alt WHEN variant_id % 5 = 1 THEN ref WHEN variant_id % 5 = 2 THEN translate(ref, 'ACGT', 'TGCA') WHEN l_returnflag = 'R' THEN alt
            ELSE ref END, 1, 1) AS base, CAST(l_quantity AS INT) AS mapq, CAST(10 + l_linenumber * 6 AS INT) AS baseq,
          CASE WHEN l_orderkey % 2 = 0 THEN 16 ELSE 0 END AS strand_flag,
          l_orderkey, l_linenumber, l_quantity, l_extendedprice
          FROM lineitem JOIN v_variant ON l_partkey = variant_id)""",
    "v_chain": f"""SELECT {CHROM_SQL.format(k='(s_suppkey % 25)')} AS chrom, (s_suppkey // 25) * 400000 + 1 AS src_start,
        (s_suppkey // 25) * 400000 + 250000 + (s_suppkey % 7) * 20000 AS src_end,
        CAST(s_nationkey * 137 - 1000 AS BIGINT) AS delta FROM supplier""",
    "v_stats": """SELECT pgs_id, population, CASE WHEN a % 5 = 0 THEN 'GRCh37' ELSE 'GRCh38' END AS genome_build,
        a * sc / 10000.0::DOUBLE AS mean, (b % 9 * sc) / 1000.0::DOUBLE AS std, (b + n) % 120 AS n_samples,
        (b % 100) / 100.0::DOUBLE AS match_rate
        FROM (SELECT *, CASE WHEN b % 7 = 0 THEN 10000 ELSE 1 END AS sc FROM (SELECT concat('PGS', lpad(CAST(l_suppkey AS VARCHAR), 6, '0')) AS pgs_id,
          CASE l_linenumber % 6 WHEN 0 THEN 'EUR' WHEN 1 THEN 'EAS' WHEN 2 THEN 'AFR' WHEN 3 THEN 'SAS' WHEN 4 THEN 'AMR'
            ELSE 'MIX' END AS population,
          CAST(sum(CAST(round(l_discount * 100) AS INT) - 5) AS BIGINT) AS a, CAST(count(*) AS BIGINT) AS n,
          CAST(sum(CAST(l_quantity AS INT)) AS BIGINT) AS b
          FROM lineitem GROUP BY 1, 2))""",
    "v_report": """SELECT event_id AS task_id, user_id AS file_id, event_type AS test_id, ts AS completed_at,
        least(value, 100.0) AS match_rate, props FROM events""",
}


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the view definitions it uses, directly or through other views."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_[a-z_]+\b", text):
            if name in VIEW_SQL and name not in needed:
                visit(VIEW_SQL[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    ctes = [f"{name} AS ({VIEW_SQL[name]})" for name in needed]
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + ",\n".join([*ctes, body[15:]])
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join([*ctes, body[5:]]) if ctes else body
    return f"WITH {','.join(ctes)}\n{body}" if ctes else body

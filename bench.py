"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line.

The genomic tables that the queries work on are derived from the given ones and written once, untimed: what is timed is
the operators over stored tables, each written whole to the noop sink. ``BENCH_RAW=1`` times them with the derivation.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from genocohort.checks.registry import load
from genocohort.fixtures import Views
from genocohort.session import local_session

HEADLINE = [
    "ag1_score_sums",
    "pl2_reference_stats",
    "pl4_polygenic_score",
    "pl4_vcf_to_percentile",
    "pl7_genotypes_at_targets",
    "pl8_pileup_genotypes",
    "pl9_score_from_reads",
    "jn5_variant_lookup",
    "jn7_batch_lookup",
    "pl11_pathogenic_screen",
    "pl12_y_haplogroup",
    "pl15_pca_projection",
    "pl18_runs_of_homozygosity",
    "pl19_sample_qc",
    "pl20_sex_checks",
    "pl1_ingest_weights",
    "jn3_block_expansion",
    "jn25_ld_pairs",
    "wn3_latest_report",
]
TABLES = ["sample", "variant", "call_raw", "genotype", "score_raw", "score", "block", "record", "panel", "read", "chain", "stats", "report"]


def stored_views(spark: SparkSession, sf_dir: str, cpus: int) -> Views:
    """Views whose tables are files, in twice as many parts as there are cores."""
    views, folder = Views(spark, sf_dir), tempfile.mkdtemp(prefix="bench-")
    for name in TABLES:
        getattr(views, name).repartition(2 * cpus).write.parquet(f"{folder}/{name}")
        views.__dict__[name] = spark.read.parquet(f"{folder}/{name}")
    return views


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "genocohort-bench")
    checks = load()
    raw = os.environ.get("BENCH_RAW") == "1"
    views = Views(spark, sf_dir) if raw else stored_views(spark, sf_dir, int(cpus))
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}
    for name in names:
        start = time.time()
        # the sink computes every column and moves nothing to the driver
        checks[name].build(Views(spark, sf_dir) if raw else views).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "genocohort_headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

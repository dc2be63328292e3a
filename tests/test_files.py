"""Readers, writers and arrivals on real files."""

import gzip

from pyspark.sql import functions as F

from genocohort.checks import sources
from genocohort.fixtures import Views
from genocohort.operators.lookup import first_by_id, genotypes_by_position
from genocohort.operators.scoring import match_effect_allele
from genocohort.sources import documents as D
from genocohort.sources import headers as H
from genocohort.sources import layout as LY
from genocohort.sources import reads as RD
from genocohort.sources import scorefile as SF
from genocohort.sources import sinks as S
from genocohort.sources import tables as T
from genocohort.sources import vcf as V
from genocohort.sources.lines import numbered_lines, read_lines
from genocohort.streaming.arrivals import prepare_arrivals
from tests.compare import ROOT

VCF = """##fileformat=VCFv4.2
##reference=file:///data/hg38.fa
##contig=<ID=chr1,length=248956422>
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tNA1
chr1\t100\trs1\tA\tG,<*>\t50\tPASS\tAC=1\tGT:DP:MIN_DP\t0/1:20:18
chr1\t101\t.\tC\t<*>\t.\tPASS\tEND=150\tGT:MIN_DP\t0/0:9
chrM\t7\t.\tT\tC\t.\tPASS\t.\tGT\t1
"""


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    if path.suffix == ".gz":
        with gzip.open(path, "wt") as f:
            f.write(text)
    else:
        path.write_text(text)
    return str(path)


def test_vcf(spark, tmp_path):
    path = put(tmp_path / "P1.g.vcf.gz", VCF)
    rows = V.read_vcf(spark, path).orderBy("line_no").collect()
    assert [(r.sample_id, r.chrom, r.pos, r.end_pos, r.gt, r.min_dp, r.is_ref_block) for r in rows] == [
        ("P1", "1", 100, 100, "0/1", 18, False), ("P1", "1", 101, 150, "0/0", 9, True), ("P1", "MT", 7, 7, "1", None, False)]
    assert V.detect_gvcf(V.read_vcf(spark, path), ["file"]).first().is_gvcf
    facts = H.header_facts(read_lines(spark, path)).first()
    assert (facts.build, facts.n_contigs, facts.has_chr, facts.samples) == ("GRCh38", 1, True, "NA1")


def test_score_files(spark, tmp_path):
    put(tmp_path / "PGS000001" / "PGS000001_hmPOS_GRCh38.txt.gz",
        "#pgs_id=PGS000001\n#genome_build=GRCh37\nrsID\tchr_name\tchr_position\teffect_allele\tother_allele\teffect_weight\thm_chr\thm_pos\n"
        "rs1\t1\t5\tA\tG\t0.5\t1\t10\nrs2\t1\t6\tC\tNA\t0.25\t\t\nrs3\t2\t7\tG\tT\tx\t2\t70\n")
    put(tmp_path / "PGS000002" / "PGS000002_hmPOS_GRCh38.txt.gz",
        "#pgs_id=PGS000002\nchr_name\tchr_position\teffect_allele\teffect_weight\thm_inferOtherAllele\nchrM\t9\tt\t-1e-3\tA\n")
    got = {(r.pgs_id, r.chrom, r.pos, r.effect_allele, r.other_allele, r.weight) for r in SF.read_weights(spark, f"{tmp_path}/PGS*/*.txt.gz").collect()}
    assert got == {("PGS000001", "1", 10, "A", "G", 0.5), ("PGS000002", "MT", 9, "T", "A", -0.001)}
    plan = SF.read_weights(spark, f"{tmp_path}/PGS*/*.txt.gz")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("map_from_arrays(") == 1 and plan.count("element_at(") < 16  # cells are split once a row, not again for every filter on them
    meta = SF.parse_metadata(read_lines(spark, f"{tmp_path}/PGS000001/*")).first().metadata
    assert meta == {"pgs_id": "PGS000001", "genome_build": "GRCh37"}


def test_sam_and_tables(spark, tmp_path):
    path = put(tmp_path / "s.sam", "@HD\tVN:1\nr1\t16\tchr2\t5\t60\t3M\t*\t0\t0\tACG\tIII\n")
    r = RD.read_sam(spark, path).first()
    assert (r.sample_id, r.flag, r.chrom, r.start_pos, r.seq) == ("s", 16, "2", 5, "ACG")
    psam = put(tmp_path / "p.psam", "#IID\tSuperPop\nA\tEUR\nB\tEAS\n")
    assert {tuple(x) for x in T.read_panel_samples(spark, psam).collect()} == {("A", "EUR"), ("B", "EAS")}
    weights = put(tmp_path / "w.tsv", "#CHROM\tID\tREF\tALT\tA1\tPC1\tPC2\n1\t1:77:A:G\tA\tG\tG\t0.5\t-1\n")
    assert T.read_pca_weights(spark, weights, n=2).first().loadings == [0.5, -1.0]


def test_reports_and_logs(spark, tmp_path):
    put(tmp_path / "f1" / "a.json", '{"task_id": "t1", "result": {"status": "passed", "no_report": true}}')
    put(tmp_path / "f1" / "b.json", '{"task_id": ')
    rows = D.read_reports(spark, f"{tmp_path}/*/*.json").collect()
    assert [(r.task_id, r.file_id, r.result.no_report) for r in rows] == [("t1", "f1", True)]
    log = put(tmp_path / "e.jsonl", '{"task_id": "1", "error": "x"}\nnot json\n{"task_id": "2"}\n')
    assert [r.task_id for r in D.read_log(spark, log).collect()] == ["1", "2"]


def test_writers(spark, tmp_path):
    w = spark.createDataFrame([("PGS1", "1", 5, "A", "G", 0.5), ("PGS2", "1", 6, "A", "G", 1.5)], "pgs_id string, chrom string, pos long, effect_allele string, other_allele string, weight double")
    S.write_weights(w, f"{tmp_path}/w")
    S.write_weights(w.where("pgs_id = 'PGS2'").withColumn("weight", F.lit(9.0)), f"{tmp_path}/w")
    assert {(r.pgs_id, r.weight) for r in spark.read.parquet(f"{tmp_path}/w").collect()} == {("PGS1", 0.5), ("PGS2", 9.0)}
    some = spark.createDataFrame([(None, "2", 7, "A", "G", 1.0)], w.schema)
    S.write_weights(some, f"{tmp_path}/w")
    S.write_weights(some, f"{tmp_path}/w")
    assert sorted(str(r.pgs_id) for r in spark.read.parquet(f"{tmp_path}/w").collect()) == ["None", "PGS1", "PGS2"]
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "id int, p string, q string")
    new = spark.createDataFrame([(1, None, "n"), (3, "c", None)], "id int, p string, q string")
    assert {tuple(r) for r in S.merge_keep_old(old, new, ["id"]).collect()} == {(1, "a", "n"), (2, "b", "x"), (3, "c", None)}
    assert {tuple(r) for r in S.merge_replace(old, new, ["id"]).collect()} == {(1, None, "n"), (2, "b", "x"), (3, "c", None)}


def test_folders_of_weights_do_not_grow_with_scores(spark, tmp_path):
    w = spark.range(300).select(F.format_string("PGS%06d", "id").alias("pgs_id"), F.lit("1").alias("chrom"), F.col("id").alias("pos"), F.lit(0.5).alias("weight"))
    S.write_weights(w, f"{tmp_path}/w")
    folders = [f for f in (tmp_path / "w").iterdir() if f.is_dir()]
    assert 1 < len(folders) <= S.WEIGHT_BUCKETS
    assert spark.read.parquet(f"{tmp_path}/w").select("pgs_id").distinct().count() == 300


def test_bucketed_genotypes_join_without_a_shuffle(spark, tmp_path):
    g = spark.createDataFrame([("s", "1", 5, "A", "G", 1)], "sample_id string, chrom string, pos long, ref string, alt string, dosage int")
    w = spark.createDataFrame([("PGS1", "1", 5, "G", "A", 0.5)], "pgs_id string, chrom string, pos long, effect_allele string, other_allele string, weight double")
    S.write_genotypes(g, "bucketed_genotypes", f"{tmp_path}/g", 4)
    S.write_genotypes(w, "bucketed_weights", f"{tmp_path}/w", 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = match_effect_allele(spark.table("bucketed_genotypes"), spark.table("bucketed_weights"), planned=False)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and joined.count() == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE bucketed_genotypes")
        spark.sql("DROP TABLE bucketed_weights")


COHORT = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\tS3\n" + "".join(f"chr1\t{p}\trs{p}\tA\tG\t.\t.\t.\tGT\t0/0\t0/1\t1/1\n" for p in range(100, 400))


def test_samples_of_an_arriving_file_stay_apart(spark, tmp_path):
    """Three samples in one file, its header and body in different tasks; a file without a header mixes nothing either."""
    put(tmp_path / "in" / "cohort.vcf", COHORT)
    put(tmp_path / "in" / "bare.vcf", COHORT.split("S3\n")[1])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        prepare_arrivals(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = {(r.sample_id, r.gt, r["count"]) for r in spark.read.parquet(f"{tmp_path}/out").groupBy("sample_id", "gt").count().collect()}
    assert got == {("S1", "0/0", 300), ("S2", "0/1", 300), ("S3", "1/1", 300), ("bare", "0/0", 300), ("bare#2", "0/1", 300), ("bare#3", "1/1", 300)}


def test_line_numbers_do_not_depend_on_splits(spark, tmp_path):
    text = "".join(f"line {i} {'x' * (i % 37)}\n" for i in range(2000))
    put(tmp_path / "a.txt", text)
    put(tmp_path / "b.txt", "one\n\nthree\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    found = []
    try:
        for size in ("128m", "7000", "501"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = numbered_lines(spark, [f"{tmp_path}/a.txt", f"{tmp_path}/b.txt"]).collect()
            found.append(sorted((r.file.rsplit("/", 1)[1], r.line_no, r.value) for r in rows))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [("a.txt", i, x) for i, x in enumerate(text.splitlines())] + [("b.txt", i, x) for i, x in enumerate(["one", "", "three"])]
    assert found == [want] * 3


def test_the_last_line_of_a_position_wins(spark, tmp_path):
    """File order, not spelling: 1/1 stands before 0/1."""
    head, rows = COHORT.split("S1\t")[0] + "S1\n", ["chr1\t5\trs5\tA\tT\t.\t.\t.\tGT\t1/1", "chr1\t5\trs5\tA\tG\t.\t.\t.\tGT\t0/1"]
    for name, order in (("p", rows), ("q", rows[::-1])):
        put(tmp_path / f"{name}.vcf", head + "\n".join(order) + "\n")
    records = V.read_vcf(spark, f"{tmp_path}/*.vcf")
    got = {r.sample_id: r.gt for r in genotypes_by_position(records.select("sample_id", "chrom", "pos"), records).collect()}
    assert got == {"p": "0/1", "q": "1/1"}
    assert {r.sample_id: r.gt for r in first_by_id(records).collect()} == {"p": "1/1", "q": "0/1"}


def test_each_arriving_file_counts_once(spark, tmp_path):
    source, target, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    put(tmp_path / "in" / "A.vcf", VCF)
    prepare_arrivals(spark, source, target, state)
    prepare_arrivals(spark, source, target, state)
    assert spark.read.parquet(target).count() == 3
    put(tmp_path / "in" / "B.vcf", VCF)
    prepare_arrivals(spark, source, target, state)
    assert {(r.sample_id, r["count"]) for r in spark.read.parquet(target).groupBy("sample_id").count().collect()} == {("A", 3), ("B", 3)}


def scan_metrics(df):
    """(files, rows) that the only scan of an executed plan has read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaf = (plan.executedPlan() if plan.nodeName().startswith("Adaptive") else plan).collectLeaves().head()
    return tuple(leaf.metrics().apply(name).value() for name in ("numFiles", "numOutputRows"))


def test_a_panel_of_ten_sites_skips_files_and_row_groups(spark, tmp_path):
    n = 400_000
    rows = spark.range(n).select(
        (F.col("id") % 50).alias("sample_id"), F.element_at(F.array(*[F.lit(c) for c in ("1", "2", "X")]), (F.col("id") % 3 + 1).cast("int")).alias("chrom"),
        (F.col("id") * 397 % 150_000_000).alias("pos"), F.concat(F.lit("rs"), F.col("id").cast("string")).alias("id"))
    place = f"{tmp_path}/records"
    LY.write_by_place(rows, place, row_group_bytes=1 << 16)
    every = scan_metrics(spark.read.parquet(place))
    asked = rows.where("chrom = '2'").orderBy("pos").limit(10)
    panel = spark.createDataFrame([(r.chrom, r.pos) for r in asked.collect()], "chrom string, pos long")
    found = LY.read_at_sites(spark, place, panel)
    got = scan_metrics(found)
    assert found.count() == 10 and every[1] == n
    assert got[0] <= every[0] / 10 and got[1] <= n / 20
    near = LY.read_at_sites(spark, place, panel.limit(1), reach=2_000_000)
    low = panel.first().pos
    assert near.count() == rows.where(F.col("chrom").eqNullSafe("2") & F.col("pos").between(low - 2_000_000, low)).count()
    by_id = LY.read_ids(spark, place, ["rs123456", "no such id"])
    assert [r.id for r in by_id.collect()] == ["rs123456"] and scan_metrics(by_id)[1] <= n / 10


def test_a_large_panel_is_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(LY, "MOST_NAMED", 2)
    rows = spark.range(3000).select(F.lit("7").alias("chrom"), (F.col("id") * 40_000).alias("pos"), F.lit("x").alias("id"))
    LY.write_by_place(rows, f"{tmp_path}/r")
    panel = rows.where("pos % 1200000 = 0").select("chrom", "pos")
    assert LY.read_at_sites(spark, f"{tmp_path}/r", panel).count() == panel.count()
    reach = LY.read_at_sites(spark, f"{tmp_path}/r", panel, reach=80_000).select("pos").collect()
    assert sorted(r.pos for r in reach) == sorted({p.pos - d for p in panel.collect() for d in (0, 40_000, 80_000) if p.pos >= d})


def test_arriving_lots_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """A lot is no one task's to sort and write; the cohort's file stays whole, with its header first."""
    monkeypatch.setattr(sources, "shared_folder", lambda _, name: str(tmp_path / name))
    given = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = sources.st1(Views(spark, f"{ROOT}/sf0.001")).groupBy("lot", "sample_id").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", given)
    assert {(r.lot, r.sample_id) for r in rows} == {*((str(i), "file") for i in range(4)), *(("4", f"h{i}") for i in range(6))}
    assert all(len([*(tmp_path / f"arrivals/lot={i}").glob("part-*")]) > 4 for i in range(4))
    (cohort,) = (tmp_path / "arrivals/lot=4").glob("part-*")
    assert cohort.read_text().startswith("#CHROM")

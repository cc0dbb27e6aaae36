"""The facade over a small store, and the command line's errors."""

import gzip

import pytest

from tracklake import build, cli
from tracklake.facade import Dataset
from tracklake.plans.store import Store


def test_facade(spark, tmp_path):
    cov = spark.createDataFrame([("chr1", 0, 4, s, "*", v) for s, v in (("s1", 1), ("s2", 2))], "contig string, start bigint, end bigint, sample string, strand string, value bigint")
    made = Store.create(spark, tmp_path / "st", spark.createDataFrame([("chr1", 4)], "contig string, length bigint"), ["s1", "s2"])
    own = spark.createDataFrame([("chr1", 0, 2), ("chr1", 2, 4)], "Chromosome string, Start bigint, End bigint")
    for s in ("s1", "s2"):
        made.write_table(cov, "coverage", s)
    made.commit("s1", 1_000_000)
    data = Dataset.open(spark, tmp_path / "st")
    assert [(r["sample"], r["sum"]) for r in data.reduce(ranges_df=own).orderBy("range_index").collect()] == [("s1", 2), ("s1", 2)]
    assert [r["sum"] for r in data.normalise(data.reduce(ranges_df=own), "cpm").collect()] == [2.0, 2.0]
    assert data.n_completed == 1 and data.region("chr1:1-3").where("sample = 's1'").first()["end"] == 3
    for bad in ({"samples": ["x"]}, {"samples": ["s2"]}):
        with pytest.raises(ValueError):
            data.reduce(ranges_df=own, **bad)
    with pytest.raises(ValueError):
        data.reduce(ranges_df=own.replace("chr1", "chr9"))
    with pytest.raises(RuntimeError):
        data.count_methylation(ranges_df=own)


def test_command_line_reports_failure(spark, tmp_path):
    assert cli.main(["combine-metadata", str(tmp_path / "none.csv"), "--output", str(tmp_path / "o.csv")]) == 1
    (tmp_path / "a.csv").write_text("sample_id,r1,x\na,f,1\n")
    assert cli.main(["combine-metadata", str(tmp_path / "a.csv"), "--output", str(tmp_path / "o.csv")]) == 0
    assert (tmp_path / "o.csv").read_text() == "sample_id,x\na,1\n"


def methylation(tmp_path):
    (tmp_path / "s1.bedGraph").write_text("chr1\t100\t101\t75\t1\t3\nchr1\t200\t201\t75\t1\t3\nchr2\t50\t51\t75\t1\t3\n")
    (tmp_path / "s2.bedGraph").write_text("chr1\t200\t201\t50\t1\t3\nchr1\t400\t401\t50\t1\t3\nscaffold1\t5\t6\t1\t1\t1\n")
    (tmp_path / "s3.num_mc_cxreport.txt").write_text("chr1\t100\t+\t5\t5\tCG\tCGA\nchr1\t101\t-\t3\t7\tCG\tCGA\nchr1\t300\t+\t2\t8\tCG\tCGA\n")
    (tmp_path / "s3.num_hmc_cxreport.txt").write_text("chr1\t100\t+\t1\t9\tCG\tCGA\nchr1\t101\t-\t2\t8\tCG\tCGA\n")
    head = "##x\n#CHROM\tPOS\n"
    with gzip.open(tmp_path / "v1.vcf.gz", "wt") as f:
        f.write(head + "chr1\t100\t.\tA\tT\t30\tPASS\t.\tGT:AD\t0/1:10,5\nchr1\t200\t.\tC\tG\t30\tPASS\t.\tGT:AD\t1/1:0,9\n")
    with gzip.open(tmp_path / "v2.vcf.gz", "wt") as f:
        f.write(head + "chr1\t200\t.\tC\tA\t30\tPASS\t.\tGT:AD\t0/1:4,4\n")
    for name in ("v1", "v2"):
        (tmp_path / f"{name}.vcf.gz.tbi").write_text("i")


def test_study_of_methylation_and_variants(spark, tmp_path):
    methylation(tmp_path)
    at = lambda *names: [str(tmp_path / n) for n in names]
    study = build.create_dataset(
        spark, tmp_path / "st", bedgraph_files=at("s1.bedGraph", "s2.bedGraph"), mc_files=at("s3.num_mc_cxreport.txt"), hmc_files=at("s3.num_hmc_cxreport.txt"), vcf_files=at("v1.vcf.gz", "v2.vcf.gz"),
        metadata=spark.createDataFrame([("s1", "a"), ("v2", "b")], "sample_id string, batch string"),
    )
    assert study.modalities == ["methylation", "variants"] and study.sample_names == ["s1", "s2", "s3", "v1", "v2"] and study.contigs == ["chr1", "chr2"]
    assert {(r["sample_id"], r["batch"]) for r in study.metadata().collect() if r["batch"]} == {("s1", "a"), ("v2", "b")}
    m = study.methylation
    assert m.n_completed == 3 and sorted(tuple(r) for r in m.positions("methylation").collect()) == [("chr1", 100), ("chr1", 200), ("chr1", 300), ("chr1", 400), ("chr2", 50)]
    rows = {(r["sample"], r["pos"]): r for r in m.sites("methylation", "chr1:100-401", dense=True).collect()}
    assert len(rows) == 12 and rows["s1", 400]["n_mc"] == 0 and rows["s1", 400]["methylation_pct"] is None and rows["s1", 100]["n_mc"] == 3
    merged = rows["s3", 100]
    assert (merged["n_mc"], merged["n_hmc"], merged["n_c"], round(merged["methylation_pct"], 9)) == (8, 3, 9, 55.0)
    assert (rows["s3", 300]["n_mc"], rows["s3", 300]["n_hmc"], rows["s3", 300]["n_c"]) == (2, 0, 8)  # the hmC report lacks it
    v = study.variants
    assert sorted(tuple(r) for r in v.alleles().collect()) == [("chr1", 100, "A", "T"), ("chr1", 200, "C", "G")]
    dense = {(r["sample"], r["pos"]): (r["genotype"], r["ad_ref"], r["ad_alt"]) for r in v.sites("variants", "chr1:100-200", dense=True).collect()}
    assert dense == {("v1", 100): (1, 10, 5), ("v1", 200): (2, 0, 9), ("v2", 100): (-1, 0, 0), ("v2", 200): (1, 4, 4)}
    again = build.create_dataset(spark, tmp_path / "st", resume=True, bedgraph_files=at("s1.bedGraph", "s2.bedGraph"), mc_files=at("s3.num_mc_cxreport.txt"), hmc_files=at("s3.num_hmc_cxreport.txt"))
    assert again.methylation.n_completed == 3
    with pytest.raises(FileExistsError):
        build.create_dataset(spark, tmp_path / "st", vcf_files=at("v1.vcf.gz"))


def test_checks_before_a_build(spark, tmp_path):
    methylation(tmp_path)
    at = lambda *names: [str(tmp_path / n) for n in names]
    (tmp_path / "e.bam").write_text("")
    (tmp_path / "n.bam").write_text("x")
    (tmp_path / "plain.vcf").write_text("x")
    for kind, files in ((FileNotFoundError, {"bam_files": at("none.bam")}), (ValueError, {"bam_files": at("e.bam")}), (FileNotFoundError, {"bam_files": at("n.bam")}), (ValueError, {"vcf_files": at("plain.vcf")}), (ValueError, {}),
                        (ValueError, {"bedgraph_files": at("s1.bedGraph"), "cx_files": at("s2.bedGraph")}), (ValueError, {"bedgraph_files": at("s1.bedGraph"), "bedgraph_names": ["a", "b"]}),
                        (ValueError, {"bedgraph_files": at("s1.bedGraph", "s2.bedGraph"), "bedgraph_names": ["a", "a"]}), (ValueError, {"bedgraph_files": at("s1.bedGraph"), "bedgraph_names": ["s3"], "mc_files": at("s3.num_mc_cxreport.txt")})):
        with pytest.raises(kind):
            build.create_dataset(spark, tmp_path / "no", **files)


def test_regions_of_a_store(spark, tmp_path):
    cov = spark.createDataFrame([("chr1", 0, 6, s, "*", v) for s, v in (("s1", 1), ("s2", 2), ("s3", 3))], "contig string, start bigint, end bigint, sample string, strand string, value bigint")
    made = Store.create(spark, tmp_path / "st", spark.createDataFrame([("chr1", 8)], "contig string, length bigint"), ["s1", "s2", "s3"])
    for s in ("s1", "s2", "s3"):
        made.write_table(cov, "coverage", s)
    made.commit("s1", 1_000_000)
    made.commit("s2", 2_000_000)
    data = Dataset.open(spark, tmp_path / "st")
    assert sorted((r["sample"], r["value"]) for r in data.region("chr1:2-4", method="cpm").collect()) == [("s1", 1.0), ("s2", 1.0)]
    assert sorted((r["sample"], r["value"]) for r in data.region("chr1:2-4", [1], method="rpkm").collect()) == [("s2", 1000.0)]
    with pytest.raises(RuntimeError):
        data.region("chr1", ["s3"])
    with pytest.raises(ValueError):
        data.region("chr1", method="tpm")
    assert data.region("chr1", ["s3"], include_incomplete=True).count() == 1
    assert data.whole("chr1").count() == 16 and data.whole("chr1", ["s1"]).groupBy().sum("value").first()[0] == 6
    assert {r["kind"] for r in data.locus("chr1:0-4").collect()} == {"coverage"}

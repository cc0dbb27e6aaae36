"""Closed-form fixtures and brute force."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklake.operators import intervals, peaks, ranges, signal, stats
from tracklake.plans import store
from tracklake.schema import Anchor
from tracklake.sources import bam, text


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def constant(spark):
    cov = frame(spark, [(c, 0, n, s, "*", v) for c, n in (("chr1", 4), ("chr2", 3)) for s, v in (("s1", 1), ("s2", 2))], "contig string, start bigint, end bigint, sample string, strand string, value bigint")
    return cov, frame(spark, [("chr1", 4), ("chr2", 3)], "contig string, length bigint"), frame(spark, [(0, "s1"), (1, "s2")], "sample_idx int, sample_id string")


def test_constant_store(spark):
    cov, contigs, samples = constant(spark)
    one = frame(spark, [(0, "chr1", 0, 4)], "range_index bigint, contig string, start bigint, end bigint")
    found = {r["sample"]: (r["sum"], r["max"], r["min"], r["median"]) for r in signal.reduce_ranges(cov, one, contigs, samples, ["max", "min", "median"]).collect()}
    assert found == {"s1": (4, 1, 1, 1.0), "s2": (8, 2, 2, 2.0)}


def test_windows_beyond_the_contig(spark):
    cov = frame(spark, [("chr1", i, i + 1, "s1", "*", i) for i in range(1, 100)], "contig string, start bigint, end bigint, sample string, strand string, value bigint")
    contigs, samples = frame(spark, [("chr1", 100)], "contig string, length bigint"), frame(spark, [(0, "s1")], "sample_idx int, sample_id string")
    one = frame(spark, [(0, "chr1", 0, 10)], "range_index bigint, contig string, start bigint, end bigint")
    found = signal.extract_windows(cov, one, contigs, samples, fixed_width=20, bin_size=10, bin_agg="median").orderBy("bin").collect()
    assert [r["value"] for r in found] == [2.0, 9.5]
    with pytest.raises(ValueError, match="divisible"):
        signal.extract_windows(cov, one, contigs, samples, fixed_width=25, bin_size=10)


def test_subtract_and_overlap_by_brute_force(spark):
    rng = random.Random(3)
    make = lambda n: [(i, "chr1", s := rng.randrange(5000), s + rng.randrange(1, 900)) for i in range(n)]
    left, holes = make(40), make(25)
    schema = "range_index bigint, contig string, start bigint, end bigint"
    a, b = frame(spark, left, schema), frame(spark, holes, schema)
    pairs = {(r["range_index"], r["r_range_index"]) for r in intervals.overlap_join(a, b, 256).collect()}
    assert pairs == {(x[0], y[0]) for x in left for y in holes if x[2] < y[3] and y[2] < x[3]}
    kept = {}
    for r in intervals.subtract(a, b, 256).collect():
        kept.setdefault(r["range_index"], set()).update(range(r["start"], r["end"]))
    covered = {p for _, _, s, e in holes for p in range(s, e)}
    assert kept == {i: left_ for i, _, s, e in left if (left_ := set(range(s, e)) - covered)}


def test_peaks_and_windows(spark):
    tiles = frame(spark, [("s", "chr1", 100 * i, 100 * i + 100, float(x)) for i, x in enumerate((0, 1, 5, 10, 1, 0))], "sample string, contig string, start bigint, end bigint, signal double")
    assert [(r["start"], r["end"]) for r in peaks.quantile_peaks(tiles, 0.95).collect()] == [(300, 400)]
    assert peaks.quantile_peaks(tiles, 1.0).count() == 0
    assert intervals.fixed_windows(frame(spark, [("chr1", 1100)], "contig string, length bigint"), 500).count() == 3


def test_region_strings_and_names():
    assert ranges.parse_region("chr1:1,000-2,000") == ("chr1", 1000, 2000)
    for bad in ("chr1:5", "chr1:9-3", "chr1:-1-3"):
        with pytest.raises(ValueError):
            ranges.parse_region(bad)
    assert Anchor.of("START") is Anchor.START
    with pytest.raises(ValueError):
        Anchor.of("middle")
    assert store.library_types({"a": "R"}, ["a", "b"]) == {"a": "R", "b": None}
    with pytest.raises(ValueError):
        store.library_types({"c": "R"}, ["a"])


def test_bedgraph_and_gtf(spark, tmp_path):
    (tmp_path / "m.bedGraph").write_text("track type=bedGraph\nchr1\t100\t101\t75.0\t1\t3\nchr1_alt\t5\t6\t10\t1\t1\n")
    assert [tuple(r) for r in text.read_bedgraph(spark, tmp_path / "m.bedGraph", "s").collect()] == [("chr1", 100, "s", 75.0, 3, 1)]
    (tmp_path / "g.gtf").write_text('chr1\tx\tgene\t1001\t2000\t.\t+\t.\tgene_id "G1"; gene_name "A b";\n')
    row = text.read_gtf(spark, str(tmp_path / "g.gtf")).first()
    assert (row["start"], row["end"], row["gene_id"], row["gene_name"]) == (1000, 2000, "G1", "A b")


def bgzf(data):
    body = zlib.compressobj(6, zlib.DEFLATED, -15)
    raw = body.compress(data) + body.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(raw) + 25) + raw + struct.pack("<II", zlib.crc32(data), len(data))


def test_bam(spark, tmp_path):
    def record(pos, flag, cigar, name=b"r\0"):
        body = struct.pack("<iiBBHHHiiii", 0, pos, len(name), 30, 0, len(cigar), flag, 0, -1, -1, 0) + name + struct.pack(f"<{len(cigar)}I", *(n << 4 | op for n, op in cigar))
        return struct.pack("<i", len(body)) + body

    head = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    data = head + record(10, 0, [(5, 0), (3, 3), (4, 0)]) + record(12, 16, [(6, 0)], b"q\0") + record(0, 4, [], b"u\0") + record(500, 0x100, [(7, 0)]) + record(600, 0x800 | 0x10, [(5, 0)])
    path = tmp_path / "x.bam"
    path.write_bytes(bgzf(data[:40]) + bgzf(data[40:]) + bgzf(b""))
    assert bam.header(str(path)) == [("chr1", 1000)]
    reads = bam.read_bam(spark, str(path))
    found = signal.sweep(bam.coverage_blocks(reads, "s")).orderBy("start").collect()
    assert [(r["start"], r["end"], r["value"]) for r in found] == [(10, 12, 1), (12, 15, 2), (15, 22, 1), (500, 507, 1), (600, 605, 1)]
    # all mapped records count, secondary and supplementary ones too; stranded coverage has the primary ones only
    assert bam.mapped_reads(reads).first()["total_reads"] == 4
    for library, own, other in (("U", "+", "-"), ("F", "+", "-"), ("R", "-", "+")):
        sides = {(r["strand"], r["start"]): r["value"] for r in signal.sweep(bam.coverage_blocks(reads, "s", library)).collect()}
        assert sides[own, 10] == 1 and sides[other, 12] == 1 and (own, 500) not in sides and (other, 600) not in sides
    mates = record(10, 0x1 | 0x40, [(5, 0)]) + record(30, 0x1 | 0x80 | 0x10, [(5, 0)])
    path.write_bytes(bgzf(head + mates) + bgzf(b""))
    for library, strand in (("F", "+"), ("R", "-")):  # both mates of a pair are on one strand
        assert {r["strand"] for r in bam.coverage_blocks(bam.read_bam(spark, str(path)), "s", library).where("strand <> '*'").collect()} == {strand}


def test_store_commits_and_resumes(spark, tmp_path):
    cov, contigs, _ = constant(spark)
    made = store.Store.create(spark, tmp_path / "st", contigs, ["s1", "s2"])
    made.write_table(cov, "coverage", "s1")
    made.commit("s1", 7)
    assert made.pending(["s1", "s2"]) == ["s2"]
    again = store.Store.create(spark, tmp_path / "st", contigs, ["s1", "s2"], resume=True)
    assert again.table("coverage").count() == 2
    again.update_metadata("assay", {"s1": "chip"})
    assert [(r["sample_id"], r["assay"], r["completed"]) for r in again.metadata().collect()] [0] == ("s1", "chip", True)
    with pytest.raises(FileExistsError):
        store.Store.create(spark, tmp_path / "st", contigs, ["s1", "s2"])


def test_missing_values_in_matrices(spark):
    m = frame(spark, [(f, s, v) for f, vs in enumerate(((1.0, 2.0, 4.0), (None, 3.0, 5.0), (None, None, 1.0))) for s, v in enumerate(vs)], "feature int, sample int, value double")
    assert stats.handle_missing(m, "drop").count() == 3
    assert sorted(r["value"] for r in stats.handle_missing(m, "mean").collect()) == [1.0, 2.0, 3.0, 4.0, 4.0, 5.0]
    with pytest.raises(ValueError):
        stats.handle_missing(m, "other")


def test_pca_against_svd(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(9, 6))  # features by samples
    m = frame(spark, [(f, s, float(x[f, s])) for f in range(9) for s in range(6)], "feature int, sample int, value double")
    scores, ratios = stats.pca(m, 3)
    u, d, _ = np.linalg.svd((x - x.mean(1, keepdims=True)).T, full_matrices=False)
    for r in scores.collect():
        k = r["component"] - 1
        assert abs(abs(r["score"]) - abs(u[r["sample"], k] * d[k])) < 1e-9
    want = d[:3] ** 2 / (d ** 2).sum()
    assert np.allclose([r["ratio"] for r in ratios.orderBy("component").collect()], want)
    assert np.allclose([r["cumulative"] for r in stats.scree(ratios).orderBy("component").collect()], np.cumsum(want))


def test_joins_of_mixed_lengths(spark):
    # lengths from one base to a whole contig on both sides, by brute force
    rng = random.Random(12)
    make = lambda n: [(i, f"chr{rng.randrange(2)}", s := rng.randrange(10**6), s + rng.choice((1, 5, 90, 3000, 70_000, 10**6))) for i in range(n)]
    left, right = make(120), make(150)
    schema = "range_index bigint, contig string, start bigint, end bigint"
    a, b = frame(spark, left, schema), frame(spark, right, schema)
    want = sorted((x[0], y[0]) for x in left for y in right if x[1] == y[1] and x[2] < y[3] and y[2] < x[3])
    for width in (None, 64):
        assert sorted((r["range_index"], r["r_range_index"]) for r in intervals.overlap_join(a, b, width).collect()) == want
    short = a.where("end - start < 100")
    assert sorted((r["range_index"], r["r_range_index"]) for r in intervals.overlap_join(short, b).collect()) == [p for p in want if left[p[0]][3] - left[p[0]][2] < 100]
    points = frame(spark, [(c, p) for c in ("chr0", "chr1") for p in range(0, 10**6, 9973)], "contig string, pos bigint")
    got = sorted((r["contig"], r["pos"], r["r_range_index"]) for r in intervals.point_join(points, b).collect())
    assert got == sorted((c, p, y[0]) for c in ("chr0", "chr1") for p in range(0, 10**6, 9973) for y in right if y[1] == c and y[2] <= p < y[3])


def test_joins_broadcast_no_intervals(spark, tmp_path):
    # a side's rows are listed in many bins, which Spark's estimate of its size does not know
    frame(spark, [(i, "chr1", 7 * i, 7 * i + 90) for i in range(50)], "range_index bigint, contig string, start bigint, end bigint").write.parquet(str(tmp_path / "a"))
    a = spark.read.parquet(str(tmp_path / "a"))
    for found in (intervals.annotate(a, a, require_overlap=False), intervals.point_join(a.select("contig", F.col("start").alias("pos")), a)):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def runs(spark, rng, wide):
    """Segments of three samples on two contigs, gaps between them, and the dense arrays."""
    rows, dense = [], {}
    for c, s, strand in ((c, s, t) for c in ("chr1", "chr2") for s in ("a", "b", "c") for t in "+-*"):
        at, line = 0, dense.setdefault((c, s, strand), np.zeros(400))
        while (at := at + rng.choice((0, 0, 1, 5))) < 400:
            n, v = rng.randrange(1, wide), rng.randrange(1, 5)
            line[at:at + n] = v
            rows.append((c, at, min(at + n, 400), s, strand, v))
            at += n
    return frame(spark, rows, "contig string, start bigint, end bigint, sample string, strand string, value bigint"), dense


@pytest.mark.parametrize("part_bytes", [1500, 8 << 20])
def test_reductions_and_windows_by_brute_force(spark, monkeypatch, part_bytes, tmp_path):
    monkeypatch.setattr(intervals, "PART_BYTES", part_bytes)
    rng = random.Random(5)
    cov, dense = runs(spark, rng, 9)
    cov.coalesce(1).write.parquet(str(tmp_path / "cov"))
    cov = spark.read.parquet(str(tmp_path / "cov"))
    rows = [(i, rng.choice(("chr1", "chr2")), s := rng.randrange(-5, 395), s + rng.randrange(1, 60), rng.choice("+-")) for i in range(40)]
    made = frame(spark, rows, "range_index bigint, contig string, start bigint, end bigint, strand string")
    contigs, samples = frame(spark, [("chr1", 400), ("chr2", 400)], "contig string, length bigint"), frame(spark, [("a",), ("b",), ("c",)], "sample_id string")
    names = ["sum", "mean", "max", "min", "median"]
    of = {"sum": np.sum, "mean": np.mean, "max": np.max, "min": np.min, "median": np.median}
    for mode, strand in ((None, lambda x: "*"), (1, lambda x: x), (2, lambda x: "-" if x == "+" else "+")):
        found = {(r["range_index"], r["sample"]): [r[n] for n in names] for r in signal.reduce_ranges(cov, made, contigs, samples, names, mode).collect()}
        want = {(i, s): [of[n](dense[c, s, strand(t)][max(a, 0):b]) for n in names] for i, c, a, b, t in rows for s in "abc"}
        assert found.keys() == want.keys() and all(np.allclose(found[k], want[k]) for k in want)
    for name in names:
        found = {(r["range_index"], r["bin"], r["sample"]): r["value"] for r in signal.extract_windows(cov, made, contigs, samples, upstream=14, downstream=7, bin_size=7, bin_agg=name).collect()}
        want = {}
        for i, c, a, b, _ in rows:
            for k in range(3):
                low = (a + b) // 2 - 14 + 7 * k
                for s in "abc":
                    cut = dense[c, s, "*"][max(low, 0):max(low + 7, 0)]
                    want[i, k, s] = of[name](cut) if len(cut) else None
        assert found.keys() == want.keys()
        assert all(found[k] is None if want[k] is None else np.isclose(found[k], want[k]) for k in want), name


def test_plans_of_windows_and_reductions(spark, monkeypatch, tmp_path):
    cov, _ = runs(spark, random.Random(6), 9)
    cov.coalesce(1).write.parquet(str(tmp_path / "cov"))
    cov = spark.read.parquet(str(tmp_path / "cov"))
    ranges_ = frame(spark, [(0, "chr1", 3, 90)], "range_index bigint, contig string, start bigint, end bigint")
    contigs, samples = frame(spark, [("chr1", 400)], "contig string, length bigint"), frame(spark, [("a",)], "sample_id string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    wins = lambda agg: plan(signal.extract_windows(cov, ranges_, contigs, samples, fixed_width=40, bin_size=10, bin_agg=agg))
    # a mean is summed by cell, not by value first; and a cell brings its range along
    for agg in ("mean", "sum", "max", "min"):
        text = wins(agg)
        assert not [line for line in text.splitlines() if "Aggregate(keys" in line and "value#" in line.split("]")[0]]
        assert text.count("SortMergeJoin") + text.count("BroadcastHashJoin") <= 4  # contigs twice, segments, cells
    # the pairs of a median are made once
    for text in (wins("median"), plan(signal.reduce_ranges(cov, ranges_, contigs, samples, ["median"]))):
        assert sum("parquet" in line and "FileScan" in line for line in text.splitlines()) == 1
    # large tables get partitions by their bytes
    monkeypatch.setattr(intervals, "PART_BYTES", 400)
    assert "REPARTITION_BY_NUM" in wins("mean")

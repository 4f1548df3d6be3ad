"""Text inputs and outputs, round trips."""

import pytest
from pyspark.sql import functions as F

from strandlake.operators import chunking, concordance, imputation, panels
from strandlake.plans import adapters
from strandlake.sources import readers, sinks


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_regions():
    assert readers.parse_region("chr1") == readers.Region("chr1")
    assert readers.parse_region("chr1:5-9") == readers.Region("chr1", 5, 9, False)
    assert readers.parse_region("chr1:5-").stop == readers.END
    assert readers.parse_windows("1:1-100", "1:10-90")[1].start == 10
    for bad in (("1:1-100", "2:10-90"), ("1:10-100", "1:5-90")):
        with pytest.raises(ValueError):
            readers.parse_windows(*bad)


def test_lists(spark, tmp_path):
    m = readers.genetic_map(spark, write(tmp_path, "m.map", "pos chr cM\n100 1 0.5\n200 1 0.7\n"))
    assert [(r["pos"], r["cm"]) for r in m.orderBy("pos").collect()] == [(100, 0.5), (200, 0.7)]
    p = readers.ploidy_file(spark, write(tmp_path, "p", "a 1\nb 2\na 2\n"))
    assert {r["sample"]: r["ploidy"] for r in p.collect()} == {"a": 1, "b": 2}
    g = readers.groups_file(spark, write(tmp_path, "g", "1 5 x\n1 5 y\n1 6 z\n"))
    assert {r["pos"]: r["grp"] for r in g.collect()} == {5: "x", 6: "z"}
    assert [r["sample"] for r in readers.sample_list(spark, write(tmp_path, "s", "b\na\nb\n")).orderBy("ordinal").collect()] == ["b", "a"]
    assert readers.manifest(spark, write(tmp_path, "c", "1 f t e\nbad line\n")).count() == 1
    assert readers.state_list(spark, write(tmp_path, "st", "1 2 3\n4\n")).filter("target = 1").first()["hap"] == 4
    b = readers.alignment_list(spark, write(tmp_path, "b", "/x/one.bam\n/x/two.bam second\n"))
    assert [r["sample"] for r in b.orderBy("ordinal").collect()] == ["one", "second"]
    with pytest.raises(ValueError):
        readers.alignment_list(spark, write(tmp_path, "b2", "/x/one.bam\n/y/one.bam\n"))


def test_calls(spark, tmp_path):
    text = "##contig=<ID=chr1,length=1000>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\n" + "chr1\t10\tr1\tA\tC\t.\tPASS\tAC=1;AN=4\tGT:PL\t0|1:10,0,20\t0/0:0,5,300\n" + "chr1\t20\tr2\tA\tC,G\t.\tPASS\tAC=1;AN=4\tGT\t0|1\t./.\n"
    path = write(tmp_path, "x.vcf", text)
    assert readers.contigs(spark, path).first()["length"] == 1000
    names = readers.sample_names(spark, path)
    v = readers.variants(spark, path, readers.parse_region("chr1:1-100"))
    assert [(r["pos"], r["ac"], r["an"]) for r in readers.site_counts(v).collect()] == [(10, 1, 4)]
    c = readers.cells(v.filter(F.size("alts") == 1).withColumn("alt", F.col("alts")[0]), names)
    c = c.withColumn("pl", readers.pl_field(F.col("fields")))
    assert {r["sample"]: (r["gt"], r["phased"], r["pl"]) for r in c.collect()} == {"a": ([0, 1], True, [10, 0, 20]), "b": ([0, 0], False, [0, 5, 255])}


def test_calls_with_odd_lines(spark, tmp_path):
    """Headers, short lines, repeated and valueless fields, missing likelihoods, compression; with and without a region."""
    import gzip

    body = ["##fileformat=VCFv4.2", "##contig=<ID=1>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta", "x", "", "1\t5", "1\tfive\t.\tA\tC\t.\t.\tAC=1;AN=2", "1\t10\t.\tA\tC\t.\t.\tAC=1;AC=7;AN=2;DB\tGT:PL\t0/1", "1\t11\t.\tA\tG\t.\t.\t.", "2\t10\t.\tA\tC\t.\t.\tAC=3;AN=4\tGT:PL\t0/1:1,x,3"]
    path = tmp_path / "odd.vcf.gz"
    path.write_bytes(gzip.compress("\n".join(body).encode()))
    v = readers.variants(spark, str(path))
    assert sorted((r["chrom"], r["pos"], r["info"].get("AC")) for r in v.collect()) == [("1", 10, "1"), ("1", 11, None), ("2", 10, "3")]
    assert readers.variants(spark, str(path), readers.parse_region("1:10-10")).count() == 1
    assert sorted((r["chrom"], r["ac"]) for r in readers.site_counts(v).collect()) == [("1", 1), ("2", 3)]
    c = readers.cells(v.withColumn("alt", F.get("alts", F.lit(0))), ["a"]).withColumn("pl", readers.pl_field(F.col("fields")))
    assert sorted((r["chrom"], r["gt"], r["pl"]) for r in c.collect()) == [("1", [0, 1], None), ("2", [0, 1], None)]


def test_short_lines_of_lists(spark, tmp_path):
    assert readers.genetic_map(spark, write(tmp_path, "m", "h\n1 1 2\n")).count() == 1
    with pytest.raises(Exception, match="three columns"):
        readers.genetic_map(spark, write(tmp_path, "m2", "h\n1\n")).collect()
    with pytest.raises(Exception, match="ploidy must be"):
        readers.ploidy_file(spark, write(tmp_path, "p", "a\n")).collect()
    assert readers.fasta_index(spark, write(tmp_path, "f", "chr1 100 6\nchr2\n")).filter("length IS NULL").count() == 1
    assert readers.window_table(spark, write(tmp_path, "w", "0 1\n")).count() == 0


def test_alignments(spark, tmp_path):
    lines = ["@HD\tVN:1.6", "short", "r1\t0\t1\t100\t60\t3S5M2I4M3D2M5N2M\t=\t200\t0\tACGTACGTACGTACGTAC\tIIIIIIIIIIIIIIIIII\tRG:Z:a", "r2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\t*"]
    path = write(tmp_path, "x.sam", "\n".join(lines))
    found = {r["read_id"]: r for r in readers.alignments(spark, path).collect()}
    assert set(found) == {"r1", "r2"} and found["r1"]["len"] == 21 and found["r1"]["mate_chrom"] == "1" and found["r2"]["mate_chrom"] is None
    region = readers.alignments(spark, path, readers.parse_region("1:120-130"))
    assert region.count() == 1 and readers.alignments(spark, path, readers.parse_region("1:121-130")).count() == 0


def test_result_lines(spark, tmp_path):
    s = spark.createDataFrame([(1, 10, "r1", "A", "C", 0.1, 0.2, 0.9)], "site int, pos long, id string, ref string, alt string, raf double, af double, info double")
    c = spark.createDataFrame([(1, "a", 1, 1.0, [0.0, 1.0, 0.0], 0, 1)], "site int, sample string, gt int, ds double, gp array<double>, h0 int, h1 int")
    sinks.write_calls(sinks.call_lines(s, c, ["a", "b"], "chr1"), str(tmp_path / "out"), "gzip")
    back = readers.variants(spark, str(tmp_path / "out"))
    r = readers.cells(back.withColumn("alt", F.col("alts")[0]), ["a", "b"]).filter("sample = 'a'").first()
    assert r["gt"] == [0, 1] and r["fields"]["DS"] == "1.000" and readers.sample_names(spark, str(tmp_path / "out")) == ["a", "b"]


def test_window_table(spark, tmp_path):
    c = spark.createDataFrame([("1", 0, 1, 120, 1, 100, 0.5, 100, 7, 3)], chunking.SCHEMA)
    sinks.lines(chunking.as_lines(c), str(tmp_path / "w"))
    back = readers.window_table(spark, str(tmp_path / "w"))
    assert back.select(*c.columns).first() == c.first()


def test_panel_and_checkpoint(spark, sf_dir, tmp_path):
    p = adapters.panel(spark, sf_dir).filter("hap < 20").withColumn("chunk", F.lit(0))
    sinks.packed_panel(imputation.pack(p), str(tmp_path / "p"))
    assert sinks.read_packed_panel(spark, str(tmp_path / "p"), 0).count() == 64
    with pytest.raises(ValueError):
        sinks.read_packed_panel(spark, str(tmp_path / "p"), 5)
    sinks.save_checkpoint(p, str(tmp_path / "c"), {"seed": 1})
    assert sinks.load_checkpoint(spark, str(tmp_path / "c"), {"seed": 1}).count() == p.count()
    with pytest.raises(ValueError):
        sinks.load_checkpoint(spark, str(tmp_path / "c"), {"seed": 2})
    with pytest.raises(ValueError, match="no checkpoint"):
        sinks.load_checkpoint(spark, str(tmp_path / "none"), {"seed": 2})


def test_a_checkpoint_is_whole_or_the_one_before(spark, tmp_path):
    at = str(tmp_path / "c")
    sinks.save_checkpoint(spark.range(5), at, {"seed": 1})
    bad = spark.range(5).select(F.raise_error(F.lit("lost")).alias("x"))
    with pytest.raises(Exception, match="lost"):
        sinks.save_checkpoint(bad, at, {"seed": 2})
    assert sinks.load_checkpoint(spark, at, {"seed": 1}).count() == 5
    spark.range(9).write.parquet(f"{at}/v1/state", mode="overwrite")  # state without what completes it
    assert sinks.load_checkpoint(spark, at, {"seed": 1}).count() == 5
    sinks.save_checkpoint(spark.range(7), at, {"seed": 3})
    assert sinks.load_checkpoint(spark, at, {"seed": 3}).count() == 7 and len([p for p in (tmp_path / "c").iterdir() if p.name.startswith("v")]) == 1


def test_log(spark, tmp_path):
    handler = sinks.open_log(str(tmp_path / "log"))
    sinks.lines(spark.createDataFrame([("x",)], "value string"), str(tmp_path / "l"))
    with pytest.raises(ZeroDivisionError), sinks.logged("division"):
        1 / 0
    handler.close()
    sinks.log.removeHandler(handler)
    text = (tmp_path / "log").read_text()
    assert "lines" in text and "division: failed" in text


def test_retries():
    calls = []

    def fails(n, error):
        calls.clear()

        def action():
            calls.append(1)
            if len(calls) <= n:
                raise error
            return 5

        return action

    assert readers.retrying(fails(2, OSError("Connection reset")), wait=0) == 5 and len(calls) == 3
    for n, error, expected in ((3, OSError("Connection reset"), 3), (1, ValueError("wrong"), 1), (1, OSError("PATH_NOT_FOUND IOException"), 1)):
        with pytest.raises(type(error)):
            readers.retrying(fails(n, error), wait=0)
        assert len(calls) == expected


def test_reports(spark, sf_dir, tmp_path):
    from strandlake.plans import catalog
    from strandlake.sources import reports

    x = catalog._eval(spark, sf_dir).cache()
    reports.write_all(x, str(tmp_path / "r"), None)
    text = {n: "".join(p.read_text() for p in sorted((tmp_path / f"r.{n}").glob("part-*"))).splitlines() for n in reports.FILES}
    samples = x.select("sample").distinct().count()
    spl = text["error.spl.txt"]
    assert len(spl) == 3 * (samples + 2) and spl[0] == "#Genotype concordance by sample (SNPs)" and spl[1].startswith("#GCsS id sample_name #val_gt_RR") and len(spl[1].split()) == len(spl[2].split()) == 19
    for line in spl[2 * (samples + 2) + 2 :]:  # all variants
        f = line.split()
        own = x.filter(F.col("sample") == int(f[2]))
        n = {c: own.filter(c).count() for c in ("truth_code = 0", "valid AND NOT used", "used AND truth_code = 1 AND estimate_code = 1", "used AND truth_code = 2 AND estimate_code <> 2")}
        assert f[0] == "GCsV" and [int(f[3]), int(f[6]), int(f[8]), int(f[12])] == list(n.values())
        break
    assert len(text["error.cal.txt"]) == 3 * 102 and len(text["error.cal.txt"][2].split()) == len(text["error.cal.txt"][1].split())
    assert len(text["error.grp.txt"][2].split()) == len(text["error.grp.txt"][1].split()) and len(text["rsquare.spl.txt"]) == samples
    assert all(0 <= float(v.split()[-1]) <= 1 for v in text["rsquare.grp.txt"])


def test_sample_names(spark, tmp_path):
    c = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3)], "sample string, site int")
    names = panels.sample_names(c)
    sinks.lines(names.repartition(1).sortWithinPartitions("ordinal").select(F.col("sample").alias("value")), str(tmp_path / "n"))
    assert [r["sample"] for r in readers.sample_list(spark, str(tmp_path / "n")).orderBy("ordinal").collect()] == ["a", "b"]


def test_cut_lines(spark, tmp_path):
    path = write(tmp_path, "cut.vcf", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\n1\t5\t.\tA\tC\t.\t.\t.\tGT\t0/1\n")
    v = readers.variants(spark, path).withColumn("alt", F.get("alts", F.lit(0)))
    with pytest.raises(Exception, match="other samples"):
        readers.cells(v, readers.sample_names(spark, path)).collect()


def test_ploidy_and_missing(spark):
    s = spark.createDataFrame([("a", 1), ("b", 2)], "sample string, ploidy int")
    with pytest.raises(Exception, match="mixed ploidy"):
        concordance.assert_one_ploidy(s).collect()
    c = spark.createDataFrame([("a", i, [0, 1], True) for i in range(200)], "sample string, site int, gt array<int>, phased boolean")
    assert 0 < panels.sprinkle_missing(c, 0.5).filter("gt IS NULL").count() < 200


def test_panel_archive_skips_row_groups(spark, tmp_path):
    """A window and a block of haplotypes: other row groups aren't read, and the plan has no exchange."""
    n_sites, n_haps = 3_000, 96
    panel = spark.range(n_sites * n_haps).select(F.lit("1").alias("chrom"), (F.expr(f"id div {n_haps}") * 7 + 1).alias("pos"), F.lit("A").alias("ref"), F.lit("C").alias("alt"), (F.col("id") % n_haps).alias("hap"), (F.xxhash64("id") % 2 == 0).cast("int").alias("allele"))
    path = str(tmp_path / "panel")
    sinks.panel_archive(panel, path, haplotypes=32, row_group=4_096)
    assert sinks.panel_cells(spark.read.parquet(path)).exceptAll(panel.select("chrom", "pos", "ref", "alt", "hap", "allele")).count() == 0
    part = sinks.read_panel_archive(spark, path, "1", 5_000, 5_700, [32])
    found = sinks.panel_cells(part)
    expected = panel.filter("pos BETWEEN 5000 AND 5700 AND hap BETWEEN 32 AND 63")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))
    plan = part._jdf.queryExecution().executedPlan()
    assert "Exchange" not in plan.toString() and "GreaterThanOrEqual(pos" in plan.toString()
    part.collect()
    import pyarrow.parquet as pq

    groups = kept = 0
    for f in (tmp_path / "panel").glob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        names = [meta.schema.column(i).name for i in range(meta.num_columns)]
        for g in range(meta.num_row_groups):
            pos, block = (meta.row_group(g).column(names.index(c)).statistics for c in ("pos", "first_hap"))
            groups += 1
            kept += pos.max >= 5_000 and pos.min <= 5_700 and block.min <= 32 <= block.max
    assert groups > 20 and kept <= groups / 4
    seen = part.groupBy().count()  # rows that come out of the scan of the remaining row groups
    assert seen.first()[0] == 100

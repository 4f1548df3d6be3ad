"""Restart after a stop, counts taken on the way, checksums, haploid evaluation, groups without sites."""

import pytest
from pyspark.sql import functions as F

from strandlake.functions import genotypes as G
from strandlake.operators import concordance
from strandlake.sources import sinks


def job(spark, seen, stop_at=None):
    def compute(windows):
        chunks = [r["chunk"] for r in windows.select("chunk").collect()]
        if stop_at is not None and stop_at in chunks:
            raise RuntimeError("stopped")
        seen.extend(chunks)
        rows = F.explode(F.sequence(F.lit(1), F.col("chunk") % 4)) if chunks else F.explode(F.array(F.lit(1)))
        return windows.filter("chunk % 4 > 0").select("chunk", rows.alias("site"), (F.col("chunk") * 1.5).alias("value"))

    return compute


def test_restart_repeats_no_complete_window(spark, tmp_path):
    path, parameters = str(tmp_path / "run"), {"seed": 1}
    windows = spark.range(10).select(F.col("id").cast("int").alias("chunk"))
    seen: list[int] = []
    with pytest.raises(RuntimeError):
        sinks.resumed(windows, path, parameters, job(spark, seen, stop_at=7), batch=3)
    assert seen == [0, 1, 2, 3, 4, 5]
    # a batch that was written, but not entered, counts for nothing
    spark.createDataFrame([(6, 1, 99.0)], "chunk int, site int, value double").write.parquet(f"{path}/rows/bleft")
    again: list[int] = []
    found = sinks.resumed(windows, path, parameters, job(spark, again), batch=3)
    assert again == [6, 7, 8, 9] and sorted((r["chunk"], r["site"]) for r in found.collect()) == [(c, s) for c in range(10) for s in range(1, c % 4 + 1)]
    assert {r["chunk"] for r in sinks.done_windows(spark, path, parameters).collect()} == set(range(10))  # also those without rows
    third: list[int] = []
    assert sinks.resumed(windows, path, parameters, job(spark, third)).count() == found.count() and third == []
    with pytest.raises(ValueError, match="other parameters"):
        sinks.done_windows(spark, path, {"seed": 2})
    # a row written twice is seen
    folder = spark.read.parquet(f"{path}/ledger").filter("chunk = 6").first()["folder"]
    spark.read.parquet(f"{path}/rows/{folder}").filter("chunk = 6").write.mode("append").parquet(f"{path}/rows/{folder}")
    with pytest.raises(ValueError, match="window 6"):
        sinks.finished(spark, path, parameters, found.schema)


def test_checksum_of_a_multiset(spark):
    def of(rows):
        return spark.createDataFrame(rows, "a int, b string").repartition(3).agg(G.checksum([F.col("a"), F.col("b")]).alias("x")).first()["x"]

    rows = [(1, "x"), (2, None), (3, "y")]
    assert of(rows) == of(rows[::-1]) and of([]) is None
    assert len({of(rows), of(rows + rows[:1] * 2), of(rows[1:]), of([(1, "x")] * 2), of([(9, "z")] * 2), of(rows + [(4, "q")])}) == 6


def test_counts_on_the_way(spark, caplog):
    df = spark.range(100).withColumn("mac", F.when(F.col("id") < 90, F.col("id") % 5))
    seen = sinks.Counted("sites")
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None) or [])
    kept = seen.at(df, kept=F.col("mac") > 0, dropped=F.col("mac") == 0, unknown=F.col("mac").isNull()).filter("mac > 0")
    assert kept.count() == 72
    with caplog.at_level("INFO", logger="strandlake"):
        assert seen.log() == {"rows": 100, "kept": 72, "dropped": 18, "unknown": 10}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - jobs <= 2 and "kept 72" in caplog.text


def test_haploid_evaluation(spark):
    sites = spark.createDataFrame([(1, 0.2, "SNP", "g"), (2, 0.8, "INDEL", "g"), (3, 0.1, "OTHER", "g")], "site int, maf double, vtype string, grp string")
    schema = "site int, sample string, tp0 double, tp1 double, gp0 double, gp1 double, ds double, dp int, ploidy int"
    rows = [
        (1, "a", 1.0, 0.0, 0.9, 0.1, 0.1, 9, 1), (1, "b", 0.0, 1.0, 0.7, 0.3, 0.3, 9, 1), (1, "c", 0.0, 1.0, 0.5, 0.5, 0.5, 9, 1), (1, "d", -1.0, -1.0, 0.5, 0.5, 0.5, 9, 1), (1, "e", 1.0, 0.0, 0.2, 0.8, 0.8, 3, 1),
        (2, "a", 1.0, 0.0, 0.9, 0.1, 0.1, 9, 1), (2, "b", 0.0, 1.0, 1.2, -0.2, 0.1, None, 1), (3, "a", 1.0, 0.0, 0.9, 0.1, 0.1, 9, 1),
    ]
    found = {(r["site"], r["sample"]): (r["truth_code"], r["estimate_code"], round(r["ds"], 3)) for r in concordance.haploid_evaluation(spark.createDataFrame(rows, schema), sites, min_dp=5, min_p=0.9).collect()}
    assert found == {(1, "a"): (0, 0, 0.1), (1, "b"): (1, 0, 0.3), (1, "c"): (1, -1, 0.5), (1, "d"): (-3, -1, 0.5), (1, "e"): (-2, 1, 0.8), (2, "a"): (1, 1, 0.9), (2, "b"): (-5, -3, 0.9)}
    mixed = spark.createDataFrame([*rows, (1, "f", 1.0, 0.0, 0.9, 0.1, 0.1, 9, 2)], schema)
    with pytest.raises(Exception, match="mixed ploidy"):
        concordance.haploid_evaluation(mixed, sites).collect()


def test_groups_that_no_site_is_in(spark):
    groups = spark.createDataFrame([(0, 5, "x"), (1, 6, "y"), (2, 5, "z"), (3, 9, "w"), (4, 10, "w")], "ordinal int, pos int, grp string")
    found = concordance.untouched_groups(spark.createDataFrame([(5,), (6,), (7,)], "pos int"), groups)
    assert {r["grp"]: r["listed"] for r in found.collect()} == {"z": 1, "w": 2}  # z's place is x's, which comes first

"""Hand-computed values of the column functions."""

import pytest
from pyspark.sql import functions as F

from strandlake.functions import genotypes as G
from strandlake.operators import chunking, gmap, ligate, pileup, sites


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def arr(*x):
    return F.array(*(F.lit(float(v)) for v in x))


@pytest.mark.parametrize(("ac", "an", "maf", "common", "major", "mono"), [(0, 200, 0.0, False, 0, True), (1, 2000, 0.0005, False, 0, False), (150, 200, 0.25, True, 1, False)])
def test_sites(spark, ac, an, maf, common, major, mono):
    c0, c1 = G.cref(F.lit(ac), F.lit(an)), F.lit(ac)
    assert one(spark, G.maf(c0, c1), G.is_common(G.maf(c0, c1), 0.001), G.major_allele(c0, c1), G.is_monomorphic(c0, c1)) == (maf, common, major, mono)


def test_map_positions(spark):
    m = spark.createDataFrame([(100, 1.0), (200, 3.0), (400, 4.0)], "pos long, cm double")
    s = spark.createDataFrame([(i, p) for i, p in enumerate((50, 100, 150, 200, 300, 500))], "site long, pos long")
    placed = gmap.interpolate(s, m)
    assert [round(r["cm"], 6) for r in placed.orderBy("pos").collect()] == [0.5, 1.0, 2.0, 3.0, 3.5, 5.0]
    assert [round(r["cm"], 6) for r in gmap.rebase(placed).orderBy("pos").collect()] == [0, 0.5, 1.5, 2.5, 3.0, 4.5]
    assert gmap.validate(m.withColumn("ordinal", F.col("pos"))).count() == 0


def test_frequency_and_calibration_bins(spark):
    found = one(spark, *(G.frequency_bin(F.lit(x), [0.0, 0.01, 0.05, 0.5]) for x in (0.0, 0.01, 0.0101, 0.5, 0.6)))
    assert found == (-1, 0, 1, 2, -1)
    assert one(spark, *(G.calibration_bin(F.lit(x), F.lit(0.0), F.lit(0.0)) for x in (0.5, 0.995, 1.0))) == (49, 98, 99)
    assert G.count_edges(4) == [0.0, 0.125, 0.375, 0.5 + 1e-9]


def test_midpoints(spark):
    c = spark.createDataFrame([("1", 0, 1, 100), ("1", 1, 103, 200), ("1", 2, 201, 300)], "chrom string, chunk int, core_start long, core_stop long")
    assert [tuple(r) for r in chunking.meet_halfway(c).orderBy("chunk").select("core_start", "core_stop").collect()] == [(1, 101), (102, 200), (201, 300)]


def test_likelihoods(spark):
    p = G.pl_to_gp(F.array(F.lit(10), F.lit(0), F.lit(20)))
    gp, hl = one(spark, p, G.hap_likelihoods(p))
    assert gp == pytest.approx([0.090090, 0.900901, 0.009009], abs=1e-6) and hl == pytest.approx([0.540541, 0.459459], abs=1e-6)


def test_posteriors(spark):
    a, b = arr(0.9, 0.1), arr(0.2, 0.8)
    gp = G.gp_from_haps(a, b)
    found, ds, hds = one(spark, gp, G.dosage(gp), G.het_order(a, b))
    assert found == pytest.approx([0.18, 0.74, 0.08]) and ds == 0.9 and hds
    assert one(spark, G.round_gp(arr(1 / 3, 1 / 3, 1 / 3)), G.round_gp(arr(0.99949, 0.00051, 0.0))) == ([0.334, 0.333, 0.333], [0.999, 0.001, 0.0])
    assert one(spark, G.best_genotype(F.lit(0.4), F.lit(0.4), F.lit(0.2)), G.estimate_code_haploid(arr(0.5, 0.5), 0.0)) == (0, -1)


def test_rounding_without_lambdas(spark):
    """Every entry by itself, in generated code; ties, nulls and pairs as before."""
    x = spark.createDataFrame([(1, [0.3335, 0.3335, 0.333]), (2, [0.0005, 0.4995, 0.5]), (3, [None, 0.2, 0.8]), (4, None), (5, [0.2505, 0.7495, 0.0])], "i int, gp array<double>")
    r = x.select("i", G.round_gp(F.col("gp")).alias("g"))
    assert "lambda" not in r._jdf.queryExecution().optimizedPlan().toString()
    assert {v["i"]: v["g"] for v in r.collect()} == {1: [0.334, 0.333, 0.333], 2: [0.001, 0.499, 0.5], 3: [None, 0.2, 0.8], 4: None, 5: [0.251, 0.749, 0.0]}
    assert one(spark, G.round_gp(arr(0.0005, 0.9995), n=2)) == ([0.001, 0.999],)


def test_base_likelihoods(spark):
    reads = spark.createDataFrame([("s", 1, "A", 20, "A", "C"), ("s", 1, "A", 20, "A", "C"), ("s", 1, "C", 30, "A", "C")], "sample string, site int, base string, qual int, ref string, alt string")
    r = pileup.likelihoods(reads).first()
    assert (r["l0"], r["l1"], r["l2"]) == pytest.approx((-3.485851, -0.909190, -4.954677), abs=1e-6)
    assert r["pl"] == [25, 0, 40] and not r["flat"]


def test_information(spark):
    assert one(spark, G.info_score(F.lit(4), F.lit(2.0), F.lit(1.0))) == (0.0,)
    assert one(spark, G.info_score(F.lit(4), F.lit(1.0), F.lit(0.0))) == (1.0,)


def test_phase_quality_and_transition(spark):
    assert one(spark, G.phase_quality(F.lit(8), F.lit(2)), G.phase_quality(F.lit(10), F.lit(0)), G.transition(F.lit(0.1), 4000)) == pytest.approx((28.2288, 99.0, 0.095163), abs=1e-4)


def test_swaps(spark):
    v = spark.createDataFrame([(0, "a", 1, 5), (1, "a", 5, 1), (2, "a", 2, 2), (3, "a", 0, 4)], "chunk int, sample string, n_match long, n_mismatch long")
    c = spark.range(5).select(F.col("id").cast("int").alias("chunk"))
    assert [r["swap"] for r in ligate.swaps(v, c).orderBy("chunk").collect()] == [0, 1, 1, 0, 1]


def test_quality_flags(spark):
    rows = [(i, p, "A", a, 5, 20) for i, (p, a) in enumerate([(10, "C"), (20, "C"), (20, "G"), (30, "C"), (40, "AT")])]
    s = sites.classify(spark.createDataFrame(rows, "site int, pos int, ref string, alt string, ac long, an long"))
    assert [r["lq"] for r in s.orderBy("site").collect()] == [False, False, True, False, True]


def test_decoding_errors(spark):
    assert one(spark, G.decode_pl(F.array(F.lit(0), F.lit(300), F.lit(20))))[0] == [0, 255, 20]
    assert one(spark, G.decode_pl(F.array(F.lit(0), F.lit(None).cast("int"))))[0] is None
    with pytest.raises(Exception, match="negative PL"):
        one(spark, G.decode_pl(F.array(F.lit(-1), F.lit(0))))


def test_squared_correlation(spark):
    assert one(spark, G.squared_correlation(F.lit(3), F.lit(0.0), F.lit(0.0), F.lit(1.0)), G.squared_correlation(F.lit(1), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("double"))) == (0.0, None)


def test_strings(spark):
    assert one(spark, G.tokens(F.lit("a \t b\r")), G.base_name(F.lit("x/y.vcf.gz")), G.file_stem(F.lit("x/y.bam")), G.is_numeric(F.lit("1e3")), G.argmax(arr(1, 3, 3))) == (["a", "b"], "y.vcf.gz", "y", True, 1)

"""Accuracy of estimated genotypes against a truth: one long table, grouping sets and moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import genotypes as G

#: Scopes of every report: each variant type, and all.
ALL = "ALL"


def three_way(truth: DataFrame, estimate: DataFrame, frequency: DataFrame, keys: list[str]) -> DataFrame:
    """JOIN-05: sites of all three sources on exact alleles, with flags of presence; filter on them or count leftovers."""
    t, e, f = truth.withColumn("in_truth", F.lit(True)), estimate.withColumn("in_estimate", F.lit(True)), frequency.withColumn("in_frequency", F.lit(True))
    out = t.join(e, keys, "full_outer").join(f, keys, "full_outer")
    return out.na.fill(False, ["in_truth", "in_estimate", "in_frequency"])


def leftovers(joined: DataFrame) -> DataFrame:
    """JOIN-05: how many sites are in which sources."""
    return joined.groupBy("in_truth", "in_estimate", "in_frequency").agg(F.count("*").alias("n"))


def common_samples(truth: DataFrame, estimate: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """JOIN-06, SET-03, FLT-13, SRC-22: samples of both, of those wanted if given, ordered by name (or the order wanted)."""
    both = truth.select("sample").intersect(estimate.select("sample"))
    if wanted is None:
        return both.orderBy("sample")
    return wanted.groupBy("sample").agg(F.min("ordinal").alias("ordinal")).join(both, "sample", "left_semi").orderBy("ordinal")


def assert_one_ploidy(samples: DataFrame) -> DataFrame:
    """FLT-18: an error at run time if samples differ in ploidy."""
    n = samples.agg(F.count_distinct("ploidy").alias("n"))
    return n.select(F.assert_true(F.col("n") <= 1, F.lit("samples of mixed ploidy")).isNull().alias("ok"))


def assign_groups(sites: DataFrame, groups: DataFrame) -> DataFrame:
    """JOIN-07, SRC-21: the user's group of a site, the first listed one; sites without a group are left out.

    groups has ordinal, grp and the keys: pos, or pos, ref and alt.
    """
    keys = [k for k in ("chrom", "pos", "ref", "alt") if k in groups.columns]
    first = groups.groupBy(*keys).agg(F.min_by("grp", "ordinal").alias("grp"))
    return sites.drop("grp").join(first, keys)


def untouched_groups(sites: DataFrame, groups: DataFrame) -> DataFrame:
    """JOIN-07: groups that no site is in, with the number of places they list."""
    keys = [k for k in ("chrom", "pos", "ref", "alt") if k in groups.columns]
    first = groups.groupBy(*keys).agg(F.min_by("grp", "ordinal").alias("grp"))
    hit = first.join(sites.select(*keys).distinct(), keys).select("grp").distinct()
    return groups.select("grp", *keys).distinct().groupBy("grp").agg(F.count("*").alias("listed")).join(hit, "grp", "left_anti")


def with_one_ploidy(cells: DataFrame) -> DataFrame:
    """FLT-18: cells (with ploidy), as they are; an error at run time if samples differ in ploidy. One row travels."""
    n = cells.agg(F.count_distinct("ploidy").alias("ploidies"))
    checked = F.when(F.col("ploidies") <= 1, F.col("ploidy")).otherwise(F.raise_error(F.lit("samples of mixed ploidy")).cast("int"))
    return cells.crossJoin(F.broadcast(n)).withColumn("ploidy", checked).drop("ploidies")


def haploid_evaluation(cells: DataFrame, sites: DataFrame, edges: list[float] | None = None, min_dp: int = 0, min_p: float = 0.0, min_gp: float = 0.0) -> DataFrame:
    """evaluation() of haploid samples. cells: site, sample, tp0, tp1 (truth), gp0, gp1, ds, dp, ploidy. Codes are 0 and 1 (the report's RR and RA)."""
    x = with_one_ploidy(cells).join(sites.filter(F.col("vtype").isin("SNP", "INDEL")), "site")
    flip = G.flips(F.col("maf"))
    tp, gp = (F.array(*(F.when(flip, F.col(f"{n}{1 - k}")).otherwise(F.col(f"{n}{k}")) for k in (0, 1))) for n in ("tp", "gp"))
    x = x.withColumn("truth_code", G.truth_code_haploid(tp, F.col("dp"), min_dp, min_p)).withColumn("estimate_code", G.estimate_code_haploid(gp, min_gp))
    x = x.withColumn("ds", G.flip_count(F.col("ds"), 1, flip)).withColumn("cal_bin", G.calibration_bin(F.col("gp0"), F.col("gp1"), F.lit(0.0)))
    if edges is not None:
        x = x.withColumn("af_bin", G.frequency_bin(F.least(F.col("maf"), 1 - F.col("maf")), edges))
    return x.withColumn("valid", F.col("truth_code") >= 0).withColumn("used", (F.col("truth_code") >= 0) & (F.col("estimate_code") >= 0))


def evaluation(cells: DataFrame, sites: DataFrame, edges: list[float] | None = None, min_dp: int = 0, min_p: float = 0.0, min_gp: float = 0.0) -> DataFrame:
    """FLT-04, FLT-10, FLT-11, FN-20, FN-21, FN-23: the long table. cells: site, sample, tp0..tp2 (truth), gp0..gp2, ds, dp; sites: site, maf, vtype, grp.

    truth_code and estimate_code are genotypes, or negative for cells that can't be used.
    """
    x = cells.join(sites.filter(F.col("vtype").isin("SNP", "INDEL")), "site")
    flip = G.flips(F.col("maf"))
    # items of arrays made here are plain columns to the optimiser
    tp, gp = (F.array(F.when(flip, F.col(f"{n}2")).otherwise(F.col(f"{n}0")), F.col(f"{n}1"), F.when(flip, F.col(f"{n}0")).otherwise(F.col(f"{n}2"))) for n in ("tp", "gp"))
    x = x.withColumn("truth_code", G.truth_code(tp, F.col("dp"), min_dp, min_p)).withColumn("estimate_code", G.estimate_code(gp, min_gp))
    x = x.withColumn("ds", G.flip_count(F.col("ds"), 2, flip)).withColumn("cal_bin", G.calibration_bin(F.col("gp0"), F.col("gp1"), F.col("gp2")))
    if edges is not None:
        x = x.withColumn("af_bin", G.frequency_bin(F.least(F.col("maf"), 1 - F.col("maf")), edges))
    return x.withColumn("valid", F.col("truth_code") >= 0).withColumn("used", (F.col("truth_code") >= 0) & (F.col("estimate_code") >= 0))


def _counts() -> list[Column]:
    used, t, e = F.col("used"), F.col("truth_code"), F.col("estimate_code")

    def n(c: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long").alias(name)

    out = [n(F.col("valid"), "n_valid"), n(used, "n_used"), n(F.col("valid") & ~used, "n_filtered")]
    for k, name in enumerate(("rr", "ra", "aa")):
        out += [n(used & (t == k), f"n_{name}"), n(used & (t == k) & (e != k), f"err_{name}")]
    return [*out, n(used & (t > 0) & (t == e), "right_nonref")]


def moments(x: Column, y: Column, used: Column, name: str) -> list[Column]:
    """AGG-01, AGG-02: sums for means, variances and the covariance; one pass, combined before the shuffle."""
    a, b = F.when(used, x.cast("double")), F.when(used, y.cast("double"))
    return [F.covar_samp(a, b).alias(f"{name}_cov"), F.var_samp(a).alias(f"{name}_vx"), F.var_samp(b).alias(f"{name}_vy")]


def _finish(df: DataFrame) -> DataFrame:
    errors = F.col("err_rr") + F.col("err_ra") + F.col("err_aa")
    df = df.withColumns({f"rate_{k}": F.round(G.error_rate(F.col(f"err_{k}"), F.col(f"n_{k}")), 6) for k in ("rr", "ra", "aa")})
    df = df.withColumn("nrd", F.round(G.discordance(errors, F.col("right_nonref")), 6))
    for name in ("best", "ds"):
        df = df.withColumn(f"r2_{name}", F.round(G.squared_correlation(F.col("n_used"), F.col(f"{name}_cov"), F.col(f"{name}_vx"), F.col(f"{name}_vy")), 6))
    return df.drop(*(f"{n}_{m}" for n in ("best", "ds") for m in ("cov", "vx", "vy")))


def report(eval_: DataFrame, key: str, extra: list[Column] | None = None) -> DataFrame:
    """AGG-03, AGG-04, AGG-06, AGG-07: counts, error rates, NRD and r2 by key and variant type, and for all types, by grouping sets."""
    used = F.col("used")
    aggregates = [*_counts(), *moments(F.col("truth_code"), F.col("estimate_code"), used, "best"), *moments(F.col("truth_code"), F.col("ds"), used, "ds"), *(extra or [])]
    both = eval_.groupingSets([[F.col(key), F.col("vtype")], [F.col(key)]], F.col(key), F.col("vtype")).agg(*aggregates)
    return _finish(both.withColumn("vtype", F.coalesce("vtype", F.lit(ALL))))


def by_bin(eval_: DataFrame) -> DataFrame:
    """AGG-04, AGG-06: per frequency bin, with the mean frequency of its cells."""
    return report(eval_.filter("af_bin >= 0"), "af_bin", [F.round(F.avg(F.when(F.col("used"), F.col("maf"))), 6).alias("mean_maf")])


def calibration(eval_: DataFrame, bins: int = 100) -> DataFrame:
    """AGG-05: error rate by the best guess's probability; empty bins are there too."""
    used = eval_.filter("used").groupBy("cal_bin")
    t, wrong = F.col("truth_code"), F.col("truth_code") != F.col("estimate_code")
    sums = [F.sum(F.when(t == k, 1).otherwise(0)).alias(f"n{k}") for k in range(3)] + [F.sum(F.when((t == k) & wrong, 1).otherwise(0)).alias(f"e{k}") for k in range(3)]
    counted = used.agg(*sums)
    every = eval_.sparkSession.range(bins).select(F.col("id").cast("int").alias("cal_bin"))
    out = every.join(F.broadcast(counted), "cal_bin", "left").na.fill(0)
    n, e = F.col("n0") + F.col("n1") + F.col("n2"), F.col("e0") + F.col("e1") + F.col("e2")
    return out.withColumns({"low": F.col("cal_bin") / F.lit(float(bins)), "high": (F.col("cal_bin") + 1) / F.lit(float(bins)), "error": F.round(G.error_rate(e, n), 6)})


def per_site(eval_: DataFrame) -> DataFrame:
    """AGG-08, SNK-10: r2 of each site over its samples."""
    used = F.col("used")
    m = eval_.groupBy("site").agg(F.sum(used.cast("long")).alias("n_used"), *moments(F.col("truth_code"), F.col("ds"), used, "ds"))
    return m.select("site", "n_used", F.round(G.squared_correlation(F.col("n_used"), F.col("ds_cov"), F.col("ds_vx"), F.col("ds_vy")), 6).alias("r2_ds"))


def rejects(eval_: DataFrame) -> DataFrame:
    """AGG-09: why cells can't be used, for truth and estimate."""
    truth = F.col("truth_code") < 0
    x = eval_.filter("truth_code < 0 OR estimate_code < 0").select(F.when(truth, "truth").otherwise("estimate").alias("source"), F.when(truth, F.col("truth_code")).otherwise(F.col("estimate_code")).alias("code"))
    return x.groupBy("source", "code").agg(F.count("*").alias("n"))


def verdicts(eval_: DataFrame) -> DataFrame:
    """FLT-12, SNK-11: sites that are rejected, concordant or discordant."""
    wrong = F.col("used") & (F.col("truth_code") != F.col("estimate_code"))
    g = eval_.groupBy("site").agg(F.sum(F.col("used").cast("long")).alias("n_used"), F.sum(wrong.cast("long")).alias("n_wrong"), F.count("*").alias("n_cells"))
    verdict = F.when(F.col("n_used") == 0, "rejected").when(F.col("n_wrong") == 0, "concordant").otherwise("discordant")
    return g.withColumn("verdict", verdict)


def totals(eval_: DataFrame) -> DataFrame:
    """AGG-10: sites in the overlap, with any and with all genotypes used, by variant type and in all."""
    s = eval_.groupBy("site", "vtype").agg(F.sum(F.col("used").cast("long")).alias("u"), F.count("*").alias("n"))
    g = s.groupingSets([[F.col("vtype")], []], F.col("vtype")).agg(
        F.count("*").alias("n_sites"), F.sum((F.col("u") > 0).cast("long")).alias("n_any"), F.sum((F.col("u") == F.col("n")).cast("long")).alias("n_all")
    )
    return g.withColumn("vtype", F.coalesce("vtype", F.lit(ALL)))


def by_filter(eval_: DataFrame, thresholds: list[float]) -> DataFrame:
    """A list of probability filters in one scan: used cells and errors at each (the loop of the manifest)."""
    best, top = G.best_genotype(F.col("gp0"), F.col("gp1"), F.col("gp2")), F.greatest("gp0", "gp1", "gp2")
    wrong, sums = F.col("truth_code") != best, []
    for k, t in enumerate(thresholds):
        ok = top >= F.lit(float(t))
        sums += [F.coalesce(F.sum(ok.cast("long")), F.lit(0)).alias(f"n{k}"), F.coalesce(F.sum((ok & wrong).cast("long")), F.lit(0)).alias(f"w{k}")]
    rows = F.array(*(F.struct(F.lit(float(t)).alias("min_gp"), F.col(f"n{k}").alias("n_used"), F.col(f"w{k}").alias("n_wrong")) for k, t in enumerate(thresholds)))
    return eval_.filter("valid").agg(*sums).select(F.inline(rows))

"""From posteriors to reported genotypes and site statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import genotypes as G

REF_REF = 0.99999


def sparse(posteriors: DataFrame) -> DataFrame:
    """FLT-14: only posteriors that aren't practically reference."""
    return posteriors.filter(F.col("gp")[0] < REF_REF)


def expand(sparse_: DataFrame, sites: DataFrame, samples: DataFrame) -> DataFrame:
    """The opposite of sparse: cells that were left out are reference."""
    every = sites.select("site").crossJoin(samples.select("sample"))
    none = F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))
    return every.join(sparse_, ["site", "sample"], "left").withColumn("gp", F.coalesce("gp", none))


def accumulate(draws: DataFrame, n_main: int) -> DataFrame:
    """MDL-14: the mean of the main iterations' posteriors; iterations left out as sparse count as reference."""
    g = draws.groupBy("site", "sample").agg(F.count("*").alias("stored"), *(F.sum(F.col("gp")[k]).alias(f"s{k}") for k in range(3)))
    rest = F.lit(n_main) - F.col("stored")
    return g.select("site", "sample", F.array((F.col("s0") + rest) / n_main, F.col("s1") / n_main, F.col("s2") / n_main).alias("gp"))


def called(posteriors: DataFrame) -> DataFrame:
    """FN-14 to FN-17: genotype, dosage and rounded probabilities of (site, sample, gp)."""
    gp = F.col("gp")
    return posteriors.select("site", "sample", G.best_genotype(gp[0], gp[1], gp[2]).alias("gt"), G.dosage(gp).alias("ds"), G.round_gp(gp).alias("gp"))


def site_statistics(posteriors: DataFrame, sites: DataFrame) -> DataFrame:
    """AGG-12, FN-18, FN-19: RAF of the panel, AF and INFO of the estimates. posteriors: site, sample, gp; sites: site, calt, cref."""
    gp = F.col("gp")
    x = posteriors.select("site", gp.alias("gp"), (gp[1] + 2 * gp[2]).alias("raw"))
    g = x.groupBy("site").agg((F.count("*") * 2).alias("n_haps"), (F.sum(F.round(F.col("raw") * 1e6).cast("long")) / 1e6).alias("sum_ds"), F.sum(G.posterior_variance(F.col("gp"), F.col("raw"))).alias("sum_var"))
    out = g.join(sites.select("site", "calt", "cref"), "site")
    return out.select(
        "site", F.round(F.col("calt") / (F.col("calt") + F.col("cref")), 6).alias("raf"), (F.col("sum_ds") / F.col("n_haps")).alias("af"),
        G.info_score(F.col("n_haps"), F.col("sum_ds"), F.col("sum_var")).alias("info"),
    )


def in_core(posteriors: DataFrame, start: int, stop: int) -> DataFrame:
    """FLT-15: rows carry whether they are in the core window; text output has all, binary output only those."""
    return posteriors.withColumn("in_core", F.col("pos").between(start, stop))


def in_site_order(entries: DataFrame) -> DataFrame:
    """SRT-03: the entries of each sample together and in order of site, without a global sort."""
    return entries.repartition("sample").sortWithinPartitions("sample", "site")

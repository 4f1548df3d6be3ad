"""Variant sites: classification, indexes and running counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import genotypes as G
from .ranges import RANGE, WIDTH, in_order, keys, previous, ranged, running, with_totals_before, within


@dataclass(frozen=True)
class SiteOptions:
    """FLT-17: validated options."""

    sparse_maf: float = 0.001
    keep_monomorphic: bool = False

    def __post_init__(self) -> None:
        if not 0 <= self.sparse_maf < 0.5:
            raise ValueError("sparse_maf must be within 0 and 0.5")


def in_region(sites: DataFrame, start: int, stop: int) -> DataFrame:
    """FLT-03, SRC-03: a range on pos that reaches the scan."""
    return sites.filter(F.col("pos").between(start, stop))


def biallelic(sites: DataFrame) -> DataFrame:
    """FLT-01: sites with exactly one alternative allele, from an array column alts."""
    return sites.filter(F.size("alts") == 1).withColumn("alt", F.col("alts")[0])


def classify(sites: DataFrame, options: SiteOptions = SiteOptions()) -> DataFrame:
    """FN-01 to FN-06, FLT-02, FLT-06, WIN-01: counts, frequencies, types and flags of (site, pos, ref, alt, ac, an)."""
    out = (
        ranged(sites).withColumn("cref", G.cref(F.col("ac"), F.col("an")))
        .withColumn("calt", F.col("ac"))
        .withColumn("maf", G.maf(F.col("cref"), F.col("calt")))
        .withColumn("mac", G.minor_count(F.col("cref"), F.col("calt")))
        .withColumn("is_common", G.is_common(F.col("maf"), options.sparse_maf))
        .withColumn("major_allele", G.major_allele(F.col("cref"), F.col("calt")))
        .withColumn("monomorphic", G.is_monomorphic(F.col("cref"), F.col("calt")))
        .withColumn("singleton", G.is_singleton(F.col("cref"), F.col("calt")))
        .withColumn("vtype", G.variant_type(F.col("ref"), F.col("alt")))
        .withColumn("key", G.site_key(F.col("pos"), F.col("ref"), F.col("alt")))
    )
    if not options.keep_monomorphic:
        out = out.filter(~F.col("monomorphic"))
    before = F.lag("pos").over(within(out).orderBy("pos", "site"))  # equal positions are in one range
    return out.withColumn("lq", (F.col("vtype") != "SNP") | F.coalesce(before == F.col("pos"), F.lit(False))).drop(RANGE)


def index_sites(sites: DataFrame) -> DataFrame:
    """WIN-02, WIN-03, WIN-04: place of each site, common sites before it, and its place among common ones; ranges of positions in parallel."""
    common = F.col("is_common").cast("long")
    x = with_totals_before(ranged(sites), n_before=F.lit(1), common_before=common)
    w = within(x).orderBy("pos", "site")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return (
        x.withColumn("site_idx", F.col("n_before") + F.row_number().over(w) - 1)
        .withColumn("all2common", F.col("common_before") + F.coalesce(F.sum(common).over(before), F.lit(0)))
        .withColumn("common_idx", F.when(F.col("is_common"), F.col("all2common")))
        .drop(RANGE, "n_before", "common_before")
    )


def sparse_index(sites: DataFrame, every: int = 1000) -> DataFrame:
    """XSI-09: the position of each every-th line and its place, to begin a search for a position from; ranges of positions in parallel."""
    x = with_totals_before(ranged(sites), n_before=F.lit(1))
    line = F.col("n_before") + F.row_number().over(within(x).orderBy("pos", "site")) - 1
    return x.withColumn("line", line).filter(F.col("line") % every == 0).select(*[c for c in ("chrom",) if c in sites.columns], "pos", "line")


def check_order(sites: DataFrame) -> DataFrame:
    """SRT-02: rows that stand out of coordinate order, by ordinal; empty for a sorted input."""
    key = keys(sites)
    return previous(in_order(sites, ["ordinal"], key), ["ordinal"], key, previous="pos").filter("pos < previous").drop(RANGE)


def spectrum(sites: DataFrame, edges: list[float]) -> DataFrame:
    """AGG-15, FN-20: sites and alleles by frequency bin."""
    binned = sites.withColumn("af_bin", G.frequency_bin(F.col("maf"), edges))
    return binned.groupBy("af_bin").agg(
        F.count("*").alias("n_sites"), F.sum(F.col("is_common").cast("long")).alias("n_common"), F.sum((~F.col("lq")).cast("long")).alias("n_high_quality"), F.sum("mac").alias("minor_alleles")
    )


def rare_first(sites: DataFrame) -> DataFrame:
    """SRT-04: rare sites in order of minor allele count, then place."""
    key, order = keys(sites), ["mac", "site"]
    x = running(in_order(sites.filter(~F.col("is_common")), order, key), order, key, rare_rank=F.lit(1))
    return x.withColumn("rare_rank", F.col("rare_rank") + 1).drop(RANGE)


def recount(panel: DataFrame, sites: DataFrame) -> DataFrame:
    """AGG-11: alleles counted from genotypes against those a site states; the caller decides what a mismatch means."""
    counted = panel.groupBy("site").agg(F.sum("allele").alias("counted_ac"), F.count("*").alias("counted_an"))
    return sites.join(counted, "site", "left").select("site", "ac", "an", "counted_ac", "counted_an", (F.col("counted_ac").eqNullSafe(F.col("ac")) & F.col("counted_an").eqNullSafe(F.col("an"))).alias("agrees"))


def span(sites: DataFrame) -> DataFrame:
    """FN-42: length of a region in bases and centimorgans."""
    return sites.agg((F.max("pos") - F.min("pos") + 1).alias("bp"), (F.max("cm") - F.min("cm")).alias("cm"), F.count("*").alias("n"))


def window_totals(sites: DataFrame, windows: DataFrame) -> DataFrame:
    """AGG-15: sites, common ones, bases and centimorgans of each window (chrom, chunk, start, stop), by an equality join on ranges of positions.

    Windows may overlap; a window without sites has zeros. sites: chrom, pos, cm, is_common.
    """
    w = windows.select("chrom", "chunk", "start", "stop")
    dealt = w.withColumn(RANGE, F.explode(F.sequence(F.expr(f"start div {WIDTH}"), F.expr(f"stop div {WIDTH}"))))
    x = dealt.join(ranged(sites.select("chrom", "pos", "cm", "is_common")), ["chrom", RANGE]).filter(F.col("pos").between(F.col("start"), F.col("stop")))
    sums = [F.count("*").alias("n_variants"), F.sum(F.col("is_common").cast("long")).alias("n_common"), (F.max("pos") - F.min("pos") + 1).alias("bp"), (F.max("cm") - F.min("cm")).alias("cm")]
    return w.join(x.groupBy("chrom", "chunk").agg(*sums), ["chrom", "chunk"], "left").na.fill(0, ["n_variants", "n_common", "bp", "cm"])

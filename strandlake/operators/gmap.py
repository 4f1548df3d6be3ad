"""Genetic map positions by interpolation between knots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranges import RANGE, in_order, previous, ranged


def validate(gmap: DataFrame) -> DataFrame:
    """SRC-06: knots whose position or value falls behind the one before, by ordinal; empty for a good map."""
    key = ["chrom"] if "chrom" in gmap.columns else []
    x = previous(in_order(gmap, ["ordinal"], key), ["ordinal"], key, p="pos", c="cm")
    return x.filter("pos < p OR cm < c").drop("p", "c", RANGE)


def interpolate(sites: DataFrame, gmap: DataFrame, floor: bool = False) -> DataFrame:
    """JOIN-03, JOIN-04: cm of every site from the knots at, before and after it.

    On a knot, its value (the first of several); between knots, linear; outside, by the mean rate of
    the map. floor: values before the first knot don't go below 0. Sites and knots are dealt by ranges of
    positions; within a range, running windows find the knots on either side, and a table with a row a
    range carries knots over from other ranges.
    """
    key = ["chrom"] if "chrom" in sites.columns else []
    knots = gmap.groupBy(*key, "pos").agg(F.min("cm").alias("knot"))
    ends = knots.groupBy(*key).agg(F.min("pos").alias("p0"), F.min("knot").alias("c0"), F.max("pos").alias("p1"), F.max("knot").alias("c1"))
    both = ranged(sites.withColumn("knot", F.lit(None).cast("double")).withColumn("is_site", F.lit(True)).unionByName(knots.withColumn("is_site", F.lit(False)), allowMissingColumns=True))
    at = F.when(F.col("knot").isNotNull(), F.col("pos"))
    part = Window.partitionBy(*key, RANGE)
    running = (Window.unboundedPreceding, 0)
    up, down = part.orderBy("pos", "is_site").rowsBetween(*running), part.orderBy(F.desc("pos"), "is_site").rowsBetween(*running)
    both = both.withColumns(
        {"lp": F.last(at, True).over(up), "lc": F.last("knot", True).over(up), "rp": F.last(at, True).over(down), "rc": F.last("knot", True).over(down)}
    )
    inside = ranged(knots).groupBy(*key, RANGE).agg(F.min("pos").alias("p_first"), F.min_by("knot", "pos").alias("c_first"), F.max("pos").alias("p_last"), F.max_by("knot", "pos").alias("c_last"))
    ranges = ranged(sites.select(*key, "pos")).select(*key, RANGE).distinct().join(inside, [*key, RANGE], "full")
    over = Window.partitionBy(*key) if key else Window.partitionBy(F.lit(0))  # a row a range
    before, after = over.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1), over.orderBy(F.desc(RANGE)).rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.select(
        *key, RANGE, F.last("p_last", True).over(before).alias("bp"), F.last("c_last", True).over(before).alias("bc"), F.last("p_first", True).over(after).alias("ap"), F.last("c_first", True).over(after).alias("ac_")
    )
    found = both.filter("is_site").join(carried, [*key, RANGE], "left")
    found = found.withColumns({"lp": F.coalesce("lp", "bp"), "lc": F.coalesce("lc", "bc"), "rp": F.coalesce("rp", "ap"), "rc": F.coalesce("rc", "ac_")})
    found = found.join(F.broadcast(ends), key, "left") if key else found.crossJoin(F.broadcast(ends))  # one row a chromosome
    rate = F.when(F.col("p1") > F.col("p0"), (F.col("c1") - F.col("c0")) / (F.col("p1") - F.col("p0"))).otherwise(0.0)
    start = F.col("c0") - (F.col("p0") - F.col("pos")) * rate
    cm = (
        F.when(F.col("lp") == F.col("pos"), F.col("lc"))
        .when(F.col("rp") == F.col("pos"), F.col("rc"))
        .when(F.col("lp").isNull(), F.greatest(start, F.lit(0.0)) if floor else start)
        .when(F.col("rp").isNull(), F.col("c1") + (F.col("pos") - F.col("p1")) * rate)
        .otherwise(F.col("lc") + (F.col("pos") - F.col("lp")) * (F.col("rc") - F.col("lc")) / F.when(F.col("rp") == F.col("lp"), 1).otherwise(F.col("rp") - F.col("lp")))
    )
    return found.withColumn("cm", cm).drop("knot", "is_site", "lp", "lc", "rp", "rc", "p0", "c0", "p1", "c1", RANGE, "bp", "bc", "ap", "ac_")


def _first(sites: DataFrame, column: str) -> DataFrame:
    """Sites with the least value of a column, per chromosome, as first_."""
    key = ["chrom"] if "chrom" in sites.columns else []
    least = F.broadcast(sites.groupBy(*key).agg(F.min(column).alias("first_")))  # one row a chromosome
    return sites.join(least, key, "left") if key else sites.crossJoin(least)


def rebase(sites: DataFrame) -> DataFrame:
    """FN-37: cm from the first site on."""
    return _first(sites, "cm").withColumn("cm", F.col("cm") - F.col("first_")).drop("first_")


def constant_rate(sites: DataFrame) -> DataFrame:
    """FN-37: without a map, one centimorgan a megabase, from the first site on."""
    return _first(sites, "pos").withColumn("cm", (F.col("pos") - F.col("first_")) / F.lit(1e6)).drop("first_")

"""Ranges: the unit by which ordered work is dealt, so that no chromosome or table is one task. Of positions, or of any sorted order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import cut_lineage

#: Bases in a range.
WIDTH = 1 << 20
RANGE = "range_"


def ranged(df: DataFrame) -> DataFrame:
    return df.withColumn(RANGE, F.expr(f"pos div {WIDTH}"))


def keys(df: DataFrame) -> list[str]:
    return ["chrom"] if "chrom" in df.columns else []


def within(df: DataFrame):
    """Window partitioned by range."""
    return Window.partitionBy(*keys(df), RANGE)


def with_totals_before(df: DataFrame, **sums) -> DataFrame:
    """df (ranged) with the sums over all ranges before a row's own, as columns of the given names. The table of ranges is small."""
    key = keys(df)
    per = df.groupBy(*key, RANGE).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    over = (Window.partitionBy(*key) if key else Window.partitionBy(F.lit(0))).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*key, RANGE, *(F.coalesce(F.sum(n).over(over), F.lit(0)).alias(n) for n in sums))
    same = F.col(f"s.{RANGE}").eqNullSafe(F.col(f"t.{RANGE}"))
    for k in key:
        same &= F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}"))
    return df.alias("s").join(per.alias("t"), same, "left").select("s.*", *(f"t.{n}" for n in sums))


# any order ----------------------------------------------------------------------------------------------------


def in_order(df: DataFrame, order: list[str], key: list[str] | None = None) -> DataFrame:
    """df dealt by ranges of a sorted order (within a key), whose bounds a sample tells; each row with its range. Kept, so that ranges stay as they are."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.repartitionByRange(parts, *(key or []), *order).withColumn(RANGE, F.spark_partition_id()))


def _joined(df: DataFrame, table: DataFrame, key: list[str], names: list[str]) -> DataFrame:
    """df with columns of a table that has a row for each range and key."""
    same = F.col(f"s.{RANGE}") == F.col(f"t.{RANGE}")
    for k in key:
        same &= F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}"))
    return df.alias("s").join(table.alias("t"), same, "left").select("s.*", *(f"t.{n}" for n in names))


def _earlier(key: list[str]):
    """Window over the ranges before a row's own; the table of ranges is small."""
    over = Window.partitionBy(*key) if key else Window.partitionBy(F.lit(0))
    return over.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)


def running(df: DataFrame, order: list[str], key: list[str] | None = None, **sums) -> DataFrame:
    """For df in order: for each name the sum of a column over all rows of the key that stand before. order must tell rows apart."""
    key = key or []
    per = df.groupBy(*key, RANGE).agg(*(F.sum(c).alias(f"{n}_own") for n, c in sums.items()))
    per = per.select(*key, RANGE, *(F.coalesce(F.sum(f"{n}_own").over(_earlier(key)), F.lit(0)).alias(f"{n}_before") for n in sums))
    own = Window.partitionBy(*key, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    x = _joined(df, per, key, [f"{n}_before" for n in sums])
    x = x.withColumns({n: F.col(f"{n}_before") + F.coalesce(F.sum(c).over(own), F.lit(0)) for n, c in sums.items()})
    return x.drop(*(f"{n}_before" for n in sums))


def previous(df: DataFrame, order: list[str], key: list[str] | None = None, **columns: str) -> DataFrame:
    """For df in order: for each name the value of a column on the row of the key before; null on the first."""
    key = key or []
    place = F.struct(*order)
    per = df.groupBy(*key, RANGE).agg(*(F.max_by(F.struct(F.col(c).alias("v")), place).alias(f"{n}_last") for n, c in columns.items()))
    per = per.select(*key, RANGE, *(F.last(f"{n}_last").over(_earlier(key)).alias(f"{n}_last") for n in columns))
    own = Window.partitionBy(*key, RANGE).orderBy(*order)
    x = _joined(df, per, key, [f"{n}_last" for n in columns])
    first = F.row_number().over(own) == 1
    x = x.withColumns({n: F.when(first, F.col(f"{n}_last.v")).otherwise(F.lag(c).over(own)) for n, c in columns.items()})
    return x.drop(*(f"{n}_last" for n in columns))

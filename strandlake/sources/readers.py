"""Text inputs as DataFrames. Compressed files (.gz, .bz2) are read by the codecs of the file system layer;
region filters on parsed columns or on Parquet partitioned by chromosome reach the scan; tasks that fail
on transient errors are run again by Spark (spark.task.maxFailures)."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import genotypes as G

END = (1 << 31) - 1
T = TypeVar("T")


def retrying(action: Callable[[], T], attempts: int = 3, wait: float = 1.0, transient: Callable[[Exception], bool] | None = None) -> T:
    """SRC-11: what the driver reads itself, again after a transient error, each time after twice the wait. Tasks have Spark's retries.

    By default, errors of input and output are transient, but not missing files.
    """
    for k in range(attempts):
        try:
            return action()
        except Exception as e:
            passing = transient(e) if transient else re.search("IOException|Timeout|Connection|SocketException", f"{type(e).__name__} {e}") is not None and "PATH_NOT_FOUND" not in str(e)
            if not passing or k == attempts - 1:
                raise
            time.sleep(wait * 2**k)
    raise ValueError("attempts must be positive")


@dataclass(frozen=True)
class Region:
    chrom: str
    start: int = 0
    stop: int = END
    whole: bool = True


def parse_region(text: str) -> Region:
    """SRC-01: chr, chr:start- or chr:start-stop."""
    m = re.fullmatch(r"([^:\s]+)(?::(\d+)-(\d*))?", text.strip())
    if not m:
        raise ValueError(f"not a region: {text}")
    if m[2] is None:
        return Region(m[1])
    start, stop = int(m[2]), int(m[3]) if m[3] else END
    if stop < start:
        raise ValueError(f"region ends before it starts: {text}")
    return Region(m[1], start, stop, False)


def parse_windows(buffered: str, core: str) -> tuple[Region, Region]:
    """SRC-02: an input and an output window on one chromosome, the second within the first."""
    a, b = parse_region(buffered), parse_region(core)
    if a.chrom != b.chrom or not (a.start <= b.start <= b.stop <= a.stop):
        raise ValueError("the output window must be within the input window")
    return a, b


def region_columns(text: Column) -> list[Column]:
    """SRC-01 for a column of regions."""
    stop = F.regexp_extract(text, r"-(\d+)$", 1)
    start = F.regexp_extract(text, r":(\d+)-", 1)
    return [
        F.regexp_extract(text, r"^([^:]+)", 1).alias("chrom"),
        F.when(start == "", 0).otherwise(start.try_cast("long")).alias("start"),
        F.when(stop == "", END).otherwise(stop.try_cast("long")).alias("stop"),
        (start == "").alias("whole_chr"),
    ]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their order. One file is one split here only for its order; these are small lists."""
    return spark.read.text(path, wholetext=False).withColumn("ordinal", F.monotonically_increasing_id())


def item(column: Column | str, i: int) -> Column:
    """Field i, null on short lines: a filter on the number of fields may run after it."""
    return F.get(column, F.lit(i))


def fields(spark: SparkSession, path: str) -> DataFrame:
    """FN-34: fields of white-space separated lines; empty lines are left out."""
    return _lines(spark, path).select("ordinal", G.tokens(F.col("value")).alias("f")).filter(F.size("f") > 0)


def genetic_map(spark: SparkSession, path: str) -> DataFrame:
    """SRC-06, SRC-07: pos and cm of a three-column map with a header; an error for other widths."""
    x = fields(spark, path)
    first = x.agg(F.min("ordinal").alias("o"))
    x = x.join(F.broadcast(first), F.col("ordinal") > F.col("o"))
    bad = F.raise_error(F.lit("a genetic map has three columns"))
    return x.select("ordinal", F.when(F.size("f") == 3, item("f", 0).try_cast("long")).otherwise(bad.cast("long")).alias("pos"), item("f", 2).try_cast("double").alias("cm"))


def ploidy_file(spark: SparkSession, path: str) -> DataFrame:
    """SRC-18: sample and ploidy (1 or 2); the first line of a name counts."""
    x = fields(spark, path).select("ordinal", item("f", 0).alias("sample"), item("f", 1).try_cast("int").alias("ploidy"))
    bad = ~F.col("ploidy").isin(1, 2) | F.col("ploidy").isNull()
    x = x.withColumn("ploidy", F.when(bad, F.raise_error(F.lit("ploidy must be 1 or 2")).cast("int")).otherwise(F.col("ploidy")))
    return x.groupBy("sample").agg(F.min_by("ploidy", "ordinal").alias("ploidy"))


def with_ploidy(samples: DataFrame, ploidies: DataFrame) -> DataFrame:
    """SRC-18: samples that aren't listed are diploid."""
    return samples.join(ploidies, "sample", "left").withColumn("ploidy", F.coalesce("ploidy", F.lit(2)))


def alignment_list(spark: SparkSession, path: str) -> DataFrame:
    """SRC-17, FN-43, SET-05: path and name; the name is the file's stem by default; an error for repeated ones."""
    x = fields(spark, path).select(item("f", 0).alias("path"), F.coalesce(item("f", 1), G.file_stem(item("f", 0))).alias("sample"), "ordinal")
    twice = x.groupBy("path").count().filter("count > 1").select("path").unionAll(x.groupBy("sample").count().filter("count > 1").select("sample"))
    if not twice.isEmpty():
        raise ValueError(f"listed twice: {twice.first()[0]}")
    return x


def state_list(spark: SparkSession, path: str) -> DataFrame:
    """SRC-19: a line per target haplotype with panel haplotypes."""
    from pyspark.sql.window import Window

    x = fields(spark, path).withColumn("target", F.row_number().over(Window.orderBy("ordinal")) - 1)
    return x.select("target", F.explode("f").alias("h")).select("target", F.col("h").try_cast("long").alias("hap")).filter("hap IS NOT NULL")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """SRC-20: region, frequency, truth and estimate of evaluations; lines of other widths are left out."""
    return fields(spark, path).filter(F.size("f") == 4).select("ordinal", *(item("f", i).alias(n) for i, n in enumerate(("region", "frequency", "truth", "estimate"))))


def groups_file(spark: SparkSession, path: str) -> DataFrame:
    """SRC-21: site groups of three or five columns, one width throughout; the first line of a site counts."""
    x = fields(spark, path)
    widths = [r["n"] for r in x.select(F.size("f").alias("n")).distinct().limit(2).collect()]
    if widths not in ([3], [5]):
        raise ValueError("a groups file has three or five columns throughout")
    names = ("chrom", "pos", "grp") if widths == [3] else ("chrom", "pos", "ref", "alt", "grp")
    x = x.select("ordinal", *(item("f", i).alias(n) for i, n in enumerate(names))).withColumn("pos", F.col("pos").try_cast("long"))
    return x.groupBy(*names[:-1]).agg(F.min_by("grp", "ordinal").alias("grp"), F.min("ordinal").alias("ordinal"))


def sample_list(spark: SparkSession, path: str) -> DataFrame:
    """SRC-22: distinct names in the order of their first lines."""
    return fields(spark, path).groupBy(item("f", 0).alias("sample")).agg(F.min("ordinal").alias("ordinal"))


def file_list(spark: SparkSession, path: str) -> DataFrame:
    """SRC-23."""
    return fields(spark, path).select("ordinal", item("f", 0).alias("path"))


def fasta_index(spark: SparkSession, path: str) -> DataFrame:
    """SRC-24: contigs and lengths."""
    return fields(spark, path).select(item("f", 0).alias("chrom"), item("f", 1).try_cast("long").alias("length"))


def window_table(spark: SparkSession, path: str) -> DataFrame:
    """The eight columns that chunking.as_lines writes."""
    x = fields(spark, path).filter(F.size("f") == 8)
    f = [item("f", i) for i in range(8)]
    buf, core = region_columns(f[2]), region_columns(f[3])
    return x.select(
        f[1].alias("chrom"), f[0].try_cast("int").alias("chunk"), buf[1].alias("buf_start"), buf[2].alias("buf_stop"), core[1].alias("core_start"), core[2].alias("core_stop"),
        f[4].try_cast("double").alias("cm"), f[5].try_cast("long").alias("bp"), f[6].try_cast("long").alias("n_variants"), f[7].try_cast("long").alias("n_common"),
    )


# variant call text ----------------------------------------------------------------------------------------


def contigs(spark: SparkSession, path: str) -> DataFrame:
    """SRC-05: lengths that the header states."""
    h = spark.read.text(path).filter(F.col("value").startswith("##contig="))
    return h.select(F.regexp_extract("value", r"ID=([^,>]+)", 1).alias("chrom"), F.regexp_extract("value", r"length=(\d+)", 1).try_cast("long").alias("length"))


def sample_names(spark: SparkSession, path: str) -> list[str]:
    row = retrying(lambda: spark.read.text(path).filter(F.col("value").startswith("#CHROM")).first())
    return row["value"].split("\t")[9:] if row else []


def variants(spark: SparkSession, path: str, region: Region | None = None) -> DataFrame:
    """SRC-03, SRC-04, FLT-01, FLT-03: sites of a call file: chrom, pos, id, ref, alts, info (map), format, cells.

    Lines of fewer than eight fields, or without a number as position, are left out.
    """
    x = spark.read.text(path).filter(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("f"))
    f = [item("f", i) for i in range(9)]
    pairs = F.transform(F.filter(F.split(f[7], ";"), lambda p: (p != "") & (p != ".")), lambda p: F.split(p, "=", 2))
    names = F.array_distinct(F.transform(pairs, lambda p: F.get(p, F.lit(0))))  # the first of a repeated name counts
    info = F.map_from_arrays(names, F.transform(names, lambda n: F.get(F.element_at(F.filter(pairs, lambda p: F.get(p, F.lit(0)) == n), 1), F.lit(1))))
    cells_ = F.slice("f", 10, F.greatest(F.size("f") - 9, F.lit(0)))
    x = x.select(F.size("f").alias("width"), f[0].alias("chrom"), f[1].try_cast("long").alias("pos"), f[2].alias("id"), f[3].alias("ref"), F.split(f[4], ",").alias("alts"), info.alias("info"), f[8].alias("format"), cells_.alias("cells"))
    x = x.filter("width >= 8 AND pos IS NOT NULL").drop("width")
    if region is not None:
        x = x.filter((F.col("chrom") == region.chrom) & F.col("pos").between(region.start, region.stop))
    return x


def site_counts(calls: DataFrame) -> DataFrame:
    """SRC-04: sites with AC and AN; others can't be used and are left out."""
    x = calls.filter(F.size("alts") == 1).withColumn("alt", item("alts", 0))
    return x.withColumns({"ac": F.col("info")["AC"].try_cast("long"), "an": F.col("info")["AN"].try_cast("long")}).filter("ac IS NOT NULL AND an IS NOT NULL").drop("alts")


def cells(calls: DataFrame, names: list[str] | DataFrame, keys: tuple[str, ...] = ("chrom", "pos", "ref", "alt"), missing: bool = True) -> DataFrame:
    """SRC-08, SRC-09, SRC-13: a row per site and sample with its fields by name; gt as array, ploidy by its length. Cells that begin with a missing allele can be left out.

    An error for a line with cells for fewer or more samples (a file cut short); lines without any cell have no rows. names: of all lines,
    or a table (file, i, sample) where calls have a file.
    """
    cut = F.raise_error(F.concat(F.lit("cells of other samples than the header's at "), F.concat_ws(":", *(F.col(k) for k in keys[:2]))))
    if isinstance(names, DataFrame):
        per = names.groupBy("file").agg(F.count("*").alias("n"))  # a row a file
        calls, by, table, n = calls.join(F.broadcast(per), "file", "left"), ["file", "i"], names, F.coalesce(F.col("n"), F.lit(0))
    else:
        by, table, n = ["i"], F.broadcast(calls.sparkSession.createDataFrame(list(enumerate(names)), "i int, sample string")), F.lit(len(names))  # not an expression a sample
    whole = F.when((F.size("cells") == 0) | (F.size("cells") == n), F.col("cells")).otherwise(cut.cast("array<string>"))
    x = calls.select(*keys, *by[:-1], F.split("format", ":").alias("k"), F.posexplode(whole).alias("i", "v"))
    if not missing:
        x = x.filter(~F.col("v").startswith("."))
    x = x.join(table, by)  # a row a sample
    x = x.withColumn("fields", F.map_from_arrays("k", F.transform("k", lambda _, i: F.get(F.split("v", ":"), i))))
    alleles = F.split(F.col("fields")["GT"], r"[|/]")
    gt = F.transform(alleles, lambda a: a.try_cast("int"))
    return x.select(*keys, "sample", "fields", gt.alias("gt"), F.contains(F.col("fields")["GT"], F.lit("|")).alias("phased"), F.size(gt).alias("ploidy"))


def pl_field(fields_: Column) -> Column:
    """SRC-14."""
    return G.decode_pl(F.transform(F.split(fields_["PL"], ","), lambda x: x.try_cast("int")))


def gl_field(fields_: Column) -> Column:
    """SRC-15."""
    return G.decode_gl(F.transform(F.split(fields_["GL"], ","), lambda x: x.try_cast("double")))


def match_panel(target: DataFrame, panel: DataFrame, panel_only: bool = False) -> DataFrame:
    """JOIN-01, JOIN-02, SRC-12: target cells at panel sites on exact alleles; panel_only keeps panel sites without target rows."""
    keys = ["chrom", "pos", "ref", "alt"] if "chrom" in panel.columns else ["pos", "ref", "alt"]
    return target.join(panel.dropDuplicates(keys), keys, "right" if panel_only else "inner")


def alignments(spark: SparkSession, path: str, region: Region | None = None) -> DataFrame:
    """SRC-16: alignment text: read_id, flags, chrom, pos, mapq, mate_chrom, mate_pos, len (of the reference), bases, quals and cigar.

    Lines of fewer than eleven fields are left out. pileup.segments walks the alignment. Columns of partitioned folders (sample=...) stay.
    """
    x = spark.read.text(path)
    others = [c for c in x.columns if c != "value"]
    x = x.filter(~F.col("value").startswith("@")).select(F.split("value", "\t").alias("f"), *others)
    f = [item("f", i) for i in range(11)]
    span = F.aggregate(F.regexp_extract_all(f[5], F.lit(r"(\d+)[MDN=X]"), F.lit(1)), F.lit(0).cast("long"), lambda a, b: a + b.cast("long"))
    mate = F.when(f[6] == "=", f[2]).when(f[6] != "*", f[6])
    x = x.select(
        *others, F.size("f").alias("width"), f[0].alias("read_id"), f[1].try_cast("int").alias("flags"), f[2].alias("chrom"), f[3].try_cast("long").alias("pos"), f[4].try_cast("int").alias("mapq"), mate.alias("mate_chrom"),
        f[7].try_cast("long").alias("mate_pos"), span.alias("len"), f[9].alias("bases"), f[10].alias("quals"), f[5].alias("cigar"),
    ).filter("width >= 11").drop("width")
    if region is not None:
        x = x.filter((F.col("chrom") == region.chrom) & (F.col("pos") <= region.stop) & (F.col("pos") + F.col("len") > region.start))
    return x

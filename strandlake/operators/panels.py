"""Panel matrices in long form: sparse and dense lines, transposes, subsets, phase utilities and sampling."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import bits
from .ranges import RANGE, in_order, running


def sparse_lines(panel: DataFrame) -> DataFrame:
    """BIT-07, SET-02, JOIN-11: per site, the haplotypes with the minor allele; negated where that is the reference."""
    n = panel.groupBy("site").agg(F.sum("allele").alias("ac"), F.count("*").alias("an")).withColumn("negated", F.col("ac") * 2 > F.col("an"))
    carriers = panel.join(n, "site").filter((F.col("allele") == 1) != F.col("negated"))
    lines = carriers.groupBy("site").agg(F.array_sort(F.collect_list("hap")).alias("carriers"))
    return n.join(lines, "site", "left").withColumn("carriers", F.coalesce("carriers", F.array().cast("array<long>")))


def encodings(panel: DataFrame, threshold: int) -> DataFrame:
    """BIT-08: a line is kept sparse up to a minor allele count, else dense; BIT-06: set bits of each."""
    n = panel.groupBy("site").agg(F.sum("allele").alias("ones"), F.count("*").alias("an"))
    mac = F.least(F.col("ones"), F.col("an") - F.col("ones"))
    return n.select("site", "ones", F.when(mac > threshold, "dense").otherwise("sparse").alias("encoding"), mac.alias("entries"))


LINE = "site long, n long, ones long, encoding string, haps binary, line binary"


def encoded_lines(panel: DataFrame, threshold: int) -> DataFrame:
    """BIT-06, BIT-08: a line of bytes per site: word-aligned bits where the minor allele has more than threshold carriers, else the carriers; haps: their ids in order.

    A task holds the haplotypes of one site at a time.
    """

    def work(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("hap").to_numpy(), kind="stable")
        haps, row = group.column("hap").to_numpy()[order].astype("<i8"), group.column("allele").to_numpy()[order].astype(np.uint8)
        ones = int(row.sum())
        dense = min(ones, len(row) - ones) > threshold
        minor = 0 if 2 * ones > len(row) else 1
        line = bits.encode_words(row).tobytes() if dense else bytes([minor]) + np.flatnonzero(row == minor).astype("<u4").tobytes()
        columns = [[group.column("site")[0].as_py()], [len(row)], [ones], ["dense" if dense else "sparse"], [haps.tobytes()], [line]]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()), strict=True)], names=[f.split()[0] for f in LINE.split(", ")])

    return panel.select("site", "hap", "allele").groupBy("site").applyInArrow(work, LINE)


def decoded_lines(lines: DataFrame) -> DataFrame:
    """BIT-05, BIT-06: (site, hap, allele) of encoded lines."""

    def process(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if r["encoding"] == "dense":
                    row = bits.decode_words(np.frombuffer(r["line"], dtype="<u2"), r["n"])
                else:
                    minor = r["line"][0]
                    row = np.full(r["n"], 1 - minor, dtype=np.uint8)
                    row[np.frombuffer(r["line"][1:], dtype="<u4")] = minor
                haps = np.frombuffer(r["haps"], dtype="<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(r["n"], r["site"])), pa.array(haps), pa.array(row.astype(np.int32))], names=["site", "hap", "allele"])

    return lines.mapInArrow(process, "site long, hap long, allele int")


def traverse(panel: DataFrame, visit: Callable[[int, np.ndarray, np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """XSI-10: what a visitor says of each line: visit(site, haplotypes in order, their alleles) gives rows of the schema."""
    fields = [f.split() for f in schema.split(", ")]

    def process(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for site, h, a in zip(pdf["site"], pdf["haps"], pdf["alleles"], strict=True) for r in visit(int(site), np.asarray(h), np.asarray(a))]
            yield pd.DataFrame(rows, columns=[n for n, _ in fields])

    ordered = F.array_sort(F.collect_list(F.struct("hap", "allele")))
    lines = panel.groupBy("site").agg(ordered.alias("line")).select("site", F.col("line.hap").alias("haps"), F.col("line.allele").alias("alleles"))
    return lines.mapInPandas(process, schema)


def sample_names(cells: DataFrame) -> DataFrame:
    """XSI-01: the distinct samples in order, with ordinal; sinks.lines writes the names, readers.sample_list reads them."""
    names = cells.select(F.col("sample").cast("string").alias("sample")).distinct()
    return running(in_order(names, ["sample"]), ["sample"], ordinal=F.lit(1)).drop(RANGE)


def transpose(panel: DataFrame) -> DataFrame:
    """BIT-03, JOIN-11: per haplotype, the sites with the alternative allele."""
    return panel.filter("allele = 1").groupBy("hap").agg(F.array_sort(F.collect_list("site")).alias("sites"))


def restrict(panel: DataFrame, haps: DataFrame) -> DataFrame:
    """BIT-02, JOIN-12: only some haplotypes."""
    return panel.join(haps.select("hap").distinct(), "hap", "left_semi")


def polymorphic(panel: DataFrame) -> DataFrame:
    """FLT-16: sites with both alleles among the haplotypes given."""
    return panel.groupBy("site").agg(F.min("allele").alias("lo"), F.max("allele").alias("hi")).filter("lo <> hi").select("site")


def run_lengths(panel: DataFrame) -> DataFrame:
    """BIT-04, BIT-05, WIN-15: runs of equal alleles along the haplotypes of a site."""
    w = Window.partitionBy("site").orderBy("hap")
    x = panel.withColumn("new", F.coalesce(F.col("allele") != F.lag("allele").over(w), F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(w))
    return x.groupBy("site", "run").agg(F.first("allele").alias("allele"), F.count("*").alias("length"))


def add_states(selected: DataFrame, listed: DataFrame) -> DataFrame:
    """SET-01: selected states and the user's, once each."""
    return selected.select("target", "hap").union(listed.select("target", "hap")).distinct()


def top_states(neighbours: DataFrame, k: int) -> DataFrame:
    """TOP-01: up to k distinct states a target, by rank, then the most recent site."""
    best = neighbours.groupBy("target", "hap").agg(F.min(F.struct("rank", (-F.col("site")).alias("s"))).alias("b"))
    w = Window.partitionBy("target").orderBy("b.rank", "b.s", "hap")
    return best.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select("target", "hap", "place")


def sample(rows: DataFrame, key: str, n: int, seed: int = 20011, by: list[str] | None = None) -> DataFrame:
    """SMP-01, SMP-03: n rows without replacement (per group), by a hash of seed and key; the same on any partitioning."""
    draw = F.md5(F.concat_ws("|", F.lit(seed), *(by or []), key).cast("binary"))
    if not by:  # the n least of all are found without a global sort
        rows = rows.orderBy(draw, key).limit(n)
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(draw, key)
    return rows.withColumn("draw", F.row_number().over(w)).filter(F.col("draw") <= n)


def switch_errors(phases: DataFrame) -> DataFrame:
    """AGG-17, XSI-07: share of neighbouring heterozygotes of a sample whose order to the reference changes. phases: sample, site, test, ref (0 or 1)."""
    w = Window.partitionBy("sample").orderBy("site")
    x = phases.withColumn("off", F.col("test").bitwiseXOR(F.col("ref"))).withColumn("switch", F.col("off").bitwiseXOR(F.lag("off").over(w)))
    return x.groupBy("sample").agg(F.count("switch").alias("n"), F.coalesce(F.sum("switch"), F.lit(0)).alias("switches")).withColumn("rate", F.round(F.coalesce(F.try_divide("switches", "n"), F.lit(0.0)), 6))


def drop_samples(panel: DataFrame, names: list[str]) -> DataFrame:
    """XSI-02."""
    return panel.filter(~F.col("sample").isin(names))


def matrix_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """XSI-03: cells in one matrix and not the other."""
    return a.exceptAll(b).unionAll(b.exceptAll(a))


def unphase(cells: DataFrame, share: float = 1.0, seed: int = 1) -> DataFrame:
    """XSI-04: alleles sorted and marked unphased, for all or a share of the cells by hash."""
    hit = F.crc32(F.concat_ws("|", F.lit(seed), "sample", "site").cast("binary")) % 10_000 < int(share * 10_000)
    return cells.withColumn("gt", F.when(hit, F.array_sort("gt")).otherwise(F.col("gt"))).withColumn("phased", F.col("phased") & ~hit)


def sprinkle_missing(cells: DataFrame, share: float, seed: int = 1) -> DataFrame:
    """XSI-04: a share of the cells, by hash, set to missing."""
    hit = F.crc32(F.concat_ws("|", F.lit(seed), "sample", "site").cast("binary")) % 10_000 < int(share * 10_000)
    return cells.withColumn("gt", F.when(~hit, F.col("gt")))


def common_matrix(panel: DataFrame, least_maf: float) -> DataFrame:
    """XSI-05: lines of sites at or above a minor allele frequency."""
    n = panel.groupBy("site").agg(F.avg(F.col("allele").cast("double")).alias("f"))
    return panel.join(n.filter(F.least(F.col("f"), 1 - F.col("f")) >= least_maf).select("site"), "site", "left_semi")


def replace_samples(panel: DataFrame, matrix: DataFrame) -> DataFrame:
    """XSI-06: alleles from another matrix where it has the cell."""
    return panel.join(matrix.withColumnRenamed("allele", "new"), ["site", "hap"], "left").withColumn("allele", F.coalesce("new", "allele")).drop("new")


def probes(cells: DataFrame) -> DataFrame:
    """XSI-01, XSI-08, AGG-18: samples, entries, distinct sites, largest ploidy and whether all are phased."""
    return cells.agg(
        F.count_distinct("sample").alias("n_samples"), F.count("*").alias("n_entries"), F.count_distinct("site").alias("n_sites"), F.max(F.size("gt")).alias("max_ploidy"), F.min(F.col("phased")).alias("all_phased")
    )


def offsets(samples: DataFrame) -> DataFrame:
    """WIN-18, SRC-09: where a sample's haplotypes and likelihoods start. samples: ordinal, sample, ploidy."""
    x = running(in_order(samples, ["ordinal"]), ["ordinal"], hap_offset=F.col("ploidy"), gl_offset=F.col("ploidy") + 1)
    return x.drop(RANGE)


def duplicates(names: DataFrame, column: str) -> DataFrame:
    """SET-05: names that stand more than once."""
    return names.groupBy(column).agg(F.count("*").alias("n")).filter("n > 1")


def iteration_means(states: DataFrame) -> DataFrame:
    """AGG-16: mean number of states and percent of polymorphic sites by iteration."""
    return states.groupBy("iteration").agg(F.avg("n_states").alias("mean_states"), F.avg(100.0 * F.col("n_polymorphic") / F.col("n_sites")).alias("polymorphic"))

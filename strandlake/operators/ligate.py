"""Phase-consistent concatenation of overlapping windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import genotypes as G
from .lineage import cut_lineage


def overlap(calls: DataFrame) -> DataFrame:
    """JOIN-08: cells of the same site and sample in neighbouring windows, side by side: one window over a cell's rows. calls: chunk, site, sample, a0, a1."""
    w = Window.partitionBy("site", "sample").orderBy("chunk")
    x = calls.select("chunk", "site", "sample", "a0", "a1", F.lead("chunk").over(w).alias("next"), F.lead("a0").over(w).alias("b0"), F.lead("a1").over(w).alias("b1"))
    return x.filter(F.col("next") == F.col("chunk") + 1).drop("next")


def votes(shared: DataFrame) -> DataFrame:
    """AGG-13, FN-32: per sample and boundary, heterozygotes of both windows whose order agrees or not."""
    het = (F.col("a0") != F.col("a1")) & (F.col("b0") != F.col("b1"))
    same = het & (F.col("a0") == F.col("b0"))
    v = shared.groupBy("chunk", "sample").agg(F.sum(same.cast("long")).alias("n_match"), F.sum((het & ~same).cast("long")).alias("n_mismatch"))
    return v.withColumn("quality", F.round(G.phase_quality(F.col("n_match"), F.col("n_mismatch")), 4))


def swaps(votes_: DataFrame, chunks: DataFrame) -> DataFrame:
    """WIN-14: whether a sample's haplotypes change places in a window.

    A boundary flips, keeps or (a tie) resets. Ties start a new segment; within it the state is the
    parity of flips: one window over the boundaries of a sample, no iteration. chunks: one column chunk.
    """
    windows = chunks.agg(F.collect_set("chunk").alias("chunks"))  # one row
    every = votes_.select("sample").distinct().crossJoin(F.broadcast(windows)).select("sample", F.explode("chunks").alias("chunk"))
    v = every.join(votes_.withColumn("chunk", F.col("chunk") + 1), ["chunk", "sample"], "left").na.fill(0, ["n_match", "n_mismatch"])
    order = Window.partitionBy("sample").orderBy("chunk")
    v = v.withColumn("segment", F.sum((F.col("n_match") == F.col("n_mismatch")).cast("int")).over(order))
    in_segment = Window.partitionBy("sample", "segment").orderBy("chunk")
    parity = F.sum((F.col("n_mismatch") > F.col("n_match")).cast("int")).over(in_segment) % 2
    return v.select("chunk", "sample", parity.cast("int").alias("swap"))


def owners(calls: DataFrame) -> DataFrame:
    """WIN-13: of the sites two neighbours share, the first half (rounded down) is the left one's, the rest the right one's."""
    by_site = Window.partitionBy("site").orderBy("chunk")
    own = calls.select("chunk", "site").distinct()
    own = own.withColumn("shared", F.coalesce(F.lead("chunk").over(by_site) == F.col("chunk") + 1, F.lit(False)))
    place = F.col("shared").cast("long")
    k, n = F.sum(place).over(Window.partitionBy("chunk").orderBy("site")), F.sum(place).over(Window.partitionBy("chunk"))
    x = own.withColumn("left_has", F.when(F.col("shared"), k <= F.floor(n / 2)))
    right_has = F.when(F.lag("shared").over(by_site), ~F.lag("left_has").over(by_site))
    return x.withColumn("right_has", right_has).filter(F.coalesce("left_has", F.lit(True)) & F.coalesce("right_has", F.lit(True))).select("chunk", "site")


def ligate(calls: DataFrame) -> DataFrame:
    """SET-04, FN-39: one row per site and sample, in consistent phase. calls: chunk, site, sample, a0, a1. They are computed once and kept."""
    calls = cut_lineage(calls)
    s = swaps(votes(overlap(calls)), calls)
    mine = calls.join(owners(calls), ["chunk", "site"]).join(s, ["chunk", "sample"], "left")
    flip: Column = F.coalesce(F.col("swap"), F.lit(0)) == 1
    return mine.select("site", "sample", "chunk", F.when(flip, F.col("a1")).otherwise(F.col("a0")).alias("a0"), F.when(flip, F.col("a0")).otherwise(F.col("a1")).alias("a1"))


def check_order(files: DataFrame) -> DataFrame:
    """SRT-02, SRC-23: windows (ordinal, start, samples) that don't ascend or whose samples differ from the first one's; empty if all is well."""
    w = Window.orderBy("ordinal")
    x = files.withColumns({"p": F.lag("start").over(w), "s": F.first("samples").over(w)})
    return x.filter((F.col("start") <= F.col("p")) | (F.col("samples") != F.col("s"))).drop("p", "s")


def strip(records: DataFrame) -> DataFrame:
    """FN-38: of the annotations only the allele counts, of the sample fields only the genotype."""
    keep = [c for c in records.columns if c not in ("info", "format")]
    if "info" in records.columns:
        keep.append(F.map_filter("info", lambda k, _: k.isin("AC", "AN")).alias("info"))
    return records.select(*keep)


def merge_headers(frames: list[DataFrame]) -> DataFrame:
    """JOIN-13: rows of several windows under the union of their columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out

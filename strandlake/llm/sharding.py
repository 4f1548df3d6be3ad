"""Operator 5: shards cut from documents in Hilbert-curve order.

Language, source and size are quantised to up to 32 steps each (by ranks of whole values, weighted by their
rows, so that order is kept) and mapped to the place on a three-dimensional Hilbert curve. Equal texts form a group,
which has the least place of its members. Groups stand in order of place; running sums of bytes are
cut into shards of near equal bytes (law `bytes`), so a shard covers few values of each dimension and
readers can skip files by their ranges.

Groups stay whole, whatever their size. Those above GROUP_SHARE of a shard, by bytes or rows, are dealt first, the largest
to the emptiest shard; the rest of the curve fills all shards up to one level. So shards differ by no more than
a small group, except that a shard above the level, which only a group larger than a shard makes, takes nothing else.

Ranks and running sums over all rows are put together from ranges: rows are range partitioned once,
sums per range make a small table, and windows stay within a range.

Defined results: null texts have size 1 and belong to the group of empty texts; null language and
source come first on the curve; ties and repeated rows are ordered by doc_id, null first; a very long text is a group
like others; an empty table gives an empty result; other columns, whatever their names, are ignored unless named in keep.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

BITS = 5
SHARDS = 16
#: Groups above this share of a shard's bytes or rows are dealt one by one; there are at most 2 * SHARDS / GROUP_SHARE.
GROUP_SHARE = 0.005
KEYS = ["text_hash", "size", "text_crc32"]
GROUP = ["place", *KEYS]


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of points (n, dimensions) with coordinates below 2**bits."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations, from the coarsest cell down
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0]) ^ swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= flip
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << 1) | ((x[i] >> b) & 1)
    return place


def ranged(df: DataFrame, order: list[str], parts: int) -> DataFrame:
    """df in ranges of a sorted order, each row with its range; kept, so that ranges stay as they are."""
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return common.cut_lineage(dealt.withColumn("range", F.spark_partition_id()))


def running(df: DataFrame, order: list[str], sums: dict[str, Column], by: Column | None = None) -> DataFrame:
    """For a ranged df: for each name, the sum of a column over all rows that stand before, per `by` if given."""
    df = df.withColumn("by_", F.lit(0) if by is None else by)
    parts = df.groupBy("range", "by_").agg(*(F.sum(c).alias(f"sum_{k}") for k, c in sums.items()))  # a row a range and value of by
    earlier = Window.partitionBy("by_").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("range", "by_", *(F.coalesce(F.sum(f"sum_{k}").over(earlier), F.lit(0)).alias(f"sum_{k}") for k in sums))
    before = Window.partitionBy("range", "by_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumns({k: F.coalesce(F.sum(c).over(before), F.lit(0)) for k, c in sums.items()}).join(offsets, ["range", "by_"])
    return out.withColumns({k: F.col(k) + F.col(f"sum_{k}") for k in sums}).drop("by_", *(f"sum_{k}" for k in sums))


def steps_of(df: DataFrame, column: str, total: int) -> list[tuple[str, int]]:
    """For a string column, the least value of each step, ascending, with the step: where half of a value's rows stand among all."""
    values = ranged(df.groupBy(column).agg(F.count("*").alias("n")), [column], common.partitions(df.sparkSession))
    values = running(values, [column], {"before": F.col("n")}).filter(F.col(column).isNotNull())
    step = F.floor((F.col("before") + F.col("n") / 2) * F.lit(1 << BITS) / F.lit(max(1, total))).cast("int")
    found = values.groupBy(step.alias("step")).agg(F.min(column).alias("least")).collect()  # at most a row a step
    return sorted((r["least"], r["step"]) for r in found)


def step_at(value: Column, cuts: list[tuple[str, int]]) -> Column:
    """The step of a value: that of the last cut at or before it; 0 for null."""
    found = F.lit(0)
    for least, step in cuts:
        found = F.when(value >= F.lit(least), F.lit(step)).otherwise(found)
    return F.when(value.isNull(), F.lit(0)).otherwise(found)


def deal(sizes: list[int], rest: int, shards: int) -> tuple[list[int], list[float]]:
    """Shards of large groups, given the largest first, each to the emptiest; and what each shard then takes of the rest up to one level."""
    loads = [0] * shards
    dealt = []
    for size in sizes:
        s = min(range(shards), key=lambda i: (loads[i], i))
        loads[s] += size
        dealt.append(s)
    level, some = 0.0, sorted(loads)
    for k in range(1, shards + 1):  # the k emptiest share the rest
        level = (rest + sum(some[:k])) / k
        if k == shards or level <= some[k]:
            break
    return dealt, [max(0.0, level - x) for x in loads]


def shards(docs: DataFrame, n_shards: int = SHARDS, keep: tuple[str, ...] = (), texts: bool = False) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, place and the kept columns; its text if asked for.

    Shards are cut without the texts. Texts are put in at the end, in one shuffle, one for each doc_id and text (of a null and an empty one, the empty).
    """
    spark = docs.sparkSession
    parts = common.partitions(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        *(F.col(c).alias(f"keep_{c}") for c in keep),
    )
    narrow = common.cut_lineage(narrow)
    shares = [i / (1 << BITS) for i in range(1, 1 << BITS)]
    stats = narrow.agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.percentile_approx("size", shares, 10_000).alias("sizes")).first()
    total, n = stats["bytes"] or 0, stats["n"]
    size_cuts = np.array(sorted(set(stats["sizes"] or [])), dtype=np.int64)

    @F.pandas_udf("long")
    def place(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(hilbert(np.stack([a.to_numpy(), b.to_numpy(), np.searchsorted(size_cuts, c.to_numpy(), side="right")], axis=1)))

    steps = [step_at(F.col(c), steps_of(narrow, c, n)).cast("int") for c in ("lang", "source")]
    groups = narrow.withColumn("place", place(*steps, "size")).groupBy(*KEYS).agg(F.min("place").alias("place"), F.count("*").alias("n"))
    groups = ranged(groups.withColumn("bytes", F.col("n") * F.col("size")), GROUP, parts)
    large = (F.col("bytes") > GROUP_SHARE * total / n_shards) | (F.col("n") > GROUP_SHARE * n / n_shards)
    one_by_one = groups.filter(large).orderBy(F.desc("bytes"), *GROUP).collect()
    dealt, room = deal([r["bytes"] for r in one_by_one], total - sum(r["bytes"] for r in one_by_one), n_shards)
    fixed = spark.createDataFrame([(*(r[k] for k in GROUP), s) for r, s in zip(one_by_one, dealt, strict=True)], ", ".join(f"{k} long" for k in GROUP) + ", shard int")
    middle = F.col("before") + F.col("bytes") / 2
    shard = sum(((middle >= F.lit(float(e))).cast("int") for e in np.cumsum(room)[:-1]), F.lit(0))
    others = running(groups.filter(~large), GROUP, {"before": F.col("bytes")}).select(*GROUP, shard.alias("shard"))

    # no key of the second join has more rows than GROUP_SHARE of a shard
    rows = narrow.drop("lang", "source")
    rows = rows.join(F.broadcast(fixed), KEYS).unionByName(rows.join(F.broadcast(fixed.select(*KEYS)), KEYS, "left_anti").join(others, KEYS))
    order = [*GROUP, "doc_id"]
    rows = running(ranged(rows, order, parts), order, {"slot": F.lit(1).cast("long")}, by=F.col("shard"))
    if texts:
        named = [n.alias(c) for c, n in (("doc_id", F.col("doc_id").cast("long")), ("text_hash", F.xxhash64(text)), ("size", F.octet_length(text).cast("long") + 1))]
        one = docs.select(*named, F.col("text").cast("string").alias("text")).groupBy("doc_id", "text_hash", "size").agg(F.first("text", ignorenulls=True).alias("text"))
        same = F.col("r.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("r.text_hash") == F.col("t.text_hash")) & (F.col("r.size") == F.col("t.size"))
        rows = rows.alias("r").join(one.alias("t"), same).select("r.*", F.col("t.text").alias("keep_text"))
        keep = (*keep, "text")
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "place", *(F.col(f"keep_{c}").alias(c) for c in keep)
    )

"""Helpers shared by the text operators: reading, batches, checkpoints, word hashes."""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes hashed in one piece; longer data is cut at separators.
PIECE = 1 << 20
#: A single word beyond this many bytes gets a digest instead of a polynomial.
LONG_WORD = 1 << 19

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bounded_batches(spark: SparkSession, rows: int = 500) -> None:
    """Keep Arrow batches small, so that a worker holds few texts at a time."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


#: Shuffle files of a finished query go at once, not when the driver's memory is next cleared.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() into the folder that spark.checkpoint.dir names; a temporary one only in local mode, where it is unset.

    What was shuffled on the way isn't needed any more and is removed.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "checkpoints"))
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(CLEANUP, before)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that df has no column of."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; works on copies."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    found = np.zeros(256, dtype=bool)
    for low, high in ranges:
        found[low : high + 1] = True
    return found


#: The separators of `[^\x20\x09-\x0D]+`.
WHITE = separators((0x09, 0x0D), (0x20, 0x20))

_TABLES: dict[str, np.ndarray] = {}


def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not _TABLES:
        n = PIECE + 1
        with np.errstate(over="ignore"):
            up = np.full(n, BASE, dtype=np.uint64)
            up[0] = 1
            down = np.full(n, pow(BASE, -1, 1 << 64), dtype=np.uint64)
            down[0] = 1
            _TABLES["up"], _TABLES["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
        _TABLES["byte"] = splitmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return _TABLES["up"], _TABLES["down"], _TABLES["byte"]


def word_bounds(data: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that aren't separators."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~sep[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _hash_piece(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down, byte = _powers()
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(byte[data] * up[: len(data)], out=total[1:])
    return splitmix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def hash_words(data: np.ndarray, sep: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of data and their starts. A word's hash depends on its bytes alone."""
    starts, ends = word_bounds(data, sep)
    if len(data) <= PIECE and (not len(starts) or int((ends - starts).max()) <= LONG_WORD):
        return _hash_piece(data, starts, ends), starts
    found = np.zeros(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        if ends[at] - low > LONG_WORD:
            digest = hashlib.blake2b(data[low : int(ends[at])].tobytes(), digest_size=8).digest()
            found[at] = int.from_bytes(digest, "little")
            at += 1
            continue
        long_ahead = np.flatnonzero(ends[at:] - starts[at:] > LONG_WORD)
        stop = at + int(long_ahead[0]) if len(long_ahead) else len(starts)
        stop = min(stop, at + max(1, int(np.searchsorted(ends[at:stop], low + PIECE, side="right"))))
        piece = data[low : int(ends[stop - 1])]
        found[at:stop] = _hash_piece(piece, starts[at:stop] - low, ends[at:stop] - low)
        at = stop
    return found, starts


#: Multipliers for the words of a shingle, by place.
PLACES = splitmix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; with fewer words, the whole sequence as one; with none, none."""
    k = min(n, len(words))
    if not k:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(len(words) - k + 1, dtype=np.uint64)
    for i in range(k):
        total += words[i : len(words) - k + 1 + i] * PLACES[i]
    return splitmix(total + np.uint64(k))


LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def as_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def shard_of(doc_id: Column, cuts: np.ndarray | list[int]) -> Column:
    """How many cuts (ascending) are not above the id; the cuts travel as one array, a row looks them up by halving."""
    if not len(cuts):
        return F.lit(0).cast("long")
    limits = np.asarray(cuts, dtype=np.int64)

    @F.pandas_udf("long")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(limits, ids.to_numpy(), side="right"))

    return place(doc_id)


def id_blocks(docs: DataFrame, blocks: int) -> np.ndarray:
    """Ids of a table (doc_id, n), ascending, that cut it into runs whose sums of n are about a `blocks`-th of the whole at most.

    Fine runs of like counts are cut first and then put together; a run of one id may be larger.
    """
    if blocks < 2:
        return np.zeros(0, dtype=np.int64)
    fine = (16 if blocks <= 1000 else 4) * blocks
    shares = [i / fine for i in range(1, fine)]
    found = docs.select(F.percentile_approx("doc_id", shares, max(20_000, 10 * fine)).alias("cuts")).first()["cuts"]
    cuts = np.unique(np.array(found or [], dtype=np.int64))
    rows = docs.groupBy(shard_of(F.col("doc_id"), cuts).alias("k")).agg(F.sum("n").alias("n")).toPandas()  # a row a cut
    sums = np.zeros(len(cuts) + 1)
    sums[rows["k"].to_numpy()] = rows["n"].to_numpy()
    return cuts[_put_together(sums, sums.sum() / blocks)]


def _put_together(sums: np.ndarray, most: float) -> np.ndarray:
    """Places behind which runs of neighbouring sums end, each as long as it stays below most (a single one may be above)."""
    kept, ahead, at = [], np.concatenate([[0], np.cumsum(sums)]), 0
    while True:
        # the last run end that stays below most, or the next that holds anything
        end = max(int(np.searchsorted(ahead, ahead[at] + most, side="right")) - 1, int(np.searchsorted(ahead, ahead[at], side="right")))
        if end >= len(sums):
            return np.array(kept, dtype=np.int64)
        kept.append(end - 1)
        at = end

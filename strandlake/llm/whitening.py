"""Operator 12: whitening of embeddings by a compensated covariance.

Entries become integers, whose sums are exact. Every entry is centred, as a double-double (a high and a low part that
together hold about 106 bits), before it is multiplied; the products of a row and their sums over a task's rows are
double-doubles too, by error-free transformations of sums and products. A task passes on one row of the matrix at a time,
high and low parts, and those of all tasks are merged row by row in the same arithmetic: dims groups, none of which
holds more than two numbers for each task and column. Only the finished matrix (dims * dims, whatever the rows) reaches the driver.

Its eigenvectors come from LAPACK's `syevd` (numpy.linalg.eigh), which reduces to tridiagonal form and then divides and conquers;
one step of refinement with the low parts, in extended precision, brings them to double precision.

Whitened rows are checked by the same means: their own means, centred products, and the largest entry that
differs from the identity.

Defined results: rows with a null vector, or with null, infinite or NaN entries, are dropped; so are vectors of another length than
most have (ties: the longer), as no covariance has room for them. Components whose eigenvalue isn't above LEAST
times the trace (constant or dependent dimensions, one row, equal rows) can't be whitened and are left out; without any,
the result is empty, as it is for an empty table. Repeated rows count each; a null vec_id is kept; other columns,
whatever their names, are ignored. `deviation` is exact, and stops with an overflow where it passes 63 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Eigenvalues up to this share of the trace count as zero.
LEAST = 1e-12
#: Products made at a time (of one row, if it has more).
BLOCK = 1 << 17

Pair = tuple[np.ndarray, np.ndarray]


# double-double arithmetic ---------------------------------------------------------------------------------


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """a + b and what rounding lost of it."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def two_product(a: np.ndarray, b: np.ndarray) -> Pair:
    """a * b and what rounding lost of it; factors are split into halves of 26 bits."""
    p = a * b
    c, d = a * 134217729.0, b * 134217729.0
    ah, bh = c - (c - a), d - (d - b)
    al, bl = a - ah, b - bh
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def add(x: Pair, y: Pair) -> Pair:
    s, e = two_sum(x[0], y[0])
    t, f = two_sum(x[1], y[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def multiply(x: Pair, y: Pair) -> Pair:
    p, e = two_product(x[0], y[0])
    return two_sum(p, e + (x[0] * y[1] + x[1] * y[0]))


def total(x: Pair) -> Pair:
    """The sum over the first axis, by halves."""
    high, low = x
    while len(high) > 1:
        half = len(high) // 2
        h, l = add((high[:half], low[:half]), (high[half : 2 * half], low[half : 2 * half]))  # noqa: E741
        high, low = (h, l) if len(high) == 2 * half else (np.concatenate([h, high[-1:]]), np.concatenate([l, low[-1:]]))
    return high[0], low[0]


def quotient(a: np.ndarray, n: int) -> Pair:
    """Integers (int64) over n as double-doubles."""
    high = (a >> 32).astype(np.float64) * 4294967296.0  # both parts are exact
    x = two_sum(high, (a & 0xFFFFFFFF).astype(np.float64))
    d = np.float64(n)
    q = x[0] / d
    p, e = two_product(q, np.broadcast_to(d, q.shape))
    return two_sum(q, ((x[0] - p) - e + x[1]) / d)


# rows -----------------------------------------------------------------------------------------------------


def _matrix(column: pa.ListArray, dims: int, dtype) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(-1, dims)


def whole(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """vec_id and x (array of long) of the rows that remain, and their length."""
    c = F.col("embedding").cast("array<double>")
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kept = embeddings.filter(F.col("embedding").isNotNull()).filter(~F.coalesce(bad, F.lit(True)))
    lengths = kept.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"))
    most = lengths.agg(F.max(F.struct("n", "d")).alias("m")).first()["m"]
    dims = most["d"] if most else 0
    x = F.transform(c, lambda v: F.floor(v * SCALE).cast("long") + SHIFT)
    return kept.filter(F.size("embedding") == dims).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")), dims


def sums(rows: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of rows and exact sums by dimension, added up in tasks first."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, np.zeros(dims, dtype=np.int64)
        for batch in batches:
            n += len(batch)
            s += _matrix(batch.column(0), dims, np.int64).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()], pa.list_(pa.int64()))], names=["n", "s"])

    parts = rows.select("x").mapInArrow(add_up, "n long, s array<long>")
    found = parts.select("n", F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("s"), F.sum("n").alias("n")).orderBy("i").collect()  # a row a dimension
    return (found[0]["n"] or 0, [r["s"] for r in found]) if found else (0, [])


def double_sums(rows: DataFrame, dims: int) -> Pair:
    """Sums of a column of arrays of double, as double-doubles."""

    def plain(column: pa.Array) -> Pair:
        y = _matrix(column, dims, np.float64)
        return y, np.zeros_like(y)

    high, low = _merged(rows, dims, plain, products=False)
    return high[0], low[0]


def centred_products(rows: DataFrame, dims: int, centred: Callable[[pa.Array], Pair]) -> Pair:
    """The sum over all rows of the outer product of what `centred` makes of them: the upper triangle, high and low parts."""
    return _merged(rows, dims, centred, products=True)


def _merged(rows: DataFrame, dims: int, centred: Callable[[pa.Array], Pair], products: bool) -> Pair:
    lines = dims if products else 1
    a, b = np.triu_indices(dims) if products else (np.zeros(dims, dtype=int), np.arange(dims))
    rows_at_once = max(1, BLOCK // max(1, len(a)))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = (np.zeros(len(a)), np.zeros(len(a)))
        for batch in batches:
            for start in range(0, len(batch), rows_at_once):
                y = centred(batch.column(0).slice(start, rows_at_once))
                at = add(at, total(multiply(tuple(x[:, a] for x in y), tuple(x[:, b] for x in y)) if products else y))
        cuts = np.flatnonzero(np.diff(a)) + 1
        yield from _lines(enumerate(zip(*(np.split(x, cuts) for x in at), strict=True)))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Pair] = {}
        for batch in batches:
            for i, h, l in zip(*(batch.column(c) for c in ("i", "high", "low")), strict=True):  # noqa: E741
                pair = tuple(x.values.to_numpy(zero_copy_only=False) for x in (h, l))
                i = i.as_py()
                found[i] = add(found[i], pair) if i in found else pair
        if found:
            yield from _lines(found.items())

    def _lines(items) -> Iterator[pa.RecordBatch]:
        k, v = zip(*items, strict=True)
        arrays = [pa.array(list(k), pa.int32()), *(pa.array([x[j].tolist() for x in v], pa.list_(pa.float64())) for j in (0, 1))]
        yield pa.RecordBatch.from_arrays(arrays, names=["i", "high", "low"])

    schema = "i int, high array<double>, low array<double>"
    parts = rows.mapInArrow(gather, schema).repartition(min(lines, common.partitions(rows.sparkSession)), "i")
    found = parts.mapInArrow(merge, schema).collect()  # a row a line of the matrix
    out = np.zeros((2, lines, dims))
    for r in found:
        out[:, r["i"], r["i"] :] = r["high"], r["low"]
    return out[0], out[1]


def eigen(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix given by its upper triangle in two parts."""
    upper = np.triu(high)
    _, x = np.linalg.eigh(upper + np.triu(upper, 1).T)
    whole = np.triu(high).astype(np.longdouble) + np.triu(low)
    a = whole + np.triu(whole, 1).T
    x = x.astype(np.longdouble)
    r = np.eye(len(a), dtype=np.longdouble) - x.T @ x
    s = x.T @ (a @ x)
    e = np.diag(s) / (1 - np.diag(r))
    gap = e[None, :] - e[:, None]
    apart = np.abs(gap) > 1e-9 * max(float(np.abs(e).max()), 1e-300)  # closer ones only need to be orthogonal
    step = np.where(apart, (s + e[None, :] * r) / np.where(apart, gap, 1), r / 2)
    x = (x + x @ step).astype(np.float64)
    x /= np.sqrt((x * x).sum(axis=0))
    order = np.argsort(-e, kind="stable")
    return e[order].astype(np.float64), x[:, order]


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, n, deviation, whitened (an array), explained (an array), identity_error: one row per remaining vector."""
    spark = embeddings.sparkSession
    rows, dims = whole(embeddings)
    n, s = sums(rows, dims) if dims else (0, [])
    schema = "vec_id long, deviation long, whitened array<double>"
    empty = spark.createDataFrame([], f"{schema}, n long, explained array<double>, identity_error double")
    if not n:
        return empty
    total_ = np.array(s, dtype=object)

    def deviations(column: pa.Array) -> np.ndarray:
        x = _matrix(column, dims, np.int64)
        if n * (int(np.abs(x).max(initial=0)) + 1) + max(map(abs, s)) < 1 << 63:
            return x * np.int64(n) - total_.astype(np.int64)
        raise OverflowError("n * x passes 63 bits")

    high, low = centred_products(rows.select("x"), dims, lambda column: quotient(deviations(column), n))
    values, vectors = eigen(high / n, low / n)
    trace = float(np.trace(high) + np.trace(low)) / n
    kept = int((values[:components] > LEAST * trace).sum())
    if trace <= 0 or not kept:
        return empty
    values, vectors = values[:kept], vectors[:, :kept]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = deviations(batch.column("x"))
            y = quotient(d, n)
            w = (y[0] @ vectors + y[1] @ vectors) / np.sqrt(values)
            if float(np.abs(d).max(initial=0)) ** 2 * dims < 2.0**62:
                squares = pa.array((d * d).sum(axis=1))
            else:
                squares = pa.array([sum(int(v) * int(v) for v in r) for r in d], pa.int64())  # raises beyond 63 bits
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), squares, pa.array(w.tolist(), pa.list_(pa.float64()))], names=["vec_id", "deviation", "whitened"])

    out = rows.mapInArrow(project, schema)
    only = out.select("whitened")
    mean = [x / n for x in double_sums(only, kept)]

    def centred(column: pa.Array) -> Pair:
        h, l = two_sum(_matrix(column, kept, np.float64), np.broadcast_to(-mean[0], (len(column), kept)))  # noqa: E741
        return two_sum(h, l - mean[1])

    high, low = centred_products(only, kept, centred)
    covariance = (high + low) / n
    error = float(np.abs(np.triu(covariance) - np.eye(kept)).max())
    explained = F.lit([float(v) / trace for v in values])
    return out.withColumns({"n": F.lit(n).cast("long"), "explained": explained, "identity_error": F.lit(error)})


def components(embeddings: DataFrame, count: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row per remaining vector and component."""
    rows = whitened(embeddings, count)
    exploded = rows.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("i", "of"))
    return exploded.select("vec_id", (F.col("i") + 1).alias("component"), "n", "deviation", F.col("of.whitened").alias("whitened"), F.col("of.explained").alias("explained"), "identity_error")

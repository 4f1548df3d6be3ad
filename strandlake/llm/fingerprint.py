"""Operator 1: homomorphic multiset fingerprints of documents.

A document is the multiset of its paragraphs (pieces between line feeds). Every paragraph is hashed
to a wide vector and the vectors are summed lane by lane: 32 lanes modulo 2**32 filled from an
extendable-output hash of the whole paragraph, and 256 lanes modulo 2**16 that hold a signed count
sketch of the paragraph's three-word runs. Sums don't depend on order, so permuted paragraphs give
equal fingerprints, and a paragraph is inserted or deleted by adding or subtracting its vector. The
first lanes decide equality; the second, read as signed numbers, estimate how much two documents
share: 2ab / (aa + bb).

Defined results: a null text counts as empty; the empty text has the zero vector; ties in doc_id are
ordered by text, a null doc_id comes first; an empty table gives an empty result; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

EXACT, SKETCH = 32, 256
WIDTH = EXACT * 4 + SKETCH * 2
#: Bytes of a line sketched at a time.
STRIDE = 1 << 18

SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
#: Stands in for a null doc_id.
NO_ID = -(1 << 63)


def zero() -> tuple[np.ndarray, np.ndarray]:
    return np.zeros(EXACT, dtype=np.uint32), np.zeros(SKETCH, dtype=np.int64)


def _sketch(data: bytes) -> np.ndarray:
    """Signed counts of three-word runs that stay within a line; shorter at a line's end."""
    raw = np.frombuffer(data, dtype=np.uint8)
    words, starts = common.hash_words(raw)
    if not len(words):
        return np.zeros(SKETCH, dtype=np.int64)
    line = np.cumsum(raw == 10)[starts] if b"\n" in data else np.zeros(len(words), dtype=np.int64)
    run = words * common.PLACES[0]
    for k in (1, 2):
        if len(words) > k:
            same = line[k:] == line[:-k]
            run[:-k] += np.where(same, words[k:] * common.PLACES[k], np.uint64(0))
    run = common.splitmix(run)
    lane = (run & np.uint64(SKETCH - 1)).astype(np.int64)
    sign = 1.0 - 2.0 * ((run >> np.uint64(40)) & np.uint64(1)).astype(np.float64)
    return np.bincount(lane, weights=sign, minlength=SKETCH).astype(np.int64)


def vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The summed vector of a text's paragraphs; the text counts as one paragraph even if empty."""
    data = common.as_bytes(text)
    lines = data.split(b"\n")
    digests = b"".join([hashlib.shake_128(x).digest(EXACT * 4) for x in lines])
    exact = np.frombuffer(digests, dtype="<u4").reshape(-1, EXACT).sum(axis=0, dtype=np.uint32)
    if len(data) <= STRIDE:
        return exact, _sketch(data)
    sketch, piece, size = np.zeros(SKETCH, dtype=np.int64), [], 0
    for x in lines:
        if size + len(x) > STRIDE and piece:
            sketch += _sketch(b"\n".join(piece))
            piece, size = [], 0
        if len(x) > STRIDE:  # cut at places that depend on the line alone
            for i in range(0, len(x), STRIDE):
                sketch += _sketch(x[i : i + STRIDE])
        else:
            piece.append(x)
            size += len(x) + 1
    return exact, sketch + (_sketch(b"\n".join(piece)) if piece else 0)


def fingerprint(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    return vector(text) if text else zero()


def insert(a, b):
    return a[0] + b[0], a[1] + b[1]


def delete(a, b):
    return a[0] - b[0], a[1] - b[1]


def pack(a) -> str:
    return a[0].astype("<u4").tobytes().hex() + (a[1] & 0xFFFF).astype("<u2").tobytes().hex()


def unpack(packed: str) -> tuple[np.ndarray, np.ndarray]:
    raw = bytes.fromhex(packed)
    return np.frombuffer(raw[: EXACT * 4], dtype="<u4"), np.frombuffer(raw[EXACT * 4 :], dtype="<i2").astype(np.int64)


def emitted(sketch: np.ndarray) -> np.ndarray:
    """Sketch lanes as the packed fingerprint has them: modulo 2**16, signed."""
    return ((sketch + 0x8000) & 0xFFFF) - 0x8000


def likeness(a, b) -> float:
    """1 for equal fingerprints, else the shared part of the sketches, within 0 and 1; a function of the packed fingerprints."""
    p, q = emitted(a[1]), emitted(b[1])
    if np.array_equal(a[0], b[0]) and np.array_equal(p, q):
        return 1.0
    x, y = p.astype(np.float64), q.astype(np.float64)
    whole = float(x @ x + y @ y)
    return min(1.0, max(0.0, 2.0 * float(x @ y) / whole)) if whole else 0.0


def edit(text: str, after: str) -> tuple[str, str, str]:
    """The edited text, the paragraphs it loses and those it gains, from the last line break that both share."""
    k = len(text) // 4
    keep = len(text) - k
    head = text.rfind("\n", 0, keep) + 1
    gained = text[head:keep] + after[:k]
    return text[:head] + gained, text[head:], gained


def _rows(texts: Iterator[tuple[int, str, bool]]) -> Iterator[tuple]:
    before = None
    for doc_id, text, halo in texts:
        now = fingerprint(text)
        if before is not None:
            yield _row(*before, text, now)
            before = None
        if halo:
            return
        before = (doc_id, text, now)
    if before is not None:  # a table whose only document follows itself
        yield _row(*before, before[1], before[2])


def _row(doc_id: int, text: str, own, after: str, after_print) -> tuple:
    if len(text) < 4:
        edited, changed = text, own
    else:
        edited, lost, gained = edit(text, after)
        changed = insert(delete(own, vector(lost)), vector(gained))
    sha = hashlib.sha256(common.as_bytes(edited)).hexdigest()
    return doc_id, len(text), sha, pack(own), pack(changed), likeness(own, changed), likeness(own, after_print)


def _process(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of documents, one after another; a run's last rows are its halo."""
    stream = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("block", "doc_id", "text", "halo")), strict=True))
    rows = (row for _, run in groupby(stream, key=lambda x: x[0]) for row in _rows(x[1:] for x in run))
    while kept := list(islice(rows, 500)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept, strict=True), TYPES, strict=True)], names=NAMES)


def fingerprints(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """One row per document: fingerprints of its text and of its edited text, and likenesses.

    The text is shuffled once, into runs of consecutive doc_ids. A document whose id opens a run is
    also sent to the run before it, so that every document meets its successor in one task.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    n = blocks or common.partitions(spark)
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    cuts = common.id_blocks(own.select("doc_id", (F.octet_length("text") + 1).cast("long").alias("n")), n)
    first = own.agg(F.min("doc_id").alias("m")).first()["m"]
    if first is None:
        first = 0
    limits = cuts[cuts > first]
    last = len(limits)

    @F.pandas_udf("array<int>")
    def places(ids):
        """The run of an id, and also the run before it where the id opens a run (as -1 - run)."""
        run = np.searchsorted(limits, ids.to_numpy(), side="right")
        opens = np.searchsorted(limits, ids.to_numpy(), side="left") < run
        also = [([int(r), -1 - (int(r) - 1)] if o else [int(r)]) + ([-1 - last] if i == first else []) for i, r, o in zip(ids.to_numpy(), run, opens, strict=True)]
        return pd.Series(also)

    dealt = own.withColumn("place", F.explode(places("doc_id"))).select(
        F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place")).alias("block"), "doc_id", "text", (F.col("place") < 0).alias("halo")
    )
    return (
        dealt.repartitionById(max(n, last + 1), F.col("block"))
        .sortWithinPartitions("block", "halo", "doc_id", "text")
        .mapInArrow(_process, SCHEMA)
        .withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
    )

"""Operator 6: language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A run of three letters is bound by multiplying the
letters' vectors, each rotated by its place; a document bundles (sums) the vectors of all its runs; a
language bundles its training documents, each at unit length. Languages share a direction, which is
taken out of the prototypes. A document gets the language whose prototype has the largest cosine.

Letters are Unicode letters of the lower-cased text; what stands between them counts as one blank.
Letters share vectors by code point modulo 1021. Texts are cut every 2**20 characters.

Learning reads at most `max_train` documents, those smallest by a hash of doc_id (and repeated rows of the last); every
document is predicted. Defined results: null texts and texts without letters give `und` with score 0; without any
training document all are `und`; of equal cosines the first language counts; repeated rows are predicted each; very long
texts are bundled piece by piece; an empty table gives an empty result; other columns, whatever their names, are
ignored (`recognised` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DIM = 1024
LETTERS = 1021
BLANK = 0
SEED = 20240611
#: Characters taken at a time.
PIECE = 1 << 20
#: Distinct runs multiplied at a time.
BLOCK = 4096
#: The most documents that learning reads.
MAX_TRAIN = 20_000

SCHEMA = "doc_id long, lang_pred string, score double"
_STATE: dict[str, np.ndarray] = {}


def _vectors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if "a" not in _STATE:
        random = np.random.default_rng(SEED)
        first = (random.integers(0, 2, (LETTERS + 1, DIM), dtype=np.int8) * 2 - 1).astype(np.int8)
        _STATE["a"], _STATE["b"], _STATE["c"] = first, np.roll(first, 1, axis=1), np.roll(first, 2, axis=1)
        _STATE["letter"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _STATE["a"], _STATE["b"], _STATE["c"]


def runs(text: str) -> np.ndarray:
    """Codes of the three-letter runs of up to PIECE characters, blanks at both ends."""
    _vectors()
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    ids = np.where(_STATE["letter"][points], points % LETTERS + 1, BLANK).astype(np.uint32)
    ids = np.concatenate([[np.uint32(0)], ids, [np.uint32(0)]])
    keep = np.ones(len(ids), dtype=bool)
    keep[1:] = (ids[1:] != BLANK) | (ids[:-1] != BLANK)
    ids = ids[keep]
    if len(ids) < 3:
        return np.zeros(0, dtype=np.uint32)
    return (ids[:-2] << np.uint32(20)) | (ids[1:-1] << np.uint32(10)) | ids[2:]


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    parts = [runs(text[i : i + PIECE]) for i in range(0, len(text or ""), PIECE)]
    codes = np.sort(np.concatenate(parts)) if len(parts) > 1 else np.sort(parts[0]) if parts else np.zeros(0, np.uint32)
    if not len(codes):
        return codes, codes
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.diff(np.append(first, len(codes)))


def bind(codes: np.ndarray) -> np.ndarray:
    a, b, c = _vectors()
    mask = np.uint32(1023)
    return (a[codes >> np.uint32(20)] * b[(codes >> np.uint32(10)) & mask] * c[codes & mask]).astype(np.float32)


def bundles(texts: list[str | None]) -> np.ndarray:
    """A document vector a row; zero where a text has no letter."""
    found = [counts(t) for t in texts]
    known = np.unique(np.concatenate([u for u, _ in found])) if found else np.zeros(0, np.uint32)
    out = np.zeros((len(texts), DIM), dtype=np.float32)
    at = [np.searchsorted(known, u) for u, _ in found]
    for low in range(0, len(known), BLOCK):
        block = bind(known[low : low + BLOCK])
        dense = np.zeros((len(texts), len(block)), dtype=np.float32)
        for row, (places, (_, n)) in enumerate(zip(at, found, strict=True)):
            a, b = np.searchsorted(places, [low, low + BLOCK])
            dense[row, places[a:b] - low] = n[a:b]
        out += dense @ block
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=-1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def train(docs: DataFrame, max_train: int = MAX_TRAIN) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes, from rows (doc_id, text, lang) with lang and text."""
    common.bounded_batches(docs.sparkSession)
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    place = F.xxhash64("doc_id")
    last = usable.select(place.alias("place")).orderBy("place").limit(max_train).agg(F.max("place").alias("last")).first()["last"]
    if last is None:
        return [], np.zeros((0, DIM), dtype=np.float32)
    usable = usable.filter(place <= last)

    def process(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            rows = unit(bundles(batch.column(1).to_pylist()))
            for lang in set(langs):
                sums[lang] = sums.get(lang, 0) + rows[[k for k, x in enumerate(langs) if x == lang]].sum(axis=0).astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["lang", "bundle"])

    total: dict[str, np.ndarray] = {}
    for row in usable.select("lang", "text").mapInArrow(process, "lang string, bundle binary").collect():
        total[row["lang"]] = total.get(row["lang"], 0) + np.frombuffer(row["bundle"], dtype=np.float64)
    langs = sorted(x for x in total if np.any(total[x]))
    if not langs:
        return [], np.zeros((0, DIM), dtype=np.float32)
    prototypes = unit(np.stack([total[x] for x in langs]))
    if len(langs) > 1:
        prototypes = unit(prototypes - prototypes.mean(axis=0))
    return langs, np.round(prototypes, 6).astype(np.float32)


def identify(docs: DataFrame, langs: list[str], prototypes: np.ndarray) -> DataFrame:
    """One row per document: doc_id, lang_pred, score (the cosine, within 0 and 1)."""
    common.bounded_batches(docs.sparkSession)

    def process(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = bundles(batch.column(1).to_pylist())
            some = np.any(rows, axis=1) & bool(langs)
            cosine = unit(rows) @ prototypes.T if langs else np.zeros((len(rows), 1))
            best = cosine.argmax(axis=1)
            score = np.where(some, np.clip(cosine[np.arange(len(rows)), best], 0.0, 1.0), 0.0).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([langs[b] if s else "und" for b, s in zip(best, some, strict=True)], pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(process, SCHEMA)


def recognised(docs: DataFrame, langs: list[str], prototypes: np.ndarray, least: float) -> DataFrame:
    """The documents, all columns, that get a language with a score of at least `least`."""
    common.bounded_batches(docs.sparkSession)

    def process(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = bundles(batch.column("text").to_pylist())
            best = (unit(rows) @ prototypes.T).max(axis=1) if langs else np.zeros(len(rows))
            yield batch.filter(pa.array(np.any(rows, axis=1) & (best >= least)))

    return docs.mapInArrow(process, docs.schema)


def held_out():
    """Whether a row is kept from learning, by its doc_id alone."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def language_ids(docs: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """Learn from the rows that aren't held out, then predict every row."""
    langs, prototypes = train(docs.filter(~held_out()), max_train)
    return identify(docs, langs, prototypes).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

"""Operator 10: benchmark passages in documents by q-gram counting in diagonal bands.

Texts are lower-cased and everything that is neither letter nor digit becomes one blank. By the q-gram
lemma, a place where a passage of m characters stands with at most e edits shares at least
m + 1 - q - q * e of the passage's q-grams, on diagonals no more than e apart. Shared q-grams are
counted in bands of diagonals that overlap by half, bands below the bound are dropped, and the rest is
verified by an alignment that stays within the band's diagonals and e more on either side. Bands are as wide as the
passage's own budget asks. The budget e is RATE of the passage's length, less for short
ones, so that the bound stays positive; passages shorter than q must stand exactly, between blanks.

Documents are read once and never shuffled. The passages go to every task as an index; a benchmark
beyond INDEX_BYTES is cut into several, which the documents pass one after another.

Defined results: null and empty texts hold no passage; null or blank passages are skipped and passages
of equal text are found together; an empty benchmark leaves all documents clean; ties and repeated rows are
judged each; an empty table gives an empty result; other columns stay as they are in `search` and `clean`, whatever
their names, and are ignored in `passages`. Very long texts are normalised whole and searched in pieces that overlap by more
than a passage and its edits; start and stop count normalised symbols of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

Q = 8
#: Edits allowed for each character of a passage.
RATE = 0.08
#: Characters read at a time.
PIECE = 1 << 20
#: Text bytes of passages in one index.
INDEX_BYTES = 12 << 20
#: Separates texts; never part of a q-gram that is looked up.
WALL = 65535

_LUT: list[np.ndarray] = []


def _symbols(text: str) -> np.ndarray:
    if not _LUT:
        _LUT.append(np.fromiter((1 + i % 65000 if chr(i).isalnum() else 0 for i in range(0x110000)), dtype=np.uint16, count=0x110000))
    # one small sigma: which of the two lower() gives depends on what stands around it
    return _LUT[0][np.frombuffer(text.lower().replace("ς", "σ").encode("utf-32-le", "surrogatepass"), dtype="<u4")]


def symbols(text: str) -> np.ndarray:
    """Letters and digits of the lower-cased text as numbers, 0 for each run of other characters."""
    ids = _symbols(text) if len(text) <= PIECE else np.concatenate([_symbols(text[k : k + PIECE]) for k in range(0, len(text), PIECE)])
    if not len(ids):
        return ids
    keep = np.ones(len(ids), dtype=bool)
    keep[1:] = (ids[1:] != 0) | (ids[:-1] != 0)
    return ids[keep]


def trimmed(ids: np.ndarray) -> np.ndarray:
    some = np.flatnonzero(ids)
    return ids[some[0] : some[-1] + 1] if len(some) else ids[:0]


def grams(ids: np.ndarray, q: int = Q) -> np.ndarray:
    """Hashes of all q-grams (q a power of two)."""
    h = ids.astype(np.uint64) + np.uint64(1)
    factor, span = common.BASE, 1
    while span < q:
        if len(h) <= span:
            return h[:0]
        h = h[:-span] + h[span:] * np.uint64(factor)
        factor = factor * factor & common.MASK
        span *= 2
    return h * np.uint64(0xD1342543DE82EF95)


def budget(m: int, q: int = Q, rate: float = RATE) -> int:
    return max(0, min(int(rate * m), (m - q) // q))


#: Costs are counted in these units, so that a place fits beside one.
UNIT = 1 << 24


def aligned(window: np.ndarray, passage: np.ndarray, limit: int) -> tuple[int, int, int] | None:
    """The least edits between the passage and a part of the window along its diagonals, with the part's start and end; None beyond the limit.

    The window holds len(window) - len(passage) + 1 diagonals; a part may begin on any of them and stays on them.
    Cell b of row j: the passage's first j symbols against a part that ends at window[j + b]; its cost, and where its part begins.
    """
    width = len(window) - len(passage) + 1
    steps = np.arange(width) * UNIT
    row = np.arange(width)
    for j, symbol in enumerate(passage):
        new = row + UNIT * (window[j : j + width] != symbol)
        new[:-1] = np.minimum(new[:-1], row[1:] + UNIT)  # a symbol of the passage is missing
        row = np.minimum.accumulate(new - steps) + steps  # symbols of the text are more
        if row.min() >= (limit + 1) * UNIT:
            return None
    end = int((row // UNIT).argmin())
    return int(row[end]) // UNIT, int(row[end]) % UNIT, end + len(passage)


@dataclass
class Index:
    ids: list[int]
    passages: list[np.ndarray]
    keys: np.ndarray  # 32 bits of each gram's hash, ascending
    spots: np.ndarray  # where the grams stand in the passages put one behind another
    opens: np.ndarray  # where a passage begins there
    bits: int
    maybe: np.ndarray  # a bit for each value of the first bits of a hash
    budgets: np.ndarray
    needed: np.ndarray
    band: int

    @classmethod
    def build(cls, benchmark: list[tuple[int, str]], q: int = Q, rate: float = RATE) -> Index:
        found = [(i, p) for i, t in benchmark if t is not None and len(p := trimmed(symbols(t)))]
        ids, passages = [i for i, _ in found], [p for _, p in found]
        sizes = np.array([len(p) for p in passages], dtype=np.int64)
        opens = np.cumsum(np.append(0, sizes))[:-1] if len(sizes) else sizes
        per = [grams(p, q) for p in passages]
        flat = np.concatenate([*per, np.zeros(0, np.uint64)])
        spots = np.concatenate([*(np.arange(len(g), dtype=np.int32) + np.int32(o) for g, o in zip(per, opens, strict=True)), np.zeros(0, np.int32)])
        del per
        bits = max(16, int(len(flat) * 8).bit_length())
        maybe = np.zeros(1 << (bits - 3), dtype=np.uint8)
        first = (flat >> np.uint64(64 - bits)).astype(np.int64)
        np.bitwise_or.at(maybe, first >> 3, (1 << (first & 7)).astype(np.uint8))
        keys = (flat & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        del flat, first
        order = np.argsort(keys, kind="stable")
        budgets = np.array([budget(m, q, rate) for m in sizes], dtype=np.int64)
        return cls(ids, passages, keys[order], spots[order], opens, bits, maybe, budgets, sizes + 1 - q - q * budgets, int(budgets.max(initial=0)) + 1)

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.spots, self.opens, self.maybe, self.budgets, self.needed, *self.passages))

    def longest(self) -> int:
        return max((len(p) for p in self.passages), default=0)

    def search(self, texts: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start, end, edits) of the verified places."""
        wall = np.array([WALL], dtype=np.uint16)
        joined = np.concatenate([x for t in texts for x in (t, wall)])
        opens = np.cumsum([0] + [len(t) + 1 for t in texts])
        out: list[tuple[int, int, int, int, int]] = []
        h = grams(joined)
        first = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        hit = np.flatnonzero(self.maybe[first >> 3] >> (first & 7) & 1)
        del first
        if len(hit) and len(self.keys):
            own = (h[hit] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            low, high = np.searchsorted(self.keys, own, side="left"), np.searchsorted(self.keys, own, side="right")
            true = high > low
            hit, low, many = hit[true], low[true], (high - low)[true]
            spot = self.spots[np.repeat(low - np.cumsum(many) + many, many) + np.arange(int(many.sum()))].astype(np.int64)
            item = np.searchsorted(self.opens, spot, side="right") - 1
            diagonal = np.repeat(hit, many) - (spot - self.opens[item])
            # a diagonal is in its band and in the one before; a band is twice as wide as its step, the passage's own budget and 1
            step = (diagonal + self.longest()) // (self.budgets[item] + 1)
            width = int(len(joined) + 2 * self.longest()) + 3
            low = item * width + step
            keys, counts = np.unique(low, return_counts=True)
            after = np.searchsorted(keys, keys + 1)
            follows = (after < len(keys)) & (keys[np.minimum(after, len(keys) - 1)] == keys + 1)
            both = counts + np.where(follows, counts[np.minimum(after, len(keys) - 1)], 0)
            enough = both >= self.needed[keys // width]
            ends: dict[tuple[int, int], int] = {}
            for key in keys[enough].tolist():
                k, b = divmod(key, width)
                m, e = len(self.passages[k]), int(self.budgets[k])
                first_diagonal = b * (e + 1) - self.longest()
                lo, hi = first_diagonal - e, first_diagonal + 2 * (e + 1) + m + e
                # every text that the band touches; beyond its ends stand walls, which match nothing
                for d in range(max(0, int(np.searchsorted(opens, max(lo, 0), side="right")) - 1), min(len(texts), int(np.searchsorted(opens, hi - 1, side="right")))):
                    a, z = max(lo, int(opens[d])), min(hi, int(opens[d + 1]) - 1)
                    if z - a < m - e or a < ends.get((d, k), -1):
                        continue
                    window = np.full(hi - lo, WALL, dtype=np.uint16)
                    window[a - lo : z - lo] = joined[a:z]
                    if (got := self._verify(window, k)) is not None:
                        begin, stop = max(lo + got[1], int(opens[d])), min(lo + got[2], z)
                        out.append((d, k, begin - opens[d], stop - opens[d], got[0]))
                        ends[d, k] = stop
        for k, p in enumerate(self.passages):
            if len(p) < Q:
                needle = np.concatenate([[0], p, [0]]).astype(np.uint16).tobytes()
                for d, t in enumerate(texts):
                    padded = np.concatenate([[0], t, [0]]).astype(np.uint16).tobytes()
                    at_ = padded.find(needle)
                    while at_ >= 0 and at_ % 2:
                        at_ = padded.find(needle, at_ + 1)
                    if at_ >= 0:
                        out.append((d, k, at_ // 2, at_ // 2 + len(p), 0))
        return out

    def _verify(self, window: np.ndarray, k: int) -> tuple[int, int, int] | None:
        """Edits, start and end of the passage in the window."""
        p, raw = self.passages[k], np.ascontiguousarray(window).tobytes()
        needle = p.tobytes()
        at = raw.find(needle)
        while at >= 0 and at % 2:
            at = raw.find(needle, at + 1)
        if at >= 0:
            return 0, at // 2, at // 2 + len(p)
        got = aligned(window, p, int(self.budgets[k]))
        return got


HIT = pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("edits", pa.int64())])


def pieces(texts: list[str | None], overlap: int, piece: int) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Groups of about `piece` symbols: (row, place in the row's symbols, symbols)."""
    group, size = [], 0
    for row, t in enumerate(texts):
        ids = symbols(t or "")
        for low in range(0, max(1, len(ids)), piece):
            part = ids[low : low + piece + overlap]
            group.append((row, low, part))
            size += len(part)
            if size >= piece:
                yield group
                group, size = [], 0
    if group:
        yield group


def _pass(docs: DataFrame, index: Index, hits: str) -> DataFrame:
    """Add what one index finds to an array column."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    schema, piece = docs.schema, PIECE

    def process(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        overlap = index.longest() + 2 * index.band
        for batch in batches:
            found = [{(h["item_id"], h["start"], h["stop"], h["edits"]) for h in x or []} for x in batch.column(hits).to_pylist()]
            for group in pieces(batch.column("text").to_pylist(), overlap, piece):
                for d, k, a, z, e in index.search([p for _, _, p in group]):
                    row, low, _ = group[d]
                    found[row].add((int(index.ids[k]), low + int(a), low + int(z), e))
            column = pa.array([[dict(zip(("item_id", "start", "stop", "edits"), x, strict=True)) for x in sorted(h)] for h in found], pa.list_(HIT))
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([column if n == hits else batch.column(n) for n in names], names=names)

    return docs.mapInArrow(process, schema)


def search(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> tuple[DataFrame, str]:
    """The documents with one more column, and its name: item_id, start and stop (in normalised text) and edits of what was found."""
    common.bounded_batches(docs.sparkSession)
    hits = common.fresh(docs, "hits")[0]
    items = benchmark.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-size // INDEX_BYTES))
    found = docs.withColumn(hits, F.expr("CAST(array() AS array<struct<item_id:bigint,start:bigint,stop:bigint,edits:bigint>>)"))
    for k in range(parts):
        part = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        rows = sorted((r["item_id"] if r["item_id"] is not None else -1, r["text"]) for r in part.collect())  # about INDEX_BYTES
        found = _pass(found, Index.build(rows, rate=rate), hits)
        if k + 1 < parts:  # one index in a worker's memory at a time
            found = common.cut_lineage(found)
    return found, hits


def passages(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """One row per document: doc_id, contaminated, n_items, item_ids (ascending), hits."""
    found, hits = search(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, rate)
    ids = F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["item_id"])))
    return found.select("doc_id", (F.size(hits) > 0).alias("contaminated"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), F.col(hits).alias("hits"))


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents in which no passage was found."""
    found, hits = search(docs, benchmark, rate)
    return found.filter(F.size(hits) == 0).drop(hits)

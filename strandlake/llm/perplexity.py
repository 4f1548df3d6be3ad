"""Operator 8: cross-entropy difference of a target and a background n-gram model.

Both models are bigram models over one vocabulary: every word of the documents. They have the same
smoothing (absolute discounting, with the interpolated unigram model), which leaves room for UNKNOWN
classes of words that no document has, and for VOCABULARY words at least. The target model learns from
documents with the target label, the background model from all others; counts cover every document. The models
are matched in size: the side with more text stands for the mean of all its samples that are as large as the other side.
With a share r of its n occurrences, a pair keeps n r - D (1 - exp(-n r)) after the discount D, as a Poisson law gives, and
its first word has the sum of 1 - exp(-n r) kinds of pairs; no count is dropped. A
document's loss under a model is its mean negative log probability per word (natural log), the first
word following a start mark; its score is the target loss less the background loss: low for documents
like the target's.

Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased, held as 64-bit hashes; pairs of words
too (64 bits of the first word, 48 of the second). Counts are tables that grow with the input, dealt to
buckets by hash of the first word. Documents are dealt to groups of about GROUP bytes; a group sends its
distinct words and pairs with their counts to the buckets and gets their counts in all documents back in
the same order, so that nothing is sent for each word of a text. Pairs of frequent first words (found in a
sample, HEAVY at most) are dealt by the second word as well; this changes where they are counted, not
what is. The driver gets a few sums of each bucket. Beyond about a GB of text, groups and buckets grow with the root of the
input, so that the rows between them (one for each group and bucket) grow with the input, not with its square.

Defined results: null and empty texts have 0 words and losses and score 0; several labels of a document
count as target if one is; documents without a label belong to the background; repeated rows count and
are scored each; without a target document the target model is uniform; an empty table gives an empty
result; other columns, whatever their names, are ignored; ties don't matter; a very long text is hashed in pieces and makes its
group as much larger. A group's documents are read twice and must be the same then.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

VOCABULARY, UNKNOWN = 1000, 23
#: Cells of a row of a model at least; the last is the start mark.
SIZE = VOCABULARY + UNKNOWN + 1
#: Stands for the start mark among hashes.
START = np.uint64(0)
DISCOUNT = 0.75
#: Bytes of text in a group of documents, and behind a bucket of counts.
GROUP, BUCKET = 10 << 20, 12 << 20
#: Bytes of text for each row that is sent between groups and buckets, at least.
MESSAGE = 100_000
#: Kinds of pairs are told in such parts.
PARTS = 1 << 20
#: First words whose pairs are dealt to all buckets: those above 1 of so many words of a sample, so no more than that.
HEAVY = 1000
TAG = np.uint64((1 << 48) - 1)

SCHEMA = "doc_id long, n_words long, target_loss double, background_loss double, score double"
#: Words of bucket b with counts, their pairs' second words with counts, pairs of heavy first words; the counts are packed.
REQUEST = "b int, g int, words binary, tags binary, n binary"
#: Counts for a group, or with g = -1 sums of a bucket.
TOLD = "b int, g int, n binary"


def hashes(text: str | None) -> np.ndarray:
    return common.hash_words(np.frombuffer(common.as_bytes(text).translate(common.LOWER), dtype=np.uint8))[0]


def packed(*columns: np.ndarray) -> bytes:
    """Whole numbers, bytes of equal weight together."""
    return zlib.compress(np.concatenate(columns).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(raw.T).view("<i8").ravel()


def tagged(h: np.ndarray) -> bytes:
    """48 bits of each hash."""
    return np.ascontiguousarray((h & TAG).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def untagged(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


class Group:
    """Distinct words and pairs of some texts; the start mark is word 0, and pairs are in the order of their buckets, heavy ones last in each."""

    def __init__(self, texts: list[str | None], buckets: int, heavy: np.ndarray):
        own = [hashes(t) for t in texts]
        self.lengths = np.array([len(h) for h in own], dtype=np.int64)
        self.words, ids = np.unique(np.concatenate([[START], *own]).astype(np.uint64), return_inverse=True)
        del own
        ids[0] = 0
        self.ids, self.before = ids[1:], ids[:-1].copy()
        first = np.cumsum(self.lengths) - self.lengths
        self.before[first[self.lengths > 0]] = 0
        codes, place = np.unique(self.before * len(self.words) + self.ids, return_inverse=True)
        v, w = np.divmod(codes, len(self.words))
        self.home = (self.words % np.uint64(buckets)).astype(np.int64)
        at = np.minimum(np.searchsorted(heavy, self.words), len(heavy) - 1)
        self.rank = np.where(heavy[at] == self.words, at, -1)  # among heavy words
        hot = self.rank[v] >= 0
        part = 2 * np.where(hot, ((self.words[w] & TAG) % np.uint64(buckets)).astype(np.int64), self.home[v]) + hot
        order = np.argsort(part, kind="stable")
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        self.place = back[place]
        self.v, self.w = v[order], w[order]
        #: Ends of the parts: of bucket b, pairs of its own words at 2 b and heavy ones at 2 b + 1.
        self.ends = np.cumsum(np.bincount(part, minlength=2 * buckets))
        #: Words by bucket, ascending.
        self.by_home = np.argsort(self.home, kind="stable")
        self.home_ends = np.cumsum(np.bincount(self.home, minlength=buckets))

    def bucket(self, b: int) -> tuple[np.ndarray, slice, slice]:
        """Its words, the pairs of those, and pairs of heavy words in it."""
        x, y, z = (int(self.ends[2 * b - 1]) if b else 0), int(self.ends[2 * b]), int(self.ends[2 * b + 1])
        return self.by_home[(int(self.home_ends[b - 1]) if b else 0) : int(self.home_ends[b])], slice(x, y), slice(y, z)


def _rows(rows: list[tuple], schema: str) -> pa.Table:
    types = {"int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.table([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _heavy(docs: DataFrame) -> np.ndarray:
    """The start mark and frequent words of some texts, ascending; any choice gives the same results."""
    some = docs.select(F.substring("text", 1, 20_000).alias("text")).limit(1000).collect()
    words, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *(hashes(r["text"]) for r in some)]), return_counts=True)
    return np.union1d(words[n * HEAVY > n.sum()], [START]).astype(np.uint64)


def _requests(groups: DataFrame, marked: DataFrame, buckets: int, heavy: np.ndarray) -> DataFrame:
    """What the groups have: distinct words and pairs with their counts on both sides, by bucket."""

    def process(docs: pa.Table, targets: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _rows([], REQUEST)
        g = docs.column("g")[0].as_py()
        side = pc.is_in(docs.column("doc_id"), value_set=targets.column("doc_id").combine_chunks()).fill_null(False).to_numpy()
        x = Group(docs.column("text").to_pylist(), buckets, heavy)
        target = np.repeat(side.astype(bool), x.lengths)

        def sides(places: np.ndarray, size: int) -> list[np.ndarray]:
            t = np.bincount(places[target], minlength=size)
            return [t, np.bincount(places, minlength=size) - t]

        pairs, counts, rows = sides(x.place, len(x.v)), sides(x.ids, len(x.words)) + sides(x.before, len(x.words)), []
        runs, slot = np.bincount(x.v, minlength=len(x.words)), np.where(x.rank >= 0, 0, 1)
        for b in range(buckets):
            words, own, hot = x.bucket(b)
            both = slice(own.start, hot.stop)
            if len(words) or hot.stop > hot.start:
                sizes = np.array([len(words), hot.stop - hot.start])
                rows.append((b, g, x.words[words].tobytes(), tagged(x.words[x.w[both]]), packed(sizes, (runs * slot)[words], x.rank[x.v[hot]], *(n[words] for n in counts), *(n[both] for n in pairs))))
        return _rows(rows, REQUEST)

    return groups.groupBy("g").cogroup(marked.groupBy("g")).applyInArrow(process, REQUEST)


def _told(requests: DataFrame, heavy: np.ndarray, rates: tuple[float, float]) -> DataFrame:
    """Counts in all documents: of pairs on both sides, then of words as such, as first words, and their kinds of pairs (in PARTS), on both sides each.

    The sums of a bucket are its words, their counts on both sides, and the kinds of pairs of heavy words on both sides. rates: shares of the sides' texts.
    """

    def process(asked: pa.Table) -> pa.Table:
        b, groups = asked.column("b")[0].as_py(), asked.column("g").to_pylist()
        keys = [np.frombuffer(k, np.uint64) for k in asked.column("words").to_pylist()]
        words, at = np.unique(np.concatenate(keys), return_inverse=True)
        total, first, sums, places, low = np.zeros((6, len(words)), dtype=np.int64), [], [], [], 0
        for key, n in zip(keys, asked.column("n").to_pylist(), strict=True):
            flat, own = unpacked(n), at[low : low + len(key)]
            (k, hot), flat = flat[:2].tolist(), flat[2:]
            first += [np.repeat(own, flat[:k]), len(words) + flat[k : k + hot]]  # heavy ones after the bucket's own
            total[:4, own] += flat[k + hot : 5 * k + hot].reshape(4, k)  # a row has a word once
            sums.append(flat[5 * k + hot :].reshape(2, -1))
            places.append(own)
            low += len(key)
        second = np.concatenate([untagged(t) for t in asked.column("tags").to_pylist()])
        before = np.concatenate(first)
        del first
        _, one, place = np.unique(common.splitmix(np.concatenate([words, heavy])[before] * np.uint64(common.BASE) + second), return_index=True, return_inverse=True)
        pairs = [np.bincount(place, weights=np.concatenate([s[side] for s in sums])).astype(np.int64) for side in (0, 1)]
        kinds = [np.rint(PARTS * np.bincount(before[one], weights=seen(n, rate), minlength=len(words) + len(heavy))).astype(np.int64) for n, rate in zip(pairs, rates, strict=True)]
        total[4:] = [n[: len(words)] for n in kinds]
        rows, low = [(b, -1, packed(np.array([int((words != START).sum()), *total[:2].sum(axis=1)]), *(n[len(words) :] for n in kinds)))], 0
        for g, own, s in zip(groups, places, sums, strict=True):
            mine = place[low : low + s.shape[1]]
            rows.append((b, g, packed(*(n[mine] for n in pairs), *total[:, own])))
            low += s.shape[1]
        return _rows(rows, TOLD)

    return requests.groupBy("b").applyInArrow(process, TOLD)


def seen(n: np.ndarray, rate: float) -> np.ndarray:
    """The mean number (0 to 1) of kinds that n occurrences make in a share of the text."""
    return (n > 0).astype(np.float64) if rate >= 1 else -np.expm1(-rate * n)


def losses(pairs: np.ndarray, before: np.ndarray, kinds: np.ndarray, word: np.ndarray, total: int, size: int, rate: float = 1.0) -> np.ndarray:
    """Negative log probabilities of pairs from the counts of pair and first word, the first word's kinds of pairs and the word's count, in a share of the text."""
    unigram = (rate * word + 1.0) / (rate * total + size)
    had = np.maximum(rate * before, 1e-300)
    rest = np.where(before > 0, DISCOUNT * kinds / had, 1.0)
    return -np.log(np.maximum(rate * pairs - DISCOUNT * seen(pairs, rate), 0.0) / had + rest * unigram)


def _scored(groups: DataFrame, told: DataFrame, buckets: int, heavy: np.ndarray, sums: np.ndarray, rates: tuple[float, float]) -> DataFrame:
    size, totals, heavy_kinds = max(VOCABULARY, int(sums[0])) + UNKNOWN + 1, sums[1:3].tolist(), sums[3:].reshape(2, -1)

    def process(docs: pa.Table, counts: pa.Table) -> pa.Table:
        x = Group(docs.column("text").to_pylist(), buckets, heavy)
        pairs, known = np.zeros((2, len(x.v)), dtype=np.int64), np.zeros((6, len(x.words)), dtype=np.int64)
        for b, n in zip(counts.column("b").to_pylist(), counts.column("n").to_pylist(), strict=True):
            words, own, hot = x.bucket(b)
            flat, k = unpacked(n), 2 * (hot.stop - own.start)
            pairs[:, own.start : hot.stop] = flat[:k].reshape(2, -1)
            known[:, words] = flat[k:].reshape(6, -1)
        hot = x.rank >= 0
        known[4:, hot] = heavy_kinds[:, x.rank[hot]]
        ends = np.cumsum(x.lengths)
        means = []
        for side in (0, 1):
            loss = losses(pairs[side], known[2 + side][x.v], known[4 + side][x.v] / PARTS, known[side][x.w], totals[side], size, rates[side])
            running = np.append(0.0, np.cumsum(loss[x.place]))
            means.append((running[ends] - running[ends - x.lengths]) / np.maximum(x.lengths, 1))
        return pa.table([docs.column("doc_id"), x.lengths, *means, means[0] - means[1]], names=["doc_id", "n_words", "target_loss", "background_loss", "score"])

    return groups.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(process, SCHEMA)


def shares(docs: DataFrame, targets: DataFrame) -> tuple[int, tuple[float, float]]:
    """Bytes of all texts, and the shares of the target's and the background's that match in size. targets: distinct doc_ids."""
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n"))
    both = sizes.join(targets.select("doc_id", F.lit(1).alias("t")), "doc_id", "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("n") * F.col("t")), F.lit(0)).alias("t")).first()
    whole, target = both["n"], both["t"]
    least = min(target, whole - target)
    return whole, (least / target if least else 1.0, least / (whole - target) if least else 1.0)


def dealing(size: int) -> tuple[int, int]:
    """Groups and buckets for so many bytes. Both grow with the root of the input once MESSAGE bytes of text come for each row between them, so that rows grow with the input."""
    more = max(1.0, (size * MESSAGE / (GROUP * BUCKET)) ** 0.5)
    return max(1, -(-size // int(GROUP * more))), max(1, -(-size // int(BUCKET * more)))


def cross_entropy_difference(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Target: documents with quality 1. One row per document."""
    common.bounded_batches(docs.sparkSession)
    ids = F.col("doc_id").cast("long").alias("doc_id")
    targets = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(ids).distinct()
    size, rates = shares(docs, targets)
    dealt, buckets = dealing(size)
    heavy = _heavy(docs)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(dealt)).cast("int")
    apart = F.pmod(F.xxhash64("text"), F.lit(dealt)).cast("int")
    groups = docs.select(ids, "text").select("doc_id", "text", F.when(F.col("doc_id").isNull(), apart).otherwise(place).alias("g"))
    marked = targets.select("doc_id", place.alias("g"))
    told = common.cut_lineage(_told(_requests(groups, marked, buckets, heavy), heavy, rates))
    sums = np.zeros(3 + 2 * len(heavy), dtype=np.int64)
    for r in told.filter("g < 0").select("n").toLocalIterator():
        sums += unpacked(r["n"])
    return _scored(groups, told.filter("g >= 0"), buckets, heavy, sums, rates)

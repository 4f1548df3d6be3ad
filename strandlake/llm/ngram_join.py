"""Operator 3: exact Jaccard join of documents' word n-gram sets, as a metric-space join.

Jaccard distance is a metric, so links (similarity at least 75 of 100, that is a distance of at most
1/4) can be found region by region. Most documents share nothing with any given pivot, though: at
distance 1 from all pivots, the triangle inequality tells none of them apart. Regions are therefore
seeded by shared rare shingles: with the shingles of every set in one order, rare first, two linked
sets share one among their first n + 1 - ceil(0.75 n); all sets with a given such shingle form a
region, and every linked pair is together in one.

Within a region the metric is the distance of sketches (sizes of the parts of a set, by hash, modulo 4;
their Lee distance is a metric and never above the symmetric difference of the sets). Pivots cut a region
into Voronoi cells. Linked sets differ in at most a third of either's size, so by the triangle inequality a
member is needed in all cells whose pivot is no farther than the cell's radius and that third (the
boundary is in several cells), and cells are joined recursively by pivots of their own until they are small.
The pairs that remain are measured exactly, by their sets.

Links join components, and pairs within a component need no measuring. So each member asks for its
nearest candidates first (in a large region: for the nearest of its pivots), and a region that left some out
comes again, with many times as many, for members outside its largest component only; it is done when none is left out.
A region above LARGE members is dealt to tasks by blocks of members, whatever its size.

Equal sets are one entity with its documents as members, so copies are never compared. The order of the
shingles comes from a table of fixed size: counts by hash of the shingles of one document in SAMPLE.
Any order is lossless; the table only moves frequent shingles back. Shingles are 64-bit hashes, sets are
named by 128-bit digests.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a text of fewer than five words is one shingle. Defined
results: null texts and texts without words have an empty set, link with nothing and are their own
component; equal doc_ids share a component only by links; a null doc_id counts as the smallest and
stays null; ties don't matter, as components don't depend on order; a very long text is hashed in pieces and its
set kept whole; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

N = 5
#: Similarity in hundredths.
LEAST = 75
#: Regions of up to so many members are all pairs at once.
TINY = 6
#: Regions up to this size are searched for members that can't have a partner.
PRUNED = 512
#: Regions up to this size begin with all their members, larger ones with their pivots.
SMALL = 512
#: Members of a region in a task; a larger region is dealt by blocks of members.
LARGE = 1024
#: Pivots of a region or cell; pairs of members that are compared without further cells.
PIVOTS, DIRECT = 8, 1 << 18
#: Candidates that a member asks for at first; in each later turn MORE times as many.
NEAREST, MORE = 2, 1024
SAMPLE = 2
ORDER_BITS = 20
#: Parts of the sketches of sets by their size: of up to so many shingles, and beyond.
SKETCHES, SKETCH = ((500, 256), (2000, 1024), (8000, 4096), (1 << 62, 16384)), 256
#: Links that a task joins by itself.
EDGES = 200_000
#: Elements held before a task sends them.
HELD = 2_000_000
NO_ID = -(1 << 63)


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct shingle hashes, ascending."""
    words = common.hash_words(np.frombuffer(common.as_bytes(text).translate(common.LOWER), dtype=np.uint8))[0]
    s = np.sort(common.shingles(words, N))
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def short(sig: str):
    """The first eight bytes of a signature, as the number that _regions takes them for."""
    return F.expr(f"CAST(conv(hex(substring({sig}, 1, 8)), 16, -10) AS BIGINT)")


def signature(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _gray(sizes: np.ndarray) -> bytes:
    """Sizes modulo 4 as two planes of bits: the codes of neighbours (0 and 3 too) differ in one bit."""
    high, low = (sizes >> 1) & 1, sizes & 1
    return np.packbits(np.concatenate([high, high ^ low]).astype(np.uint8)).tobytes()


def sketch(s: np.ndarray) -> bytes:
    """Sizes of the parts of a set, by hash, modulo 4, as bits; more parts for large sets.

    Two sets differ in at least as many shingles as their sketches differ in bits.
    """
    parts = next(p for most, p in SKETCHES if len(s) <= most)
    return _gray(np.bincount((s & np.uint64(parts - 1)).astype(np.int64), minlength=parts))


def folded(x: bytes, parts: int = SKETCH) -> np.ndarray:
    """A sketch in fewer parts, as 64-bit words."""
    if len(x) * 4 != parts:
        bits = np.unpackbits(np.frombuffer(x, dtype=np.uint8)).reshape(2, -1)
        x = _gray((2 * bits[0].astype(np.int64) + (bits[0] ^ bits[1])).reshape(-1, parts).sum(axis=0))
    return np.frombuffer(x, dtype=np.uint64)


def finer(d: np.ndarray, xs: list[bytes], ys: list[bytes]) -> np.ndarray:
    """Distances d of pairs of sketches, by the most parts that both have."""
    d = d.astype(np.int64)
    for k, (x, y) in enumerate(zip(xs, ys, strict=True)):
        if (parts := 4 * min(len(x), len(y))) > SKETCH:
            d[k] = np.bitwise_count(folded(x, parts) ^ folded(y, parts)).sum(dtype=np.int64)
    return d


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of x (m, words) from all rows of y (k, words), as (m, k)."""
    found = np.empty((len(x), len(y)), dtype=np.int32)
    step = max(1, (1 << 20) // max(1, x.size))
    for k in range(0, len(y), step):
        found[:, k : k + step] = np.bitwise_count(x[:, None] ^ y[k : k + step]).sum(axis=2, dtype=np.int32)
    return found


def _signed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n, sig, sketch, part, counts): a row per document; rows with counts hold a task's share of the order table."""

    def process(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table, held = ["doc_id", "text_hash", "n", "sig", "sketch", "part", "counts"], np.zeros(1 << ORDER_BITS, dtype=np.int64), []
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column(2).to_pylist()]
            sigs = [signature(s) if len(s) else None for s in sets]
            for s, sig in zip(sets, sigs, strict=True):
                if sig is not None and sig[0] % SAMPLE == 0:
                    held.append((s >> np.uint64(64 - ORDER_BITS)).astype(np.int64))
            if sum(map(len, held)) > HELD:
                table += np.bincount(np.concatenate(held), minlength=len(table))
                held = []
            none = pa.nulls(len(sets))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.binary()), pa.array([sketch(s) if len(s) else None for s in sets], pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())], names=names)
        if held:
            table += np.bincount(np.concatenate(held), minlength=len(table))
        parts = table.reshape(64, -1)
        some = [k for k in range(64) if parts[k].any()]
        if some:
            none = pa.nulls(len(some), pa.int64())
            packed = [zlib.compress(parts[k].astype("<u4").tobytes(), 1) for k in some]
            yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(len(some), pa.binary()), pa.nulls(len(some), pa.binary()), pa.array(some, pa.int32()), pa.array(packed, pa.binary())], names=names)

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(process, "doc_id long, text_hash long, n long, sig binary, sketch binary, part int, counts binary")


def _order_table(signed: DataFrame) -> np.ndarray:
    """Levels by hash: 0 for shingles as frequent as any, more for clearly frequent ones."""

    def process(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(zlib.decompress(packed), dtype="<u4").astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.astype("<i8").tobytes() for v in sums.values()], pa.binary())], names=["part", "sums"])

    dealt = signed.filter("part IS NOT NULL").select("part", "counts").repartition(64, "part")
    table = np.zeros((64, (1 << ORDER_BITS) // 64), dtype=np.float64)
    for r in dealt.mapInArrow(process, "part int, sums binary").collect():  # the table's fixed size
        table[r["part"]] = np.frombuffer(r["sums"], dtype="<i8")
    flat = table.ravel()
    usual = float(np.median(flat))
    beyond = flat - usual
    return np.where(beyond > 4 * np.sqrt(usual + 1) + 2, 1 + np.minimum(30, np.log2(np.maximum(beyond, 1))), 0).astype(np.uint8)


def prefix(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The first shingles of a set that a linked set must share one of: rare first, as 48-bit keys."""
    level = levels[(s >> np.uint64(64 - ORDER_BITS)).astype(np.int64)].astype(np.uint64)
    keys = np.sort((level << np.uint64(58)) | (s & np.uint64((1 << 58) - 1)))
    n = len(s)
    return common.splitmix(keys[: n + 1 - -(-LEAST * n // 100)]) >> np.uint64(16)


def _regions(docs: DataFrame, levels: np.ndarray, parts: int) -> DataFrame:
    """(region, a, b, rest, m, pivot): without region, pairs a and b of a tiny region; else a member a of a region of m members.

    a, b: first halves of signatures (short), which all sets of that half answer to; rest: shingles of a that don't stand before the region's shingle, at most.
    """
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, seen, held, size = shared.value, set(), [], 0

        def flush() -> pa.RecordBatch:
            keys = np.concatenate([k for k, _, _ in held])
            own = np.repeat(np.arange(len(held)), [len(k) for k, _, _ in held])
            n = np.array([n for _, _, n in held], dtype=np.uint32)
            sig = np.frombuffer(b"".join(s[:8] for _, s, _ in held), dtype=">i8").astype("<i8")
            place = np.concatenate([np.arange(len(k)) for k, _, _ in held])
            packed = (keys << np.uint64(16)) | (place * 256 // n[own]).astype(np.uint64)
            bucket = (keys % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((own, bucket))
            bucket, own, packed = bucket[order], own[order], packed[order]
            cuts = np.searchsorted(bucket, np.arange(parts + 1))
            rows = []
            for b in range(parts):
                lo, hi = cuts[b], cuts[b + 1]
                if hi > lo:
                    who, many = np.unique(own[lo:hi], return_counts=True)
                    rows.append((b, packed[lo:hi].tobytes(), sig[who].tobytes(), n[who].tobytes(), many.astype(np.uint32).tobytes()))
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["bucket", "keys", "sigs", "ns", "many"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                s = shingle_set(text)
                if len(s) and (sig := signature(s)) not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(sig)
                    held.append((prefix(s, levels), sig, len(s)))
                    size += len(held[-1][0])
                    if size >= HELD:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sigs, ns = [], [], []
        for batch in batches:
            for row in batch.to_pylist():
                many = np.frombuffer(row["many"], dtype=np.uint32)
                keys.append(np.frombuffer(row["keys"], dtype=np.uint64))
                sigs.append(np.repeat(np.frombuffer(row["sigs"], dtype="<i8"), many))
                ns.append(np.repeat(np.frombuffer(row["ns"], dtype=np.uint32), many))
        if not keys:
            return
        packed, sig, n = np.concatenate(keys), np.concatenate(sigs), np.concatenate(ns)
        del keys, sigs, ns
        key, place = packed >> np.uint64(16), (packed & np.uint64(0xFFFF)).astype(np.int64)
        # most keys stand alone: leave them out before sorting by signature
        order = np.argsort(key)
        k = key[order]
        twin = np.zeros(len(k), dtype=bool)
        twin[1:] = k[1:] == k[:-1]
        twin[:-1] |= twin[1:]
        order = order[twin]
        if not len(order):
            return
        order = order[np.lexsort((sig[order], key[order]))]
        key, sig, n, place = key[order], sig[order], n[order].astype(np.int64), place[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])
        key, sig, n, place = key[new], sig[new], n[new], place[new]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        m = np.diff(np.append(first, len(key)))
        yield from _pairs_and_members(sig, n, place, first, m)

    buckets = docs.select("text").mapInArrow(send, "bucket int, keys binary, sigs binary, ns binary, many binary")
    return buckets.repartition(parts, "bucket").mapInArrow(meet, "region long, a long, b long, rest long, m long, pivot boolean")


def feasible(na, nb, ra, rb):
    """Whether sets of sizes na and nb can be linked if they share no shingle before ra and rb from their ends."""
    need = -(-LEAST * (na + nb) // (100 + LEAST))
    return (100 * np.minimum(na, nb) >= LEAST * np.maximum(na, nb)) & (np.minimum(ra, rb) >= need)


def _all_pairs(first, m, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs within the groups of exactly `size` members."""
    at = first[m == size]
    i, j = np.triu_indices(size, 1)
    return (at[:, None] + i).ravel(), (at[:, None] + j).ravel()


def _with_partner(n, rest, first, m) -> np.ndarray:
    """Whether a member of a region has another that it could be linked to."""
    keep = np.ones(len(n), dtype=bool)
    for lo, size in zip(first.tolist(), m.tolist(), strict=True):
        if TINY < size <= PRUNED:
            x, y = n[lo : lo + size], rest[lo : lo + size]
            may = feasible(x[:, None], x, y[:, None], y)
            np.fill_diagonal(may, False)
            keep[lo : lo + size] = may.any(axis=1)
    return keep


def _pairs_and_members(sig, n, place, first, m) -> Iterator[pa.RecordBatch]:
    region_of = np.repeat(np.arange(len(first)), m)
    rest = n - place * n // 256
    region_name = np.add.reduceat(common.splitmix(sig.view(np.uint64)), first).view(np.int64)
    # of tiny regions all pairs, of larger ones the members
    tiny = [_all_pairs(first, m, k) for k in range(2, TINY + 1)]
    i, j = np.concatenate([a for a, _ in tiny]), np.concatenate([b for _, b in tiny])
    good = feasible(n[i], n[j], rest[i], rest[j])
    i, j = i[good], j[good]
    pairs = np.unique(np.stack([np.maximum(sig[i], sig[j]), np.minimum(sig[i], sig[j])], axis=1), axis=0)
    # regions of equal members are one; a member keeps the most that any of them has left
    w = np.flatnonzero((m > TINY)[region_of] & _with_partner(n, rest, first, m))
    region = region_name[region_of[w]]
    order = np.lexsort((-rest[w], sig[w], region))
    w, region = w[order], region[order]
    one = np.ones(len(w), dtype=bool)
    one[1:] = (region[1:] != region[:-1]) | (sig[w][1:] != sig[w][:-1])
    w, region = w[one], region[one]
    start = np.searchsorted(region, region) if len(region) else region
    pivot = np.arange(len(w)) - start < PIVOTS
    columns = ["region", "a", "b", "rest", "m", "pivot"]
    for k in range(0, len(pairs), 50_000):
        p = pairs[k : k + 50_000]
        none = pa.nulls(len(p), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(p[:, 0]), pa.array(p[:, 1]), none, none, pa.nulls(len(p), pa.bool_())], names=columns)
    for k in range(0, len(w), 50_000):
        v = slice(k, k + 50_000)
        yield pa.RecordBatch.from_arrays([pa.array(region[v]), pa.array(sig[w[v]]), pa.nulls(len(w[v]), pa.int64()), pa.array(rest[w[v]]), pa.array(m[region_of[w[v]]].astype(np.int64)), pa.array(pivot[v])], names=columns)


def _cells(x: np.ndarray, y: np.ndarray, reach: np.ndarray, ix: np.ndarray, iy: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of rows i of ix and j of iy that are within reach[j], by recursive Voronoi cells of x.

    x, y: sketches; a row of y goes to every cell that the triangle inequality leaves open to it.
    """
    if len(ix) * len(iy) <= DIRECT:
        d = apart(x[ix], y[iy])
        i, j = np.nonzero(d <= reach[iy])
        yield ix[i], iy[j], d[i, j]
        return
    pivots = [int(ix[0])]
    d = apart(x[ix], x[pivots])
    while len(pivots) < PIVOTS and (far := int(d.min(axis=1).argmax())) >= 0 and d[far].min() > 0:
        pivots.append(int(ix[far]))
        d = np.concatenate([d, apart(x[ix], x[pivots[-1:]])], axis=1)
    cell, e = d.argmin(axis=1), apart(y[iy], x[pivots])
    for p in range(len(pivots)):
        own = np.flatnonzero(cell == p)
        if not len(own):
            continue
        near, far = d[own, p].min(), d[own, p].max()
        open_ = (e[:, p] <= far + reach[iy]) & (e[:, p] >= near - reach[iy])
        inner, outer = ix[own], iy[open_]
        if len(inner) == len(ix) or 2 * len(inner) * len(outer) > len(ix) * len(iy):  # cells that hardly shrink: blocks
            step = max(1, DIRECT // max(1, len(inner)))
            for k in range(0, len(outer), step):
                d_ = apart(x[inner], y[outer[k : k + step]])
                i, j = np.nonzero(d_ <= reach[outer[k : k + step]])
                yield inner[i], outer[k : k + step][j], d_[i, j]
        elif len(outer):
            yield from _cells(x, y, reach, inner, outer)


def _first_of_each(who: np.ndarray, d: np.ndarray, many: int) -> np.ndarray:
    """Marks of the `many` nearest of each in who."""
    order = np.lexsort((d, who))
    w = who[order]
    keep = np.zeros(len(w), dtype=bool)
    keep[order] = np.arange(len(w)) - np.searchsorted(w, w) < many
    return keep


def _candidates(rows: list[dict], many: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """(a, b, whether some were left out) of a block of a region: pairs of a target and a query of different components."""
    a, n, rest, label = (np.array([r[k] for r in rows], dtype=np.int64) for k in ("a", "n", "rest", "label"))
    target, query, star = (np.array([r[k] for r in rows], dtype=bool) for k in ("target", "query", "star"))
    order = np.lexsort((-rest, a))
    first = np.ones(len(a), dtype=bool)
    first[1:] = a[order][1:] != a[order][:-1]
    at = order[first]  # regions of equal members that met in several tasks hold a member several times
    target, query = (np.logical_or.reduceat(v[order], np.flatnonzero(first)) for v in (target, query))
    a, n, rest, label = a[at], n[at], rest[at], label[at]
    wide = [rows[k]["sketch"] for k in at]
    s = np.stack([folded(v) for v in wide])
    ix, iy = np.flatnonzero(target), np.flatnonzero(query)
    if not len(ix) or not len(iy):
        return a[:0], a[:0], False
    reach = n * (100 - LEAST) // LEAST
    found = list(_cells(s, s, reach, ix, iy))
    i, j, d = (np.concatenate([f[k] for f in found]) for k in range(3)) if found else (np.zeros(0, np.int64),) * 3
    need = -(-LEAST * (n[i] + n[j]) // (100 + LEAST))
    good = (a[i] != a[j]) & (label[i] != label[j]) & feasible(n[i], n[j], rest[i], rest[j]) & (d <= n[i] + n[j] - 2 * need)
    i, j, d, need = i[good], j[good], d[good], need[good]
    d = finer(d, [wide[k] for k in i], [wide[k] for k in j])
    good = d <= n[i] + n[j] - 2 * need
    i, j, d = i[good], j[good], d[good]
    keep = _first_of_each(i, d, 2) if star.any() else _first_of_each(j, d, many)
    return np.maximum(a[i], a[j])[keep], np.minimum(a[i], a[j])[keep], bool(star.any()) or not keep.all()


def _asked(dealt: DataFrame, many: int) -> DataFrame:
    """(region, a, b): pairs to be measured; regions that left some out, with nulls. dealt: blocks of regions."""
    names = ["region", "i", "j", "a", "n", "rest", "label", "sketch", "target", "query", "star"]

    def process(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def done() -> pa.RecordBatch:
            a, b, more = _candidates(held, many)
            region = pa.array([None] * len(a) + [key[0]] * more, pa.int64())
            return pa.RecordBatch.from_arrays([region, *(pa.concat_arrays([pa.array(v, pa.int64()), pa.nulls(int(more), pa.int64())]) for v in (a, b))], names=["region", "a", "b"])

        for batch in batches:
            for r in batch.to_pylist():
                if (r["region"], r["i"], r["j"]) != key:
                    if held:
                        yield done()
                    held, key = [], (r["region"], r["i"], r["j"])
                held.append(r)
        if held:
            yield done()

    keys = ["region", "i", "j"]
    return dealt.select(*names).repartition(common.partitions(dealt.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(process, "region long, a long, b long")


def _blocks(members: DataFrame) -> DataFrame:
    """Members of regions dealt by blocks: columns i, j, target, query. members: with m, everyone (compared with all), o (how many of them)."""
    chunks = F.ceil(F.col("m") / F.lit(LARGE)).cast("int")
    others = F.greatest(F.ceil(F.col("o") / F.lit(LARGE)), F.lit(1)).cast("int")
    x = members.withColumns({"ci": chunks, "cj": others})
    x = x.withColumns({"own_i": F.pmod(F.xxhash64("a"), "ci").cast("int"), "own_j": F.pmod(F.xxhash64("a", F.lit(1)), "cj").cast("int")})
    across = F.transform(F.sequence(F.lit(0), F.col("ci") - 1), lambda i: F.struct(i.alias("i"), F.col("own_j").alias("j")))
    along = F.transform(F.sequence(F.lit(0), F.col("cj") - 1), lambda j: F.struct(F.col("own_i").alias("i"), j.alias("j")))
    x = x.withColumn("to", F.explode(F.when(F.col("everyone"), F.array_union(across, along)).otherwise(along))).withColumns({"i": F.col("to.i"), "j": F.col("to.j")})
    return x.withColumns({"target": F.col("i") == F.col("own_i"), "query": F.col("everyone") & (F.col("j") == F.col("own_j"))})


def _marks(wanted: DataFrame) -> tuple[int, np.ndarray]:
    """Bits and a bitmap with the hashes of the wanted doc_ids: 32 slots an id, 2^28 at most (32 MB)."""
    bits = min(28, max(20, (32 * wanted.count()).bit_length()))
    slots = wanted.select(slot(F.col("rep"), bits).alias("slot"))
    found = slots.groupBy(F.expr("bitmap_bucket_number(slot)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits"))
    marks = np.zeros((2 + (1 << bits) // 32768, 4096), dtype=np.uint8)
    for r in found.collect():  # the bitmap's size
        marks[r["bucket"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return bits, marks


def slot(doc_id, bits: int):
    return F.pmod(F.xxhash64(doc_id), F.lit(1 << bits))


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sig, members), dealt by sig: the sets of the wanted entities (kept table: name, sig, rep), eight bytes a shingle.

    Texts aren't shuffled: a bitmap tells which may be wanted, and only their sets are sent on.
    """
    bits, marks = _marks(wanted)
    # buckets count from 1, of 32768 positions each
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def process(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        for batch in batches:
            bucket, position = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            hit = (marks[bucket, position >> 3] >> (position & 7).astype(np.uint8)) & 1
            sigs, packed = [], []
            for text in batch.column(2).filter(pa.array(hit.astype(bool))).to_pylist():
                s = shingle_set(text)
                if len(s):
                    sigs.append(signature(s))
                    packed.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.binary()), pa.array(packed, pa.binary())], names=["sig", "members"])

    places = docs.withColumn("slot", slot(F.col("doc_id"), bits)).select(F.expr("bitmap_bucket_number(slot)").alias("bucket"), F.expr("bitmap_bit_position(slot)").alias("position"), "text")
    found = places.mapInArrow(process, "sig binary, members binary")
    return found.join(wanted.select("sig").hint("merge"), "sig", "left_semi").dropDuplicates(["sig"])


def _maybe(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """(a, b) by name: the pairs of short names whose sketches don't rule a link out."""

    def process(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            xs, ys = batch.column("xa").to_pylist(), batch.column("xb").to_pylist()
            a, b, na, nb = (batch.column(k).to_numpy() for k in ("a", "b", "na", "nb"))
            x, y = (np.stack([folded(v) for v in z]) for z in (xs, ys))
            d = finer(np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64), xs, ys)
            good = d <= na + nb - 2 * -(-LEAST * (na + nb) // (100 + LEAST))
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)[good]), pa.array(np.minimum(a, b)[good])], names=["a", "b"])

    left = pairs.join(entities.select(F.col("short").alias("a"), F.col("name").alias("ka"), F.col("n").alias("na"), F.col("sketch").alias("xa")), "a")
    both = left.join(entities.select(F.col("short").alias("b"), F.col("name").alias("kb"), F.col("n").alias("nb"), F.col("sketch").alias("xb")), "b")
    return both.select(F.col("ka").alias("a"), F.col("kb").alias("b"), "na", "nb", "xa", "xb").mapInArrow(process, "a long, b long")


def _measure(pairs: DataFrame, wanted: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, shared, either) for distinct pairs (a, b) of the wanted. Pairs go to where sets are dealt; a set travels once more for each pair."""

    def process(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, either = [], []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                both = np.concatenate([np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)])
                both.sort(kind="stable")
                i = int((both[1:] == both[:-1]).sum())
                shared.append(i)
                either.append(len(both) - i)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(either, pa.int64())], names=["a", "b", "shared", "either"])

    keyed = pairs.join(wanted.select(F.col("name").alias("a"), F.col("sig").alias("ka")), "a").join(wanted.select(F.col("name").alias("b"), F.col("sig").alias("kb")), "b")
    left = keyed.join(sets.select(F.col("sig").alias("ka"), F.col("members").alias("sa")).hint("merge"), "ka").select("a", "b", "kb", "sa")
    both = left.join(sets.select(F.col("sig").alias("kb"), F.col("members").alias("sb")).hint("merge"), "kb")
    return common.cut_lineage(both.select("a", "b", "sa", "sb").mapInArrow(process, "a long, b long, shared long, either long"))


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node is either the centre of its edges (a, b) or has one edge, to a centre."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("x"), F.lit(1).alias("y")))
    return ends.groupBy("node").agg(F.sum("x").alias("x"), F.max("y").alias("y")).filter("x > 1 OR (x = 1 AND y = 1)").isEmpty()


def forest(edges: DataFrame) -> tuple[DataFrame, bool]:
    """Edges (a, b) as stars around the least nodes of what is joined in a task; then dealt by a, and again; whether one task had all.

    What was joined stays joined.
    """

    def process(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (up := parent.get(top, top)) != top:
                top = up
            while (up := parent.get(x, x)) != top:
                parent[x], x = top, up
            return top

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = root(a), root(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["a", "b"])

    tasks = max(1, -(-edges.count() // EDGES))
    local = edges.select("a", "b").coalesce(tasks).mapInArrow(process, "a long, b long").filter("a <> b")
    if tasks > 1:
        local = local.repartition(common.partitions(edges.sparkSession), "a").mapInArrow(process, "a long, b long").filter("a <> b")
    return common.cut_lineage(local), tasks == 1


def components(links: DataFrame) -> DataFrame:
    """(a, b): b is the least node that links reach from a, for nodes other than b.

    Edges of a node meet and become stars; an edge to a node that has an edge of its own takes its end; until only
    stars are left. A star's centre with many leaves is never gathered: edges are dealt by their leaves.
    """
    edges, whole = forest(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    while not whole and not _is_stars(edges):
        up = edges.select(F.col("a").alias("b"), F.col("b").alias("c"))
        edges, whole = forest(common.cut_lineage(edges.join(up, "b", "left").select("a", F.coalesce("c", "b").alias("b"))))
    return edges


LINKED = f"100 * shared >= {LEAST} * either"


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of regions of more than one component, with label, everyone (not of the region's largest component), o (how many such)."""
    x = members.join(labels.select("a", F.col("b").alias("label")), "a", "left").withColumn("label", F.coalesce("label", "a"))
    counts = x.groupBy("region", "label").agg(F.count("*").alias("k")).groupBy("region").agg(F.max_by("label", F.struct("k", "label")).alias("main"), (F.sum("k") - F.max("k")).alias("o"))
    return x.join(counts.filter("o > 0"), "region").withColumn("everyone", F.col("label") != F.col("main")).drop("main")


def _entities(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents (doc_id, text_hash, n, sig); sets; those that meet others, with names; the pairs and the members of regions that they make."""
    signed = common.cut_lineage(_signed(docs))
    # a set's name goes to each bucket that has one of its keys: fewer buckets than partitions
    found = common.cut_lineage(_regions(docs, _order_table(signed), max(4, common.partitions(docs.sparkSession) // 2)))
    signed = signed.filter("part IS NULL").drop("part", "counts")
    sets = common.cut_lineage(signed.filter("sig IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count("*").alias("entity_size"), F.first("n").alias("n"), F.first("sketch").alias("sketch")).withColumn("short", short("sig")))
    involved = found.select(F.col("a").alias("short")).unionByName(found.filter("region IS NULL").select(F.col("b").alias("short"))).distinct()
    entities = common.cut_lineage(sets.join(involved, "short", "left_semi").withColumn("name", F.monotonically_increasing_id()))
    pairs = _maybe(found.filter("region IS NULL").select("a", "b").distinct(), entities)
    members = found.filter("region IS NOT NULL").select("region", F.col("a").alias("short"), "rest", "m", "pivot").join(entities.select("short", "n", "sketch", F.col("name").alias("a")), "short").drop("short")
    return signed.drop("sketch"), sets.select("sig", "rep", "entity_size"), entities, pairs, members


def _links(docs: DataFrame, entities: DataFrame, pairs: DataFrame, members: DataFrame, everything: bool) -> tuple[DataFrame, DataFrame]:
    """Measured pairs by name (all that may be linked, if everything; else enough for the components), and components."""

    def measure(asked: DataFrame) -> DataFrame:
        names = asked.select(F.explode(F.array("a", "b")).alias("name")).distinct()
        wanted = common.cut_lineage(entities.select("name", "sig", "rep").join(names, "name", "left_semi"))
        return _measure(asked, wanted, _sets(docs, wanted))

    members = common.cut_lineage(members)
    all_ = F.lit(True) if everything else (F.col("m") <= SMALL) | F.col("pivot")
    many = 1 << 40 if everything else NEAREST
    dealt = members.withColumns({"label": F.col("a"), "everyone": all_, "o": F.when(F.lit(everything) | (F.col("m") <= SMALL), F.col("m")).otherwise(PIVOTS), "star": ~F.lit(everything) & (F.col("m") > SMALL)})
    found = common.cut_lineage(_asked(_blocks(dealt), many))
    measured = measure(common.cut_lineage(found.filter("region IS NULL").select("a", "b").unionByName(pairs).distinct()))
    labels = components(measured.filter(LINKED))
    left = found.filter("region IS NOT NULL").select("region").distinct()
    while not left.isEmpty():
        members = common.cut_lineage(members.join(left, "region", "left_semi"))
        many *= MORE
        found = common.cut_lineage(_asked(_blocks(_open(members, labels).withColumn("star", F.lit(False))), many))
        asked = common.cut_lineage(found.filter("region IS NULL").select("a", "b").distinct().join(measured.select("a", "b"), ["a", "b"], "left_anti"))
        if not asked.isEmpty():
            more = measure(asked)
            measured = measured.unionByName(more)
            labels = components(labels.unionByName(more.filter(LINKED).select("a", "b")))
        left = found.filter("region IS NOT NULL").select("region").distinct()
    return measured, labels


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")


def _components_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n, component_id, entity_size, class), doc_id NO_ID for null; class: a signature of the component, null for empty sets."""
    signed, sets, entities, pairs, members = _entities(docs)
    _, labels = _links(docs, entities, pairs, members, False)
    linked = entities.join(labels.select(F.col("a").alias("name"), F.col("b").alias("component")), "name", "left").withColumn("component", F.coalesce("component", "name"))
    roots = linked.groupBy("component").agg(F.min("rep").alias("root"), F.min("sig").alias("class"))
    named = sets.join(linked.join(roots, "component").select("sig", "root", "class"), "sig", "left")
    named = common.cut_lineage(named.select("sig", F.coalesce("root", "rep").alias("component_id"), "entity_size", F.coalesce("class", "sig").alias("class")))
    return signed.join(named, "sig", "left").select("doc_id", "text_hash", "n", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("entity_size", F.lit(1)).alias("entity_size"), "class")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, entity_size (documents with the same set)."""
    common.bounded_batches(docs.sparkSession)
    out = _components_of(_plain(docs)).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "entity_size")
    return out.withColumns({c: F.nullif(c, F.lit(NO_ID)) for c in ("doc_id", "component_id")})


def jaccard_links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All links between different sets, as (a, b, shared, either) with a > b, and membership as (doc_id, class); a, b and class are names.

    Without the short cut by components: every candidate pair of a region is measured. Empty sets have no class.
    """
    common.bounded_batches(docs.sparkSession)
    docs = _plain(docs)
    signed, sets, entities, pairs, members = _entities(docs)
    measured, _ = _links(docs, entities, pairs, members, True)
    alone = sets.select("sig").join(entities.select("sig"), "sig", "left_anti").select("sig", (-1 - F.monotonically_increasing_id()).alias("name"))
    named = common.cut_lineage(entities.select("sig", "name").unionByName(alone))
    return measured.filter(LINKED), signed.join(named, "sig", "left").select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), F.col("name").alias("class"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without all but one of each component: the one of the least doc_id (of several such rows, one).

    Columns of docs stay as they are, whatever their names; documents without words stay.
    """
    common.bounded_batches(docs.sparkSession)
    key, text = common.fresh(docs, "key", "text_hash")
    found = _components_of(_plain(docs)).filter("doc_id = component_id")
    one = found.filter("class IS NOT NULL").groupBy("class", "doc_id").agg(F.min("text_hash").alias("text_hash")).drop("class")
    kept = one.unionByName(found.filter("class IS NULL").select("doc_id", "text_hash")).distinct().toDF(key, text)
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(text, F.xxhash64("text"))
    return keyed.join(kept, [key, text], "left_semi").dropDuplicates([key, text]).select(*docs.columns)


def oracle() -> str:
    """DuckDB SQL for doc_id, n_shingles, component_id."""
    return rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
shingles AS (
  SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(ws) - {N - 1}, least(len(ws), 1)) + 1), lambda i: array_to_string(ws[i : i + {N - 1}], ' '))) AS s FROM words),
sets AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM shingles) GROUP BY s),
flat AS (SELECT rep, n, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.rep AS a, b.rep AS b, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM flat a JOIN flat b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= {LEAST} * greatest(a.n, b.n) GROUP BY a.rep, b.rep),
links AS (SELECT a, b FROM pairs WHERE 100 * i >= {LEAST} * (na + nb - i)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT DISTINCT a, a FROM sides UNION SELECT r.a, s.b FROM reach r JOIN sides s ON r.b = s.a),
roots AS (SELECT a AS rep, min(b) AS root FROM reach GROUP BY a)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, CASE WHEN len(d.s) = 0 THEN d.doc_id ELSE coalesce(r.root, t.rep) END AS component_id
FROM shingles d JOIN sets t ON t.s = list_sort(d.s) LEFT JOIN roots r ON r.rep = t.rep
"""

"""Operator 7: exact removal of repeated byte strings with suffix arrays.

Every byte covered by a WINDOW-byte string that also starts earlier (a smaller doc_id, or earlier in
the same document) is removed. Documents in order of doc_id are cut into shards.

1. Anchors: of the 32-byte grams of each window, the one with the least hash is an anchor, so equal
   windows have equal anchors at the same place. Windows of anchors that occur once anywhere are
   unique; their text is left out. Hashes meet by value, one per shard.
2. Per shard, the suffixes of what is left are sorted by the refinement of Larsson and Sadakane: ranks
   by eight bytes, doubled to 64 while groups of equal rank have several members (others stay as they
   are), and then to WINDOW by two overlapping ranks. Kasai's table of common prefixes follows for neighbours that
   agree in 64 bytes: where a place and its neighbour both follow the ones before, the prefix is one byte less; the first of
   such a run is compared, byte by byte. Places with a prefix of WINDOW bytes in common with the one before are repeats.
3. Across shards, a shard sends what stands around each anchor (once for equal surroundings) to where
   the anchor's hash belongs. There the windows of all shards are sorted by hash, each shard's windows are
   looked up by binary search, and what is found is compared byte by byte: those that an earlier shard has are repeats.
   Of an anchor that stands nearly everywhere (a line of dashes), windows go one by one to where their own hash belongs, so that no
   task gets all that stands around it.
4. Repeats come back to the shard, which removes the union of their bytes.

The texts are shuffled once and that shuffle is read three times. Hashes only bring windows together; equality is
always that of bytes.

Defined results: a null text is empty; documents of fewer than WINDOW bytes keep all; equal doc_ids
are ordered by text, null doc_ids come first; repeated rows count as documents of their own; very long texts are read in
pieces for their anchors and are part of one shard; an empty table gives an empty result; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 100
GRAM = 32
#: Bytes by which ranks are doubled; two overlapping ranks make a window.
HALF = 64
#: Bytes before and after an anchor that its windows can reach.
REACH = WINDOW - GRAM
SHARD_BYTES = 3 << 20
#: An anchor that stands so often in a shard counts as MANY; by shards' weights (once, several, many) above HOT, an anchor is hot.
MANY, WEIGHTS, HOT = 64, (1, 16, 1024), 4096
#: Bytes of a document taken at a time.
PIECE = 2 << 20
NO_ID = -(1 << 63)

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>"
MOVE = "target long, kind int, shard long, payload binary"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all GRAM-byte grams."""
    h, factor, span = common._powers()[2][data], common.BASE, 1
    while span < GRAM:
        h = h[:-span] + h[span:] * np.uint64(factor)
        factor = factor * factor & common.MASK
        span *= 2
    return common.splitmix(h)


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over all runs of width values."""
    span = 1
    while span * 2 <= width:
        values = pick(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return pick(values[:-rest], values[rest:]) if rest else values


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of a document's windows."""
    if len(data) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    found = []
    for low in range(0, len(data) - WINDOW + 1, PIECE):
        h = gram_hashes(data[low : low + PIECE + WINDOW - 1])
        width = REACH + 1
        least = _slide(h, width, np.minimum)  # per window
        walled = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
        at = np.flatnonzero(_slide(walled, width, np.maximum) >= h)  # some window has no less
        found.append((at + low, h[at]))
    places, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
    places, one = np.unique(places, return_index=True)
    return places, hashes[one]


def refine(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array, by WINDOW bytes, of the places whose first HALF bytes stand several times; marks of those that agree in HALF with the one before.

    Places where WINDOW bytes don't fit before the place's end are left out; equal ones stand in order of place.
    """
    n = len(data)
    room = ends - np.arange(n)
    rank = np.full(n, -1, dtype=np.int64)
    at = np.flatnonzero(room[: max(0, n - 7)] >= 8)
    if not len(at):
        return at, at.astype(bool)
    eight = np.ndarray((n - 7,), dtype=">u8", buffer=np.ascontiguousarray(data).data, strides=(1,))[at].astype(np.uint64)
    order = np.argsort(eight)
    at, key = at[order], eight[order]
    start = np.ones(len(at), dtype=bool)
    start[1:] = key[1:] != key[:-1]
    rank[at] = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
    for step in (8, 16, HALF // 2):
        # a place is refined with the rank `step` further on; both must have been ranked to the same depth
        many = np.bincount(rank[rank >= 0], minlength=n)
        fits = (rank >= 0) & (room >= 2 * step)
        rank_next = np.full(n, -1, dtype=np.int64)
        alone = fits & (many[np.maximum(rank, 0)] == 1)
        rank_next[alone] = rank[alone]
        a = np.flatnonzero(fits & ~alone)
        r, s = rank[a], rank[a + step]
        order = np.lexsort((s, r))
        a, r, s = a[order], r[order], s[order]
        i = np.arange(len(a))
        old = np.ones(len(a), dtype=bool)
        old[1:] = r[1:] != r[:-1]
        new = old.copy()
        new[1:] |= s[1:] != s[:-1]
        rank_next[a] = r + np.maximum.accumulate(np.where(new, i, 0)) - np.maximum.accumulate(np.where(old, i, 0))
        rank = rank_next
    fits = (rank >= 0) & (room >= WINDOW)
    many = np.bincount(rank[fits], minlength=n)
    a = np.flatnonzero(fits)
    a = a[many[rank[a]] > 1]
    r = rank[a]
    order = np.lexsort((rank[a + WINDOW - HALF], r))
    a, r = a[order], r[order]
    tied = np.zeros(len(a), dtype=bool)
    tied[1:] = r[1:] == r[:-1]
    return a, tied


def _extend(data: np.ndarray, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How many bytes from i and j on are equal, up to a limit; the first HALF are."""
    found = np.minimum(HALF, limit)
    active, width = np.flatnonzero(found < limit), 64
    while len(active):
        step = np.arange(width)
        for low in range(0, len(active), (1 << 20) // width):
            k = active[low : low + (1 << 20) // width]
            at = found[k, None] + step
            same = np.take(data, i[k, None] + at, mode="clip") == np.take(data, j[k, None] + at, mode="clip")
            found[k] = np.minimum(found[k] + np.where(same.all(axis=1), width, same.argmin(axis=1)), limit[k])
            active[low : low + len(k)] = np.where(same.all(axis=1) & (found[k] < limit[k]), k, -1)
        active, width = active[active >= 0], min(1 << 14, 4 * width)
    return found


def kasai(data: np.ndarray, ends: np.ndarray, suffixes: np.ndarray, tied: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places, ascending, that agree in HALF bytes with the one before in the suffix array, and the length of their common prefix.

    Lengths are told as far as they decide whether WINDOW bytes are common.
    """
    later = np.flatnonzero(tied)
    i, j = suffixes[later], suffixes[later - 1]
    order = np.argsort(i)
    i, j = i[order], j[order]
    head = np.ones(len(i), dtype=bool)
    head[1:] = (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1)
    first = np.flatnonzero(head)
    size = np.diff(np.append(first, len(i)))
    x, y = i[first], j[first]
    limit = np.minimum(size - 1 + WINDOW, np.minimum(ends[x] - x, ends[y] - y)) if len(i) else size
    lengths = _extend(data, x, y, limit)
    return i, np.repeat(lengths + first, size) - np.arange(len(i))


def runs(places: np.ndarray) -> np.ndarray:
    """First and last of the runs of consecutive numbers, in two columns."""
    if not len(places):
        return np.zeros((0, 2), np.int64)
    cut = np.flatnonzero(np.diff(places) != 1)
    return np.stack([places[np.concatenate([[0], cut + 1])], places[np.append(cut, len(places) - 1)]], axis=1)


def _texts(group: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=np.uint8) for x in group.column("data").to_pylist()]


def _in_order(group: pa.Table) -> pa.Table:
    return group.take(pc.sort_indices(group, sort_keys=[("doc_id", "ascending"), ("data", "ascending")]))


def _moves(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary())], names=["target", "kind", "shard", "payload"])


def _send_anchors(parts: int):
    def send(group: pa.Table) -> pa.Table:
        hashes = [anchors(t)[1] for t in _texts(group)]
        h, n = np.unique(np.concatenate([*hashes, np.zeros(0, np.uint64)]), return_counts=True)
        shard = group.column("shard")[0].as_py()
        bucket = h % np.uint64(parts)
        rows = []
        for kind, some in ((0, n == 1), (1, (n > 1) & (n < MANY)), (2, n >= MANY)):  # several, many in this shard
            order = np.argsort(bucket[some], kind="stable")
            b, x = bucket[some][order], h[some][order]
            cuts = np.searchsorted(b, np.arange(parts + 1, dtype=np.uint64))
            rows += [(k, kind, shard, x[cuts[k] : cuts[k + 1]].tobytes()) for k in range(parts) if cuts[k + 1] > cuts[k]]
        return _moves(rows)

    return send


def _flag(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Back to each shard: its hashes that several shards have (kind 1; 2 for the hot ones), and those it alone has several times (kind 0)."""
    rows = [r for b in batches for r in b.to_pylist()]
    if not rows:
        return
    h = [np.frombuffer(r["payload"], dtype=np.uint64) for r in rows]
    keys, at, n = np.unique(np.concatenate(h), return_inverse=True, return_counts=True)
    weight = np.bincount(at, weights=np.repeat([WEIGHTS[r["kind"]] for r in rows], [len(x) for x in h]), minlength=len(keys))
    kinds = np.where(n > 1, np.where(weight > limit, 2, 1), 0)
    out, low = [], 0
    for r, own in zip(rows, h, strict=True):
        kind = kinds[at[low : low + len(own)]]
        low += len(own)
        out += [(r["shard"], k, r["shard"], own[kind == k].tobytes()) for k in ((0, 1, 2) if r["kind"] else (1, 2)) if (kind == k).any()]
    for i in range(0, len(out), 1000):
        yield from _moves(out[i : i + 1000]).to_batches()


def _candidates(texts: list[np.ndarray], flagged: np.ndarray):
    """Anchors (text, place, hash) that are flagged, and the merged regions (text, start, stop) their windows reach."""
    who, where, what, regions = [], [], [], []
    for d, t in enumerate(texts):
        places, hashes = anchors(t)
        if len(places):
            at = np.minimum(np.searchsorted(flagged, hashes), len(flagged) - 1)
            hit = flagged[at] == hashes
            places, hashes = places[hit], hashes[hit]
            if len(places):
                who.append(np.full(len(places), d))
                where.append(places)
                what.append(hashes)
                lo, hi = np.maximum(places - REACH, 0), np.minimum(places + WINDOW, len(t))
                cut = np.flatnonzero(lo[1:] > hi[:-1]) + 1
                regions += [(d, a, b) for a, b in zip(lo[np.concatenate([[0], cut])].tolist(), hi[np.append(cut - 1, len(hi) - 1)].tolist(), strict=True)]
    none = np.zeros(0, np.int64)
    return np.concatenate([*who, none]), np.concatenate([*where, none]), np.concatenate([*what, none.astype(np.uint64)]), regions


def _shard_repeats(parts: int):
    def work(group: pa.Table, flags: pa.Table) -> pa.Table:
        """Repeats within the shard (kind 0, for the shard), and surroundings of shared anchors (kind 1, for their buckets)."""
        if not group.num_rows or not flags.num_rows:
            return _moves([])
        texts, shard = _texts(_in_order(group)), group.column("shard")[0].as_py()
        lists = [(k, np.frombuffer(p, dtype=np.uint64)) for k, p in zip(flags.column("kind").to_pylist(), flags.column("payload").to_pylist(), strict=True)]
        flagged = np.unique(np.concatenate([x for _, x in lists]))
        across, hot = (np.unique(np.concatenate([*(x for k, x in lists if k == kind), np.zeros(0, np.uint64)])) for kind in (1, 2))
        who, where, what, regions = _candidates(texts, flagged)
        if not regions:
            return _moves([])
        sizes = np.array([b - a for _, a, b in regions])
        data = np.concatenate([texts[d][a:b] for d, a, b in regions])
        opens = np.cumsum(sizes) - sizes
        ends = np.repeat(opens + sizes, sizes)
        # places stand in order of text and start, so a group's first is its earliest
        places, lengths = kasai(data, ends, *refine(data, ends))
        again = np.zeros(len(data), dtype=bool)
        again[places[lengths >= WINDOW]] = True
        rows = []
        for k in np.flatnonzero(np.add.reduceat(again, opens) > 0).tolist():
            d, a, b = regions[k]
            found = runs(np.flatnonzero(again[opens[k] : opens[k] + sizes[k]]) + a)
            rows.append(np.concatenate([np.full((len(found), 1), d), found], axis=1))
        out = [(shard, 0, shard, np.concatenate(rows).astype("<i8").tobytes())] if rows else []
        if len(across):
            at = np.minimum(np.searchsorted(across, what), len(across) - 1)
            hit = across[at] == what
            out += _surroundings(texts, who[hit], where[hit], what[hit], shard, parts)
        if len(hot):
            out += _hot_windows(texts, who, hot, shard, parts)
        return _moves(out)

    return work


#: A window's hash, text and start, before its WINDOW bytes.
SINGLE = np.dtype([("hash", "<u8"), ("text", "<i8"), ("place", "<i8")])


def _hot_windows(texts: list[np.ndarray], who: np.ndarray, hot: np.ndarray, shard: int, parts: int) -> list[tuple]:
    """Windows whose anchor is hot, the first of equal ones, for the buckets of their own hashes: no bucket gets all that stands around an anchor."""
    heads, bodies = [], []
    for d in np.unique(who).tolist():
        t = texts[d]
        for low in range(0, len(t) - WINDOW + 1, PIECE):
            piece = t[low : low + PIECE + WINDOW - 1]
            least = _slide(gram_hashes(piece), REACH + 1, np.minimum)
            at = np.flatnonzero(hot[np.minimum(np.searchsorted(hot, least), len(hot) - 1)] == least)
            if len(at):
                body = np.lib.stride_tricks.sliding_window_view(piece, WINDOW)[at]
                key = _window_hash(body, 0, WINDOW)
                _, one = np.unique(key, return_index=True)
                one = np.sort(np.concatenate([one, _others(body, key, one)]))
                head = np.zeros(len(one), dtype=SINGLE)
                head["hash"], head["text"], head["place"] = key[one], d, at[one] + low
                heads.append(head)
                bodies.append(body[one])
    if not heads:
        return []
    head, body = np.concatenate(heads), np.concatenate(bodies)
    _, one = np.unique(head["hash"], return_index=True)
    one = np.concatenate([one, _others(body, head["hash"], one)])
    bucket = head["hash"][one] % np.uint64(parts)
    order = np.argsort(bucket, kind="stable")
    one, bucket = one[order], bucket[order]
    cut = np.searchsorted(bucket, np.arange(parts + 1, dtype=np.uint64))
    return [(k, 2, shard, zlib.compress(head[one[cut[k] : cut[k + 1]]].tobytes() + body[one[cut[k] : cut[k + 1]]].tobytes(), 1)) for k in range(parts) if cut[k + 1] > cut[k]]


def _others(body: np.ndarray, key: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Places whose bytes differ from those of the first with their key, if ever."""
    keys = key[one]
    first = one[np.searchsorted(keys, key)]
    return np.flatnonzero((body != body[first]).any(axis=1))


WIDE = GRAM + 2 * REACH
#: An anchor's hash, text, place and the bytes before and after it that exist, then WIDE bytes.
HEAD = np.dtype([("hash", "<u8"), ("text", "<i8"), ("place", "<i8"), ("before", "<i4"), ("after", "<i4")])


def _surroundings(texts: list[np.ndarray], who, where, what, shard: int, parts: int) -> list[tuple]:
    head = np.zeros(len(who), dtype=HEAD)
    body = np.zeros((len(who), WIDE), dtype=np.uint8)
    head["hash"], head["text"], head["place"] = what, who, where
    cuts = np.searchsorted(who, np.arange(len(texts) + 1))
    for d in np.unique(who).tolist():
        lo, hi = cuts[d], cuts[d + 1]
        t, p = texts[d], where[lo:hi]
        padded = np.concatenate([np.zeros(REACH, np.uint8), t, np.zeros(REACH, np.uint8)])
        body[lo:hi] = np.lib.stride_tricks.sliding_window_view(padded, WIDE)[p]
        head["before"][lo:hi] = np.minimum(p, REACH)
        head["after"][lo:hi] = np.minimum(len(t) - GRAM - p, REACH)
    # once for equal surroundings
    keys = (_window_hash(body, 0, WIDE), what, (head["before"] * 1000 + head["after"]).astype(np.uint64))
    order = np.lexsort(keys)
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
    again = np.flatnonzero(~new)
    new[again] = (body[order[again]] != body[order[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))[again]]]).any(axis=1)
    one = order[new]
    head, body = head[one], body[one]
    bucket = head["hash"] % np.uint64(parts)
    order = np.argsort(bucket, kind="stable")
    head, body, bucket = head[order], body[order], bucket[order]
    cut = np.searchsorted(bucket, np.arange(parts + 1, dtype=np.uint64))
    some = [(k, slice(cut[k], cut[k + 1])) for k in range(parts) if cut[k + 1] > cut[k]]
    return [(k, 1, shard, zlib.compress(head[s].tobytes() + body[s].tobytes(), 1)) for k, s in some]


def _window_hash(body: np.ndarray, start: int, size: int) -> np.ndarray:
    up, _, byte = common._powers()
    found = np.empty(len(body), dtype=np.uint64)
    for low in range(0, len(body), 4096):  # eight bytes a byte: few rows at a time
        found[low : low + 4096] = (byte[body[low : low + 4096, start : start + size]] * up[:size]).sum(axis=1, dtype=np.uint64)
    return common.splitmix(found)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats within shards pass; windows around anchors, and single windows of hot ones, that an earlier shard also has become repeats."""
    heads, bodies, shards = [], [], []
    single: list[tuple] = []
    for batch in batches:
        through = []
        for r in batch.to_pylist():
            if r["kind"] == 0:
                through.append((r["shard"], 0, r["shard"], r["payload"]))
            elif r["kind"] == 2:
                raw = zlib.decompress(r["payload"])
                n = len(raw) // (SINGLE.itemsize + WINDOW)
                single.append((np.frombuffer(raw, dtype=SINGLE, count=n), np.frombuffer(raw, dtype=np.uint8, offset=n * SINGLE.itemsize).reshape(n, WINDOW), np.full(n, r["shard"], dtype=np.int64)))
            else:
                raw = zlib.decompress(r["payload"])
                n = len(raw) // (HEAD.itemsize + WIDE)
                heads.append(np.frombuffer(raw, dtype=HEAD, count=n))
                bodies.append(np.frombuffer(raw, dtype=np.uint8, offset=n * HEAD.itemsize).reshape(n, WIDE))
                shards.append(np.full(n, r["shard"], dtype=np.int64))
        yield from _moves(through).to_batches()
    found = []
    if single:
        head, body, shard = (np.concatenate(x) for x in zip(*single, strict=True))
        late = _late(head["hash"], shard, body)
        found.append(np.stack([shard[late], head["text"][late], head["place"][late], head["place"][late]], axis=1))
        del single
    if heads:
        head, body, shard = np.concatenate(heads), np.concatenate(bodies), np.concatenate(shards)
        del heads, bodies, shards
        found.append(_repeats(head, body, shard))  # shard, text, first start, last start
    if not found:
        return
    rows = np.concatenate(found)
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    to, cut = np.unique(rows[:, 0], return_index=True)
    out = [(int(s), 0, int(s), np.ascontiguousarray(x[:, 1:]).astype("<i8").tobytes()) for s, x in zip(to, np.split(rows, cut[1:]), strict=True)] if len(rows) else []
    yield from _moves(out).to_batches()


def _repeats(head: np.ndarray, body: np.ndarray, shard: np.ndarray) -> np.ndarray:
    whole = _window_hash(body, 0, WIDE) ^ common.splitmix((head["before"] * 1000 + head["after"]).astype(np.uint64))
    order = np.lexsort((shard, whole, head["hash"]))
    head, body, shard, whole = head[order], body[order], shard[order], whole[order]
    same = np.zeros(len(head), dtype=bool)  # an earlier shard has all of it
    same[1:] = (head["hash"][1:] == head["hash"][:-1]) & (whole[1:] == whole[:-1]) & (head["before"][1:] == head["before"][:-1]) & (head["after"][1:] == head["after"][:-1])
    at = np.flatnonzero(same)
    same[at] = (body[at] == body[at - 1]).all(axis=1)
    first = head["place"] - head["before"]
    last = head["place"] - REACH + head["after"]
    ok = same & (last >= first)
    out = [np.stack([shard[ok], head["text"][ok], first[ok], last[ok]], axis=1)]
    # what differs somewhere, window by window
    own = np.flatnonzero(~same)
    several = np.zeros(len(own), dtype=bool)
    h = head["hash"][own]
    several[1:] = h[1:] == h[:-1]
    several[:-1] |= several[1:]
    own = own[several]
    for some in _blocks(head["hash"][own], 50_000):
        i = own[some]
        for offset in range(REACH + 1):
            start = head["place"][i] - REACH + offset
            fits = (offset >= REACH - head["before"][i]) & (offset <= head["after"][i])
            j, key = i[fits], _window_hash(body[i[fits]], offset, WINDOW) ^ head["hash"][i[fits]]
            late = _late(key, shard[j], body[j, offset : offset + WINDOW])
            s = start[fits][late]
            out.append(np.stack([shard[j][late], head["text"][j][late], s, s], axis=1))
    return np.concatenate(out)


def _late(key: np.ndarray, shard: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Marks of the windows that an earlier shard has: those with its key are looked up and compared."""
    by = np.lexsort((shard, key))
    keys, one = np.unique(key[by], return_index=True)
    earliest = by[one][np.searchsorted(keys, key)]
    late = shard[earliest] < shard
    at = np.flatnonzero(late)
    late[at] = (window[at] == window[earliest[at]]).all(axis=1)
    for k in np.unique(key[at[~late[at]]]).tolist():  # different windows of one key
        least: dict[bytes, int] = {}
        own = np.flatnonzero(key == k).tolist()
        for i in own:
            least[window[i].tobytes()] = min(int(shard[i]), least.get(window[i].tobytes(), int(shard[i])))
        late[own] = [least[window[i].tobytes()] < shard[i] for i in own]
    return late


def _blocks(keys: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Runs of about size places that don't part equal keys."""
    low = 0
    while low < len(keys):
        high = min(len(keys), low + size)
        while high < len(keys) and keys[high] == keys[high - 1]:
            high += 1
        yield np.arange(low, high)
        low = high


def _remove(group: pa.Table, repeats: pa.Table) -> pa.Table:
    if not group.num_rows:
        return pa.table({n: pa.array([], t) for n, t in zip(NAMES, TYPES, strict=True)})
    group = _in_order(group)
    starts = np.concatenate([np.zeros((0, 3), np.int64), *(np.frombuffer(p, dtype="<i8").reshape(-1, 3) for p in repeats.column("payload").to_pylist())])
    starts = starts[np.lexsort((starts[:, 1], starts[:, 0]))]
    cuts = np.searchsorted(starts[:, 0], np.arange(group.num_rows + 1))
    rows = []
    for d, (doc_id, t) in enumerate(zip(group.column("doc_id").to_pylist(), _texts(group), strict=True)):
        own = starts[cuts[d] : cuts[d + 1]]
        if not len(own):
            rows.append((doc_id, len(t), 0, 0, hashlib.sha256(t).hexdigest(), []))
            continue
        stop = np.maximum.accumulate(own[:, 2] + WINDOW)
        new = np.flatnonzero(own[1:, 1] > stop[:-1]) + 1
        a, b = own[np.concatenate([[0], new]), 1], stop[np.append(new - 1, len(stop) - 1)]
        sha, at = hashlib.sha256(), 0
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            sha.update(t[at:x])
            at = y
        sha.update(t[at:])
        rows.append((doc_id, len(t), int((b - a).sum()), len(a), sha.hexdigest(), [{"start": x, "stop": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)]))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=NAMES)


NAMES = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
TYPES = [*[pa.int64()] * 4, pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]


def remove_repeats(docs: DataFrame, shard_bytes: int = SHARD_BYTES, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed, in bytes)."""
    spark = docs.sparkSession
    parts = common.partitions(spark)
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))
    total = own.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).alias("n")).first()["n"]
    cuts = common.id_blocks(own.select("doc_id", F.octet_length("data").cast("long").alias("n")), max(parts, -(-total // shard_bytes)))
    texts = own.withColumn("shard", common.shard_of(F.col("doc_id"), cuts))
    hashes = texts.groupBy("shard").applyInArrow(_send_anchors(parts), MOVE)
    flags = hashes.repartition(parts, "target").mapInArrow(lambda batches: _flag(batches, hot), MOVE)
    wide = 2 * parts  # a task holds what its bucket gets
    found = texts.groupBy("shard").cogroup(flags.groupBy("shard")).applyInArrow(_shard_repeats(wide), MOVE)
    merged = found.withColumn("target", F.pmod("target", F.lit(wide))).repartition(wide, "target").mapInArrow(_merge, MOVE)
    out = texts.groupBy("shard").cogroup(merged.groupBy("shard")).applyInArrow(_remove, SCHEMA)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def oracle() -> str:
    """DuckDB SQL for doc_id, n_bytes, n_removed, n_spans, kept_sha256: every window of every text, by its bytes in hexadecimal."""
    return f"""
WITH docs AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, encode(coalesce(text, ''))) AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
starts AS (SELECT r, unnest(range(0, length(x) // 2 - {WINDOW - 1})) AS s FROM docs),
windows AS (SELECT r, s, substr(x, 2 * s + 1, {2 * WINDOW}) AS w FROM starts JOIN docs USING (r)),
several AS (SELECT w, min(struct_pack(r := r, s := s)) AS first FROM windows GROUP BY w HAVING count(*) > 1),
again AS (SELECT r, s FROM windows JOIN several USING (w) WHERE struct_pack(r := r, s := s) <> first),
opened AS (SELECT r, s, CASE WHEN s <= lag(s) OVER (PARTITION BY r ORDER BY s) + {WINDOW} THEN 0 ELSE 1 END AS new FROM again),
numbered AS (SELECT r, s, sum(new) OVER (PARTITION BY r ORDER BY s) AS k FROM opened),
spans AS (SELECT r, min(s) AS a, max(s) + {WINDOW} AS b FROM numbered GROUP BY r, k),
pieces AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM spans),
cut AS (
  SELECT r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept
  FROM pieces JOIN docs USING (r) GROUP BY r)
SELECT doc_id, length(x)::BIGINT // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM docs LEFT JOIN cut USING (r)
"""

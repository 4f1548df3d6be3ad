"""Text operators against brute force on small tables, with nulls, empty texts, ties and repeated rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import common, decontaminate, fingerprint, language, licenses, mixing, ngram_join, perplexity, sharding, suffixes, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, block int"  # two clashing names


def make(spark, rows):
    """rows of (doc_id, text, lang, source), dealt over several partitions."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "x", 7) for i, t, lang, s in rows], DOCS).repartition(3)


def words(rng, n, pool=400):
    return " ".join(f"w{x}" for x in rng.integers(0, pool, n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(7)
    texts = ["\n".join(words(rng, int(rng.integers(5, 30))) for _ in range(int(rng.integers(1, 6)))) for _ in range(40)]
    texts += texts[:4] + [t + " tail words added" for t in texts[4:8]] + ["", None, "   ", "one", "é" * 150 + " " + "é" * 150, "\n\n", texts[0], "a" * 500]
    rows = [(i, t, ("en", "fr", None)[i % 3], (None, "b", "a", "hot", "hot")[i % 5]) for i, t in enumerate(texts)]
    rows += [rows[3], (5, "another text for id five", "en", "a"), (None, texts[2], "en", "b")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return make(spark, corpus).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def in_order(rows):
    return sorted(((i if i is not None else -(1 << 63)), t or "") for i, t, *_ in rows)


# fingerprints -------------------------------------------------------------------------------------------


def test_fingerprints(docs, corpus, empty):
    rows = in_order(corpus)
    found = sorted((r["doc_id"] if r["doc_id"] is not None else -(1 << 63), r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in fingerprint.fingerprints(docs).collect())
    expected = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        a, b, c = (fingerprint.fingerprint(x) for x in (t, edited, after))
        expected.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprint.pack(a), fingerprint.pack(b), fingerprint.likeness(a, b), fingerprint.likeness(a, c)))
    assert found == sorted(expected)
    assert fingerprint.fingerprints(empty).count() == 0


def test_fingerprint_algebra():
    a, b, c = "first line here", "second line", "third and last"
    whole = fingerprint.fingerprint(f"{a}\n{b}\n{c}")
    assert fingerprint.pack(whole) == fingerprint.pack(fingerprint.fingerprint(f"{c}\n{a}\n{b}"))
    assert fingerprint.pack(fingerprint.delete(whole, fingerprint.vector(b))) == fingerprint.pack(fingerprint.fingerprint(f"{a}\n{c}"))
    assert fingerprint.pack(fingerprint.insert(fingerprint.fingerprint(a), fingerprint.vector(b))) == fingerprint.pack(fingerprint.fingerprint(f"{b}\n{a}"))
    x = fingerprint.unpack(fingerprint.pack(whole))
    assert fingerprint.likeness(x, whole) == 1.0
    long = " ".join(f"v{i}" for i in range(120_000))
    assert fingerprint.likeness(fingerprint.fingerprint(long), fingerprint.fingerprint(long + " more")) > 0.9


def test_likeness_is_that_of_the_packed_fingerprints():
    """Also where a lane passes its 16 bits."""
    a, b = fingerprint.fingerprint("same three words " * 40_000), fingerprint.fingerprint("same three words " * 20_000 + "others here too " * 30_000)
    assert np.abs(a[1]).max() > 0x8000
    x, y = (fingerprint.unpack(fingerprint.pack(v)) for v in (a, b))
    assert fingerprint.likeness(a, b) == fingerprint.likeness(x, y) and fingerprint.likeness(a, x) == 1.0


def test_one_document_follows_itself(spark):
    r = fingerprint.fingerprints(make(spark, [(1, "only one text", "en", "a")])).first()
    assert r["near_next"] == 1.0


# mixing ---------------------------------------------------------------------------------------------------


def targets_by_hand(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest, share = total - 3 * sum(sizes[s] for s in full), sum(w for s, w in weight.items() if s not in full)
        more = {s for s in order if s not in full and weight[s] * rest > 3 * sizes[s] * share}
        if not more:
            return {s: 3 * sizes[s] if s in full else weight[s] * rest / share for s in order}
        full |= more


def test_mixing(docs, corpus, empty):
    found = mixing.mix(docs).collect()
    sizes = defaultdict(int)
    for _, t, _, s in corpus:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    aims = targets_by_hand(sizes)
    taken = defaultdict(int)
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(aims[r["source"]])
        assert r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    assert len(found) == len(corpus)
    for s, aim in aims.items():  # documents here have up to a third of a source's target
        assert abs(taken[s] - aim) <= max(0.05 * aim, max(r["size"] for r in found if r["source"] == s))
    again = mixing.mix(docs.repartition(5)).collect()
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in found) == Counter((r["doc_id"], r["size"], r["taken"]) for r in again)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in found)
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_sources_come_near_their_targets(spark):
    """Within 5 %; where one document has more than 5 % of a target, within what documents of that kind leave open."""
    rng = np.random.default_rng(12)
    rows, i = [], 0
    for s, n, long in (("even", 400, 0), ("one long", 60, 1), ("some long", 150, 6), ("all long", 9, 9), ("tiny", 40, 0), ("alone", 1, 1), (None, 80, 2)):
        for k in range(n):
            size = int(rng.integers(3_000, 6_000)) if k < long else int(rng.lognormal(5, 0.8)) + 1
            rows.append((i := i + 1, "w " * (size if s != "tiny" else 3), "en", s))
    found = mixing.mix(make(spark, rows)).collect()
    held = defaultdict(list)
    for r in found:
        held[r["source"]].append(r)
    for s, some in held.items():
        aim, taken = some[0]["target"], sum(r["taken"] for r in some)
        # what a stratum misses, the smaller documents make good as far as they can
        missed = taken - aim
        for share in mixing.LARGE:
            small = [r for r in some if r["size"] <= share * aim]
            had = taken - sum(r["taken"] for r in small)
            open_ = max(0.0, had - aim, aim - had - mixing.MOST * sum(r["size"] for r in small))
            assert abs(missed) <= open_ + 1.5 * share * aim + 1
        if max(r["size"] for r in some) <= 0.05 * aim:
            assert abs(missed) <= 0.05 * aim
        assert all(r["taken"] <= mixing.MOST * r["size"] for r in some)
    assert {s for s in held if abs(sum(r["taken"] for r in held[s]) - held[s][0]["target"]) <= 0.05 * held[s][0]["target"]} >= {"even", "one long", "some long", "tiny", None}


def test_given_sources_come_near_their_targets(spark):
    rows = mixing.mix(common.table(spark, "/root/testdata/sf0.01", "documents")).groupBy("source", "target").agg(F.sum("taken").alias("taken")).collect()
    assert len(rows) > 5 and all(abs(r["taken"] - r["target"]) <= 0.05 * r["target"] for r in rows), [(r["source"], r["taken"] / r["target"]) for r in rows]


def test_rows_that_differ_elsewhere(spark):
    """Of rows with equal id, source and text one stands for all, the same on any partitioning."""
    df = spark.createDataFrame([(1, "a b c", f"lang{i}", "s", i) for i in range(40)] + [(2, "x " * 300, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    once, again = (Counter(map(tuple, mixing.mixed(df.repartition(k)).collect())) for k in (2, 7))
    assert once == again and len({r for r in once if r[0] == 1}) <= 1


def test_mix_keeps_columns_of_any_name(spark, corpus):
    docs = make(spark, corpus).withColumns({c: F.lit(5) for c in ("_id", "_copies", "copies", "key", "copy", "text_hash", "source_key", "rank")})
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.filter("_id <> 5 OR copies <> 5 OR rank <> 5").count() == 0
    assert out.count() == sum(r["copies"] for r in mixing.mix(docs).collect())


def test_sources_are_ranked_by_code_point(spark):
    names = [None, "", "B", "a", "é", "z", "\U00010000", "\uff00", *(f"s{i}" for i in range(50))]
    rows = mixing.ranked_sources(spark.createDataFrame([(n, 1) for n in names], "source string, source_size long").repartition(4)).collect()
    assert [r["source"] for r in sorted(rows, key=lambda r: r["rank"])] == [*sorted(n for n in names if n is not None), None]


def test_targets_share_the_excess(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, "d": 3, None: 20}
    rows = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    assert {r["source"]: r["target"] for r in rows} == pytest.approx(targets_by_hand(sizes))


@pytest.mark.parametrize("scale", [40_000_000, 40_000_000_000_000])
def test_targets_of_billions_of_words(spark, scale):
    """Weight times the words of all sources is more than 32 bits hold."""
    sizes = {"a": 10 * scale, "b": 20 * scale, "c": 15 * scale, "d": scale, None: 2 * scale}
    rows = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    assert {r["source"]: r["target"] for r in rows} == pytest.approx(targets_by_hand(sizes), rel=1e-12)


# n-gram join ----------------------------------------------------------------------------------------------


def sets_by_hand(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components_by_hand(rows):
    sets = [sets_by_hand(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def joined(df):
    low = -(1 << 63)
    return sorted((r["doc_id"] if r["doc_id"] is not None else low, r["n_shingles"], r["component_id"] if r["component_id"] is not None else low) for r in ngram_join.jaccard_components(df).collect())


def test_join(docs, corpus, empty):
    assert joined(docs) == components_by_hand(in_order(corpus))
    assert ngram_join.jaccard_components(empty).count() == 0


def crowds(rng):
    """A chain of edits (neighbours are linked, ends aren't), documents around a passage, near copies and pairs just above and below the limit."""
    base = words(rng, 60, 10_000).split()
    rows = []
    for i in range(40):
        rows.append((i, " ".join(base), "en", "a"))
        base[int(rng.integers(0, 60))] = f"n{i}"
    passage = words(rng, 20, 10_000)
    rows += [(100 + i, passage + " " + words(rng, int(rng.integers(3, 30)), 10_000), "en", "b") for i in range(40)]
    copied = words(rng, 80, 10_000).split()
    for i in range(40):
        edited = list(copied)
        for k in rng.integers(0, 80, int(rng.integers(0, 6))):
            edited[k] = f"e{i}"
        rows.append((200 + i, " ".join(edited), "en", "c"))
    return rows


@pytest.mark.parametrize(("small", "large", "nearest"), [(8, 6, 1), (8, 1000, 2), (1000, 1000, 1)])
def test_join_of_large_regions(spark, monkeypatch, small, large, nearest):
    """Small limits, so that regions begin with pivots, are dealt by blocks and come again."""
    for name, value in (("SMALL", small), ("LARGE", large), ("NEAREST", nearest), ("MORE", 2)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = crowds(np.random.default_rng(11))
    assert joined(make(spark, rows)) == components_by_hand(in_order(rows))


def test_all_links(spark):
    rows = crowds(np.random.default_rng(12))
    rows += [(300, rows[0][1], "en", "a"), (301, None, "en", "a")]
    links, members = ngram_join.jaccard_links(make(spark, rows))
    of = {r["doc_id"]: r["class"] for r in members.collect()}
    sets = {i: set(ngram_join.shingle_set(t).tolist()) for i, t, *_ in rows}
    expected = {tuple(sorted((of[i], of[j]))) for i in sets for j in sets if i < j and sets[i] and sets[i] != sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert of[301] is None and of[300] == of[0] and len(of) == len(rows) and expected
    assert {tuple(sorted((r["a"], r["b"]))) for r in links.collect()} == expected


def test_cells(monkeypatch):
    monkeypatch.setattr(ngram_join, "DIRECT", 40)
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 62, (12, 8))
    s = centres[rng.integers(0, 12, 300)] ^ (1 << rng.integers(0, 62, (300, 8)))
    s = s.astype(np.uint64)
    reach = rng.integers(5, 250, 300)
    ix, iy = np.arange(0, 300), np.arange(0, 300, 2)
    found = [(i, j, d) for a, b, c in ngram_join._cells(s, s, reach, ix, iy) for i, j, d in zip(a.tolist(), b.tolist(), c.tolist(), strict=True)]
    d = [[sum((int(x) ^ int(y)).bit_count() for x, y in zip(a, b, strict=True)) for b in s] for a in s]
    expected = {(i, j, d[i][j]) for i in ix.tolist() for j in iy.tolist() if d[i][j] <= reach[j]}
    assert len(found) == len(set(found)) and set(found) == expected


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(4)
    for n, m in ((10, 10), (490, 520), (1900, 2100), (7900, 8100), (20, 9000)):
        x, y = (np.unique(rng.integers(0, 1 << 62, k, dtype=np.int64)).astype(np.uint64) for k in (n, m))
        y = np.union1d(x[: len(x) // 2], y)
        for z in (x, y, x[1:], x[:-3]):
            a, b = ngram_join.sketch(x), ngram_join.sketch(z)
            d = np.bitwise_count(ngram_join.folded(a) ^ ngram_join.folded(b)).sum()
            assert d <= ngram_join.finer(np.array([d]), [a], [b])[0] <= len(np.setxor1d(x, z))
            assert len(z) != len(x) or (d == 0) == (z is x)


def test_components_by_links(spark):
    rng = np.random.default_rng(6)
    edges = [(i + 1, i) for i in range(40)] + [(1000 + i, 500) for i in range(50)] + [tuple(int(x) for x in rng.integers(2000, 2100, 2)) for _ in range(60)] + [(3000, 3000 - i) for i in range(1, 30)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    found = ngram_join.components(spark.createDataFrame([e for e in edges if e[0] != e[1]], "a long, b long").repartition(5))
    assert {(r["a"], r["b"]) for r in found.collect()} == {(x, root(x)) for x in parent if root(x) != x}


def test_one_of_each(docs, corpus):
    docs = docs.withColumns({c: F.lit(1) for c in ("key", "sig", "text_hash", "_id", "_copies")})
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    roots = {(d, c) for d, _, c in components_by_hand(in_order(corpus)) if d == c}
    assert {r["doc_id"] if r["doc_id"] is not None else -(1 << 63) for r in kept.collect()} == {d for d, _ in roots}


def test_near_duplicates_again_and_again(spark, docs):
    for _ in range(10):
        kept = ngram_join.one_of_each(docs).count()
    assert kept and not spark.sparkContext.statusTracker().getActiveStageIds()


# sharding ----------------------------------------------------------------------------------------------------


def cut_as_promised(found, n_shards):
    """Groups (size and crc32 name them here) whole, slots gapless, shards along the curve, loads up to one level."""
    by, load, shard_of, group = defaultdict(list), Counter(), defaultdict(set), Counter()
    for r in found:
        by[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
        shard_of[r["size"], r["text_crc32"]].add(r["shard"])
        group[r["size"], r["text_crc32"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(n_shards))
    assert all(len(s) == 1 for s in shard_of.values())
    total, n = sum(load.values()), len(found)
    rows = Counter((r["size"], r["text_crc32"]) for r in found)
    small = {g for g in group if group[g] <= sharding.GROUP_SHARE * total / n_shards and rows[g] <= sharding.GROUP_SHARE * n / n_shards}
    loads, level = sorted(load[i] for i in range(n_shards)), 0
    rest = sum(group[g] for g in small)
    slack = max([group[g] for g in small], default=0) + 1
    free = sorted(load[i] - sum(group[g] for g in small if shard_of[g] == {i}) for i in range(n_shards))
    for k in range(1, n_shards + 1):
        level = (rest + sum(free[:k])) / k
        if k == n_shards or level <= free[k]:
            break
    assert all(max(level, f) - slack <= x <= max(level, f) + slack for x, f in zip(loads, sorted(max(level, f) for f in free), strict=True))
    ends = {}
    for r in found:
        if (g := (r["size"], r["text_crc32"])) in small:
            lo, hi = ends.get(r["shard"], (r["place"], r["place"]))
            ends[r["shard"]] = (min(lo, r["place"]), max(hi, r["place"]))
    runs = [ends[s] for s in sorted(ends)]
    assert all(a[1] <= b[0] for a, b in zip(runs, runs[1:], strict=False))


def test_shards(docs, corpus, empty):
    found = sharding.shards(docs, 4).collect()
    assert len(found) == len(corpus)
    cut_as_promised(found, 4)
    expected = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in corpus)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == expected
    assert sharding.shards(empty).count() == 0


@pytest.mark.parametrize("of", ["copies", "long"])
def test_groups_stay_whole(spark, of):
    """One text, often or very long, makes up more than half of all bytes."""
    rng = np.random.default_rng(5)
    texts = [words(rng, 40) for _ in range(500)]
    rows = [(i, t, ("en", "de", None)[i % 3], f"https://www.example.org/{i % 7}") for i, t in enumerate(texts)]
    rows += [(1000 + i, texts[0], "en", "hot") for i in range(700)] if of == "copies" else [(1000, words(rng, 40_000), "en", "hot")]
    rows += [(3000 + i, "", "en", "hot") for i in range(90)]
    found = sharding.shards(make(spark, rows)).collect()
    assert len(found) == len(rows) and max(Counter(r["shard"] for r in found).values()) >= 700 * (of == "copies")
    cut_as_promised(found, sharding.SHARDS)


def test_whole_values_are_ranked(spark):
    """Sources that share a long beginning take different steps, in their order."""
    values = [f"https://www.example.org/{i:02d}" for i in range(40)] + [None]
    df = spark.createDataFrame([(v,) for v in values for _ in range(5)], "source string")
    cuts = sharding.steps_of(df, "source", 205)
    steps = [r["s"] for r in df.distinct().orderBy("source").select(sharding.step_at(F.col("source"), cuts).alias("s")).collect()]
    assert steps == sorted(steps) and len(set(steps)) >= 28 and max(steps) < 32


def test_hilbert_steps():
    import itertools

    p = np.array(list(itertools.product(range(8), repeat=3)))
    h = sharding.hilbert(p, 3)
    assert sorted(h) == list(range(512)) and (np.abs(np.diff(p[np.argsort(h)], axis=0)).sum(axis=1) == 1).all()


# suffixes --------------------------------------------------------------------------------------------------------


def removed_by_hand(rows):
    seen, out = set(), []
    for i, t in rows:
        b = t.encode()
        gone = np.zeros(len(b) + 1, dtype=bool)
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = True
            seen.add(w)
        edge = np.diff(np.concatenate([[False], gone]).astype(int))
        out.append((i, len(b), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=False) if not g)).hexdigest()))
    return sorted(out)


def test_suffixes(docs, corpus, empty, monkeypatch):
    low = -(1 << 63)
    found = sorted((r["doc_id"] if r["doc_id"] is not None else low, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.remove_repeats(docs).collect())
    assert found == removed_by_hand(in_order(corpus))
    assert suffixes.remove_repeats(empty).count() == 0


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(3)
    piece = rng.integers(97, 100, 150).astype(np.uint8)
    long = rng.integers(97, 99, 400).astype(np.uint8)
    texts = [np.concatenate([piece, long, piece]), piece[20:130], np.full(300, 97, np.uint8), np.concatenate([long[:250], piece[:70], long[:99]]), piece[:99]]
    data = np.concatenate(texts)
    ends = np.repeat(np.cumsum([len(t) for t in texts]), [len(t) for t in texts])
    suffix, tied = suffixes.refine(data, ends)
    strings = {i: data[i : i + 100].tobytes() for i in range(len(data)) if i + 100 <= ends[i]}
    halves = Counter(s[:64] for s in strings.values())
    assert suffix.tolist() == sorted((i for i, s in strings.items() if halves[s[:64]] > 1), key=lambda i: (strings[i], i))
    assert all(t == (k > 0 and strings[i][:64] == strings[suffix[k - 1]][:64]) for k, (i, t) in enumerate(zip(suffix.tolist(), tied.tolist(), strict=True)))
    before = dict(zip(suffix[1:].tolist(), suffix[:-1].tolist(), strict=True))
    places, lengths = suffixes.kasai(data, ends, suffix, tied)
    assert sorted(places.tolist()) == places.tolist() == sorted(suffix[tied].tolist()) and len(places) > 300
    for i, n in zip(places.tolist(), lengths.tolist(), strict=True):
        j, true = before[i], 0
        while i + true < ends[i] and j + true < ends[j] and data[i + true] == data[j + true]:
            true += 1
        assert min(n, 100) == min(true, 100)


def test_windows_of_one_key_are_compared():
    window = np.array([[1, 1], [2, 2], [2, 2], [1, 1], [3, 3], [2, 2]], np.uint8)
    key, shard = np.array([7, 7, 7, 7, 7, 8], np.uint64), np.array([0, 0, 1, 2, 3, 4])
    assert suffixes._late(key, shard, window).tolist() == [False, False, True, True, False, False]


@pytest.mark.parametrize("hot", [suffixes.HOT, 2])
def test_suffixes_over_many_shards(spark, hot):
    """Small shards: repeats within and across them, in documents of many lengths, with colliding keys; also with nearly all anchors hot."""
    rng = np.random.default_rng(8)
    passages = [words(rng, 40, 5000) for _ in range(5)]
    rows = []
    for i in range(60):
        t = words(rng, int(rng.integers(0, 60)), 5000) + " " + passages[int(rng.integers(0, 5))][int(rng.integers(0, 60)) :] * int(rng.integers(0, 3)) + words(rng, int(rng.integers(0, 30)), 5000)
        rows.append((i, t, "en", "a"))
    found = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.remove_repeats(make(spark, rows), 1500, hot).collect())
    assert found == removed_by_hand(in_order(rows)) and sum(r[2] > 0 for r in found) > 20


def test_a_line_that_stands_everywhere(spark):
    """Every document has the same line of dashes: its windows are dealt by their own hashes, whatever stands around it."""
    rng = np.random.default_rng(18)
    rows = [(i, words(rng, 40, 90_000) + "\n" + "-" * 120 + "\n" + words(rng, 30, 90_000), "en", "a") for i in range(240)]
    df = make(spark, rows)
    found = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.remove_repeats(df, 3000, 40).collect())
    assert found == removed_by_hand(in_order(rows)) and sum(r[2] > 0 for r in found) > 230
    texts = [np.frombuffer(t.encode(), np.uint8) for _, t, *_ in rows]
    who, where, what, _ = suffixes._candidates(texts, np.unique(np.concatenate([suffixes.anchors(t)[1] for t in texts])))
    h, n = np.unique(what, return_counts=True)
    dashes = h[n >= len(rows)]
    spread = Counter(k for k, kind, _, p in suffixes._hot_windows(texts, who, dashes, 0, 16) for _ in range(len(suffixes.zlib.decompress(p)) // (suffixes.SINGLE.itemsize + suffixes.WINDOW)))
    assert len(dashes) and len(spread) == 16 and max(spread.values()) < 1.5 * min(spread.values())


def test_many_cuts_cost_little(spark):
    import time

    began = time.time()
    column = common.shard_of(F.col("id"), np.arange(0, 1_000_000, 10))
    df = spark.range(0, 1_000_000, 99_999).select("id", column.alias("k"))
    assert time.time() - began < 1 and all(r["k"] == r["id"] // 10 + 1 for r in df.collect())
    began = time.time()
    assert len(common._put_together(np.ones(1_600_000), 16.5)) == 99_999 and time.time() - began < 5


# licenses ------------------------------------------------------------------------------------------------------------


def test_licenses(spark, empty):
    mit = dict(licenses.TEMPLATES)["mit-text"].replace("<<opt>>the software<<end>>", "(the Software)").replace("<<opt>>including the next paragraph<<end>>", "")
    rows = [
        (1, "Released under the MIT License.\nUnder the MIT-License!", "en", "a"), (2, mit.upper(), "en", "a"), (3, "cc by nc", "en", "a"), (4, "CC BY NC CC-BY-NC", "en", "a"),
        (5, None, "en", "a"), (6, "", "en", "a"), (7, "licensed under the GNU General Public License, as published by the Free Software Foundation; either version 3", "en", "a"),
        (8, "licensed under the GNU General Public License either version 3", "en", "a"),
    ]
    found = {r["doc_id"]: r for r in licenses.licenses(make(spark, rows)).collect()}
    assert (found[1]["n_base"], found[1]["first_word"], found[1]["last_word"], found[1]["labels"]) == (2, 1, 5, "mit,mit-notice")
    assert found[2]["labels"] == "mit-text" and found[2]["base_labels"] == "" and found[2]["score"] > 0.98
    assert found[3]["n_base"] == 0 and found[3]["n_words"] == 2
    assert (found[4]["n_base"], found[4]["first_word"], found[4]["last_word"]) == (2, 0, 3)
    assert found[5]["n_words"] == found[6]["n_words"] == 0 and found[5]["first_word"] is None and found[5]["score"] == 0
    assert found[7]["labels"] == "gpl-3" and found[8]["labels"] == ""
    assert licenses.licenses(empty).count() == 0


def test_automata_and_patterns_agree():
    rng = np.random.default_rng(2)
    markup = "a b <<opt>>c <<opt>>d<<end>><<end>> <<var;2>> e f"
    a, p = licenses.Automaton.build("x", markup), re.compile(licenses.pattern(markup))
    for _ in range(3000):
        w = [b"abcdef"[i : i + 1] for i in rng.integers(0, 6, 10)]
        if rng.random() < 0.5:
            w[:2] = [b"a", b"b"]
        text = " " + " ".join(x.decode() for x in w) + " "
        assert any(a.run(w, i) >= 0 for i in range(len(w))) == bool(p.search(text))


# decontamination ------------------------------------------------------------------------------------------------------------


def test_decontamination(spark, empty):
    rng = np.random.default_rng(9)
    items = [(i, words(rng, 30, 5000)) for i in range(20)] + [(50, None), (51, "!!"), (52, "tiny")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    noise = [words(rng, 80, 5000) for _ in range(40)]
    rows = [(i, t, "en", "a") for i, t in enumerate(noise)]
    edited = items[5][1].split()
    edited[3], edited[20] = "changed", "words"
    rows += [(100, noise[0] + " " + items[3][1].upper() + "!! " + noise[1], "en", "a"), (101, noise[2] + " " + " ".join(edited), "en", "a"), (102, items[7][1][: len(items[7][1]) // 2], "en", "a"), (103, None, "en", "a"), (104, "", "en", "a"), (105, "a tiny, word", "en", "a"), (106, items[1][1] + items[2][1], "en", "a")]
    found = {r["doc_id"]: r["item_ids"] for r in decontaminate.passages(make(spark, rows), bench).collect()}
    assert found[100] == [3] and found[101] == [5] and found[102] == [] and found[103] == found[104] == [] and found[105] == [52] and found[106] == [1, 2]
    assert not any(found[i] for i in range(40))
    assert {r["doc_id"] for r in decontaminate.clean(make(spark, rows), bench).collect()} == {i for i, x in found.items() if not x}
    assert decontaminate.passages(empty, bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.passages(make(spark, rows), bench.limit(0)).collect())


def least_edits(text, passage):
    """Sellers: the least edits between the passage and any part of the text."""
    row = np.zeros(len(text) + 1, dtype=int)
    steps = np.arange(len(text) + 1)
    for j, symbol in enumerate(passage, 1):
        new = np.empty_like(row)
        new[0] = j
        new[1:] = np.minimum(row[:-1] + (text != symbol), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    return row.min()


@pytest.mark.parametrize("piece", [300, 1 << 20])
def test_whole_texts_against_brute_force(spark, monkeypatch, piece):
    """Passages with edits around their budgets, spread by long rules, in long and short texts, in small pieces and large."""
    monkeypatch.setattr(decontaminate, "PIECE", piece)
    rng = np.random.default_rng(21)
    items = [words(rng, int(rng.integers(4, 40)), 300) for _ in range(12)]

    def edited(t, n):
        t = list(t)
        for _ in range(n):
            k = int(rng.integers(0, len(t)))
            t[k : k + 1] = [[], ["q"], [t[k], "z"]][int(rng.integers(0, 3))]
        return "".join(t)

    texts = [None, "", items[0][:20]]
    for i in range(60):
        t = items[int(rng.integers(0, 12))]
        t = edited(t, int(decontaminate.budget(len(t)) + rng.integers(-3, 3)) if i % 2 else 0) if len(t) > 30 else t
        if i % 3 == 0:
            t = (" " + "-" * 60 + " ").join(t.split())
        texts.append(" ".join([words(rng, int(rng.integers(0, 200)), 300), t, words(rng, int(rng.integers(0, 200)), 300)]))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {r["doc_id"]: r for r in decontaminate.passages(make(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), bench).collect()}
    symbols, passages = [decontaminate.symbols(t or "") for t in texts], [decontaminate.trimmed(decontaminate.symbols(t)) for t in items]
    expected = {d: [k for k, p in enumerate(passages) if least_edits(x, p) <= decontaminate.budget(len(p))] for d, x in enumerate(symbols)}
    assert {d: r["item_ids"] for d, r in found.items()} == expected
    assert sum(map(len, expected.values())) > 40 and sum(not x for x in expected.values()) > 3
    for d, r in found.items():
        for h in r["hits"]:
            p = passages[h["item_id"]]
            assert 0 <= h["start"] < h["stop"] <= len(symbols[d]) and h["edits"] == least_edits(symbols[d][max(0, h["start"] - 8) : h["stop"] + 8], p)


def test_documents_keep_columns_of_any_name(spark):
    docs = make(spark, [(1, "nothing here", "en", "a"), (2, "some words that stand in the benchmark", "en", "a")]).withColumns({"hits": F.lit(1), "_hits": F.lit(2)})
    bench = spark.createDataFrame([(1, "words that stand in the benchmark")], "item_id long, text string")
    out = decontaminate.clean(docs, bench)
    assert out.columns == docs.columns and [r["doc_id"] for r in out.collect()] == [1]


def test_short_texts_beside_a_long_passage():
    rng = np.random.default_rng(3)
    short, long = words(rng, 17, 5000)[:81], words(rng, 250, 5000)[:1000]
    index = decontaminate.Index.build([(1, short), (2, long)])
    for _ in range(20):
        texts = [short if rng.random() < 0.3 else words(rng, int(rng.integers(1, 20)), 5000) for _ in range(200)]
        found = index.search([decontaminate.symbols(t) for t in texts])
        assert {d for d, k, *_ in found if k == 0} == {d for d, t in enumerate(texts) if t == short}
    texts = [long[:500], short, long, short]
    assert {x[:2] for x in index.search([decontaminate.symbols(t) for t in texts])} == {(1, 0), (2, 1), (3, 0)}


def test_alignment_against_brute_force():
    """Parts that stay on the window's diagonals."""
    rng = np.random.default_rng(4)
    for _ in range(200):
        w, p = rng.integers(1, 4, 11).astype(np.uint16), rng.integers(1, 4, 6).astype(np.uint16)
        best = {(0, i): 0 for i in range(6)}
        for j in range(1, 7):
            for i in range(j, j + 6):  # diagonals 0 to 5
                ways = [best[j - 1, i - 1] + (w[i - 1] != p[j - 1])]
                ways += [best[j, i - 1] + 1] if (j, i - 1) in best else []
                ways += [best[j - 1, i] + 1] if (j - 1, i) in best else []
                best[j, i] = min(ways)
        got = decontaminate.aligned(w, p, 6)
        assert got is not None and got[0] == min(best[6, i] for i in range(6, 12)) and best[6, got[2]] == got[0]
        assert 0 <= got[1] <= 5 and distance(w[got[1] : got[2]], p) <= got[0]  # the part that it names


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_a_hit_starts_where_its_passage_does():
    """Also behind letters that are left out, or between those that are put in."""
    rng = np.random.default_rng(14)
    passage = decontaminate.trimmed(decontaminate.symbols(words(rng, 40, 5000)))
    index = decontaminate.Index.build([(1, " ".join(words(rng, 9, 5000).split())), (2, "".join(map(chr, passage)))])
    for _ in range(60):
        p = index.passages[1]
        gone = np.sort(rng.choice(np.arange(20, len(p) - 20), 3, replace=False))
        text = np.delete(p, gone) if rng.random() < 0.5 else np.insert(p, gone, 7)
        before = decontaminate.symbols(words(rng, int(rng.integers(3, 60)), 5000))
        hits = [h for h in index.search([np.concatenate([before, text, before]).astype(np.uint16)]) if h[1] == 1]
        assert len(hits) == 1 and hits[0][4] == 3 and distance(np.concatenate([before, text, before])[hits[0][2] : hits[0][3]], p) == 3


def test_an_index_is_small():
    rng = np.random.default_rng(15)
    items = [(i, words(rng, 60, 90_000)) for i in range(4_000)]
    size = sum(len(t) for _, t in items)
    index = decontaminate.Index.build(items)
    assert size > 1 << 20 and index.nbytes() * decontaminate.INDEX_BYTES / size < 150 << 20
    found = index.search([decontaminate.symbols(f"{words(rng, 20, 90_000)} {items[k][1]} {words(rng, 20, 90_000)}") for k in range(0, 4_000, 400)])
    assert {(d, k) for d, k, *_ in found} >= {(d, k) for d, k in enumerate(range(0, 4_000, 400))}


# learned operators -----------------------------------------------------------------------------------------------------------


def test_language(spark, sf_dir, empty):
    d = common.table(spark, sf_dir, "documents")
    d = d.unionByName(make(spark, [(9001, None, "en", "a"), (9002, "", "en", "a"), (9003, "123 !!", None, "a")]).select(*d.columns))
    found = language.language_ids(d).join(d.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r["held_out"] and r["doc_id"] < 9000]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.9 * len(held)
    assert {r["lang_pred"] for r in found if r["doc_id"] > 9000} == {"und"} and all(0 <= r["score"] <= 1 for r in found)
    assert language.language_ids(empty).count() == 0
    langs, prototypes = language.train(d)
    kept = language.recognised(d, langs, prototypes, 0.0)
    assert kept.columns == d.columns and kept.filter("doc_id > 9000").count() == 0


def test_bundles_add_up():
    a, b = language.bundles(["abcd xyz", None])
    vectors = {"": 0}
    first = language.bind(language.runs("abcd xyz"))
    assert np.array_equal(a, first.sum(axis=0)) and not b.any() and vectors


def test_toxicity(spark, empty):
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for i in range(300):
        t = words(rng, 40)
        if i % 4 == 0:
            t += " " + ("badword " if i % 8 else "B4dw0rd ") * 2 + words(rng, 5)
        rows.append((i, t, "en", "a"))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(1000, None, "en", "a"), (1001, "", "en", "a")]
    l = spark.createDataFrame(labels + [(2, 1, None), (None, 1, 1), (4, 1, 1)], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in toxicity.toxicity(make(spark, rows), l).collect()}
    assert all(found[i]["predicted"] == int(i % 4 == 0) for i in range(300))
    assert found[1000]["score"] == found[1001]["score"] < 0.5 and all(0 <= r["score"] <= 1 for r in found.values())
    assert toxicity.toxicity(empty, l).count() == 0
    assert {r["score"] < 1e-6 for r in toxicity.toxicity(make(spark, rows), l.limit(0)).collect()} == {True}


def test_folding():
    m = toxicity.Model({"idiot ": 3.0, "kill": 2.0, "bad ": 1.0, "ass ": 1.0})
    a = m.automaton()
    score = lambda t: m.found(a, toxicity.fold(t))[0]
    for t in ("you idiot!", "you idiot! in 2024", "1d10t at 5", "IDIOT", "id!ot"):
        assert score(t) == 3, t
    assert score("k!ll b!d") == 2 and score("k!ll b@d 2024") == 3 and score("k1ll") == 2 and score("@ss") == 1
    # numbers, trailing signs and other words are left alone
    assert toxicity.fold("5 $ 100 a1 b2 wow!! 3.5% x|") == "5 $ 100 a1 b2 wow!! 3.5% x|"
    assert toxicity.fold("a" * 200_000) == "a" * 200_000 and toxicity.fold("!" * 50_000) == "!" * 50_000


def test_beginnings_and_whole_words():
    m = toxicity.Model({"bad": 2.0, "bad ": 5.0}, ["bad apple pie", "badge"])
    a = m.automaton()
    score = lambda t: m.found(a, toxicity.fold(t))[0]
    assert score("bad") == 5 and score("badly") == 2 and score("badge") == 0 and score("bad apple") == 5 and score("bad apple pie bad") == 5


def test_learned_exceptions(spark):
    """Words and phrases that begin with an entry and stand in clean documents, whether toxic ones have them or not."""
    rng = np.random.default_rng(16)
    rows, labels = [], []
    for i in range(400):
        t = words(rng, 30)
        if i % 4 == 0:
            t += " vile " + ("vilest " if i % 8 else "")
        elif i % 20 == 1:
            t += (" vileness", " vile weed extract")[i % 40 // 20]
        rows.append((i, t, "en", "a"))
        labels.append((i, 1, int(i % 4 == 0)))
    model = toxicity.train(make(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {"vileness", "vile weed"} <= set(model.exceptions) and "vile" not in model.exceptions
    scored = toxicity.features(make(spark, rows), model, "doc_id").collect()
    assert all((r["score"] >= 0.7) == (r["doc_id"] % 4 == 0) for r in scored)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    found = toxicity.toxicity(common.table(spark, sf, "documents"), common.table(spark, sf, "labels"))
    both = found.filter("held_out").join(common.table(spark, sf, "labels").filter("toxic IS NOT NULL").select("doc_id", "toxic"), "doc_id").collect()
    assert len(both) > 50 and sum(r["predicted"] == r["toxic"] for r in both) >= 0.95 * len(both)


def test_toxicity_against_brute_force(spark):
    """Every text's weight and matches, by trying each entry and exception at each place."""
    model = toxicity.Model({"bad": 2.0, "bad ": 3.5, "badge ": 1.0, "ill": 1.5, "kill": 4.0, "kil": 0.5, "ass ": 2.5}, ["badly", "kill time", "bad hair day", "illness"], [-1.0, 0.4, 0.3, 0.2])
    rng = np.random.default_rng(14)
    parts = ["bad", "badly", "badge", "badges", "kill", "time", "k1ll", "b@d", "hair", "day", "ill", "illness", "ass", "a$s", "class", "x", "9", "!!", "bаd", "KILL", "ki|l", "é"]
    glue = [" ", " ", " ", "  ", "\n", ", ", "-", "_"]
    texts = ["".join(str(rng.choice(parts)) + str(rng.choice(glue)) for _ in range(int(rng.integers(0, 25)))) for _ in range(300)] + [None, ""]

    def by_hand(text):
        t = toxicity.fold(text or "")
        starts = [i for i in range(len(t)) if not (i and t[i - 1].isalpha())]
        ends = lambda i: i == len(t) or not t[i].isalpha()
        gone = {j for i in starts for e in model.exceptions if t.startswith(e, i) and ends(i + len(e)) for j in range(i, i + len(e))}
        total, n = 0.0, 0
        for i in starts:
            fits = [(len(k.rstrip()), w) for k, w in model.entries.items() if t.startswith(k.rstrip(), i) and (k[-1] != " " or ends(i + len(k.rstrip())))]
            if fits and i not in gone:
                total, n = total + max(fits)[1], n + 1
        return round(total, 9), n, len(text or "")

    found = {r["doc_id"]: r for r in toxicity.features(make(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), model, "doc_id").collect()}
    for i, t in enumerate(texts):
        w, n, size = by_hand(t)
        z = -1.0 + 0.4 * np.log1p(w) + 0.3 * np.log1p(1000 * w / (size + 200)) + 0.2 * (n > 0)
        assert (round(found[i]["weight"], 9), found[i]["matches"], found[i]["size"]) == (w, n, size), t
        assert found[i]["score"] == pytest.approx(1 / (1 + np.exp(-z)))
    assert sum(r["matches"] > 2 for r in found.values()) > 100


def test_exceptions_cancel():
    m = toxicity.Model({"bad": 2.0, "fool ": 3.0}, ["bad apple", "badly"])
    a = m.automaton()
    score = lambda t: m.found(a, toxicity.fold(t))[0]
    assert score("a bad thing") == 2 and score("bad apple") == 0 and score("badly done") == 0 and score("badlyx") == 2
    assert score("f00l") == 3 and score("foolish") == 0 and score("unbad") == 0 and score("bаd") == 2


def rates_by_hand(marked):
    """(background, target) shares that match in bytes."""
    sizes = [sum(len(t.encode()) for t, m in marked if m == side) for side in (False, True)]
    return [min(sizes) / x for x in sizes]


def loss_by_hand(pairs, t, size, rate):
    """Mean loss of the words of t behind the first: the model of a share of the text, in expectation."""
    import math

    def kept(n):
        return max(n - perplexity.DISCOUNT, 0) if rate >= 1 else rate * n - perplexity.DISCOUNT * (1 - math.exp(-rate * n))

    before, after, kinds = Counter(), Counter(), Counter()
    for (a, b), n in pairs.items():
        before[a] += n
        after[b] += n
        kinds[a] += 1 if rate >= 1 else 1 - math.exp(-rate * n)
    total, out = sum(after.values()), 0.0
    for a, b in zip(t, t[1:], strict=False):
        uni = (rate * after[b] + 1) / (rate * total + size)
        out -= math.log(kept(pairs[a, b]) / (rate * before[a]) + perplexity.DISCOUNT * kinds[a] / (rate * before[a]) * uni if before[a] else uni)
    return out / (len(t) - 1)


def test_perplexity(spark, empty):
    rng = np.random.default_rng(8)
    rows = [(i, words(rng, 60, 50) if i % 2 else words(rng, 60, 50).replace("w", "v"), "en", "a") for i in range(60)] + [(100, None, "en", "a"), (101, "", "en", "a")]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 60)], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in perplexity.cross_entropy_difference(make(spark, rows), labels).collect()}
    assert all((found[i]["score"] < 0) == bool(i % 2) for i in range(60))
    assert found[100]["n_words"] == 0 and found[100]["score"] == 0
    # by hand
    texts = {i: (t or "").split() for i, t, *_ in rows}
    counts = Counter(w for t in texts.values() for w in t)
    top = set(counts)
    pairs = [Counter(), Counter()]
    for i, t in texts.items():
        for a, b in zip(["<s>", *t], t, strict=False):
            pairs[int(i < 60 and i % 2)][a, b] += 1
    assert len(top) <= perplexity.VOCABULARY
    rates = rates_by_hand([(t or "", i < 60 and i % 2 == 1) for i, t, *_ in rows])

    def loss(side, t):
        return loss_by_hand(pairs[side], ["<s>", *t], perplexity.SIZE, rates[side])

    for i in (0, 1, 17):
        assert found[i]["target_loss"] == pytest.approx(loss(1, texts[i]), rel=1e-4) and found[i]["background_loss"] == pytest.approx(loss(0, texts[i]), rel=1e-4)
    assert perplexity.cross_entropy_difference(empty, labels).count() == 0


def test_perplexity_of_a_large_vocabulary(spark, monkeypatch):
    for name in ("GROUP", "BUCKET"):
        monkeypatch.setattr(perplexity, name, 4000, raising=False)  # several of both
    rng = np.random.default_rng(12)
    rows = [(i, words(rng, int(rng.integers(40, 90)), 3000 if i % 3 else 40), "en", "a") for i in range(90)] + [(None, words(rng, 50, 3000), "en", "a"), (7, words(rng, 50, 3000), "en", "a")]
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(80)] + [(None, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    found = {(r["doc_id"], r["n_words"]): r for r in perplexity.cross_entropy_difference(make(spark, rows), labels).collect()}
    texts = [(i, t.split()) for i, t, *_ in rows]
    vocabulary = {w for _, t in texts for w in t}
    assert len(vocabulary) > 2 * perplexity.VOCABULARY and len(found) == len({(i, len(t)) for i, t in texts})
    pairs = [Counter(), Counter()]
    for i, t in texts:
        pairs[int(i is not None and i < 80 and i % 2 == 0)].update(zip(["<s>", *t], t, strict=False))
    rates = rates_by_hand([(t, i is not None and i < 80 and i % 2 == 0) for i, t, *_ in rows])
    assert min(rates) < 0.95
    for side, column in ((1, "target_loss"), (0, "background_loss")):
        for i, t in texts:
            assert found[i, len(t)][column] == pytest.approx(loss_by_hand(pairs[side], ["<s>", *t], len(vocabulary) + perplexity.UNKNOWN + 1, rates[side]), rel=1e-5)


def test_a_matched_model_is_a_distribution():
    """Over all words, the probabilities after a first word sum to one, whatever the share of the text."""
    n, word = np.array([5, 2, 1, 0]), np.array([9, 4, 2, 1])
    for rate in (1.0, 0.4, 0.01):
        kinds = perplexity.seen(n, rate).sum()
        p = np.exp(-perplexity.losses(n, np.full(4, n.sum()), np.full(4, kinds), word, 16, 4 + 0, rate))
        assert p.sum() == pytest.approx(1.0)


def test_messages_grow_with_the_input():
    rows = {size: np.prod(perplexity.dealing(size)) for size in (0, 1, 10**8, 10**9, 10**10, 10**11, 10**12, 10**13, 10**14)}
    assert rows[0] == rows[1] == 1 and all(n <= 1.3 * size / perplexity.MESSAGE + 2 for size, n in rows.items() if size >= 10**10)
    assert all(rows[10 * s] <= 13 * rows[s] for s in (10**10, 10**11, 10**12, 10**13)) and perplexity.dealing(840_000_000)[0] == -(-840_000_000 // perplexity.GROUP)


def test_blocks_follow_sizes(spark):
    """A run of long texts is cut finer than short ones; ids of one run stay together."""
    rng = np.random.default_rng(2)
    sizes = {i: 5000 if 300 <= i < 340 else int(rng.integers(1, 60)) for i in range(0, 900, 2)}
    df = spark.createDataFrame(list(sizes.items()) + [(10, 7)] * 5, "doc_id long, n long").repartition(3)
    cuts = common.id_blocks(df, 12)
    run = {r["doc_id"]: r["k"] for r in df.select("doc_id", common.shard_of(F.col("doc_id"), cuts).alias("k")).distinct().collect()}
    assert len(run) == len(sizes) and cuts.tolist() == sorted(set(cuts.tolist())) and all(k == sum(c <= i for c in cuts) for i, k in run.items())
    loads = Counter()
    for i, n in sizes.items():
        loads[run[i]] += n
    assert max(loads.values()) <= 4 * 5000 and len(loads) >= 9  # a twelfth is 9,400; by counts alone it would be 100,000
    assert len(common.id_blocks(df.limit(0), 12)) == len(common.id_blocks(df, 1)) == 0


def test_word_hashes_of_long_data(monkeypatch):
    rng = np.random.default_rng(0)
    text = b" ".join(bytes(rng.integers(97, 123, int(n)).astype(np.uint8)) for n in rng.integers(1, 40, 200))
    data = np.frombuffer(text, dtype=np.uint8)
    whole, _ = common.hash_words(data)
    monkeypatch.setattr(common, "PIECE", 256)
    parts, starts = common.hash_words(data)
    assert np.array_equal(whole, parts) and len(starts) == 200
    huge = np.frombuffer(b"x " + b"y" * (common.LONG_WORD + 10) + b" x", dtype=np.uint8)
    h, _ = common.hash_words(huge)
    assert h[0] == h[2] != h[1]


def test_stages_keep_columns(spark, sf_dir):
    import corpus_pipeline

    docs = common.table(spark, sf_dir, "documents").limit(120).withColumn("extra", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        out = common.cut_lineage(stage(spark, docs, sf_dir))
        if name != "sharding":
            assert out.columns == docs.columns
            docs = out
        else:
            assert out.count() == docs.count()

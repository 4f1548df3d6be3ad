"""Every operator and pipeline stage on one odd table, and the whole pipeline against a version by hand."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import common, decontaminate, fingerprint, language, licenses, mixing, ngram_join, perplexity, sharding, suffixes, toxicity

from .test_operators import components_by_hand, cut_as_promised, in_order, least_edits, targets_by_hand, words

#: Names that operators use for columns of their own.
CLASHING = "key sig text_hash size block hits _hits copies copy shard slot place range range_ by_ g n rank name region source_key part counts data target label score short members rep own salt class src bucket position halo _id _text _source _copies _copy sketch weight start".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and blank texts, a very long one, ties and repeated rows, and columns of clashing names."""
    rng = np.random.default_rng(31)
    rows = [(i, words(rng, int(rng.integers(1, 60)), 200), ("en", "fr", None)[i % 3], ("a", "b", None)[i % 3], i) for i in range(20)]
    rows += [(None, None, None, None, None), (None, "", "en", "a", 0), (20, "", None, "a", 0), (21, "  \n\t", "en", "a", 4), (22, "\U0001f600 ß İ ς \u0000 x", "en", "c", 9), (23, words(rng, 200_000, 40_000), "en", "hot", 1_000_000)]
    rows += [rows[3], rows[3], (4, rows[5][1], "en", "a", 1), (24, rows[7][1], "en", "b", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return df.withColumns({c: F.when(F.col("doc_id") % 2 == 0, c) for c in CLASHING}).cache(), rows


def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(15)] + [(None, 1, 1), (16, None, None), (3, 0, 1), (3, 0, 1)], "doc_id long, quality int, toxic int")


def benchmark(spark):
    return spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7"), (None, "words of no item here"), (2, None), (3, ""), (1, "w1 w2 w3 w4 w5 w6 w7")], "item_id long, text string")


OPERATORS = {
    "fingerprint": lambda s, d: fingerprint.fingerprints(d),
    "mixing": lambda s, d: mixing.mix(d),
    "join": lambda s, d: ngram_join.jaccard_components(d),
    "toxicity": lambda s, d: toxicity.toxicity(d, labels(s)),
    "sharding": lambda s, d: sharding.shards(d, keep=("lang", "rank")),
    "language": lambda s, d: language.language_ids(d),
    "suffixes": lambda s, d: suffixes.remove_repeats(d),
    "perplexity": lambda s, d: perplexity.cross_entropy_difference(d, labels(s)),
    "licenses": lambda s, d: licenses.licenses(d),
    "decontamination": lambda s, d: decontaminate.passages(d, benchmark(s)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_on_odd_rows(spark, odd, name):
    docs, rows = odd
    found = OPERATORS[name](spark, docs)
    assert sorted(found.columns) == sorted(set(found.columns))
    got = [r["doc_id"] for r in found.select("doc_id").collect()]
    assert Counter(got) == Counter(r[0] for r in rows)
    assert OPERATORS[name](spark, docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_rows(spark, odd, tmp_path, name):
    docs, rows = odd
    benchmark(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, str(tmp_path))
    kept = out.count()
    if name == corpus_pipeline.STAGES[-1][0]:
        assert kept == len(rows)
    else:
        assert out.columns == docs.columns and 0 < kept <= 3 * len(rows)
        assert out.filter("doc_id % 2 = 0 AND (rank <> 'rank' OR _copies <> '_copies')").count() == 0
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_empty_companions(spark, odd):
    """No labels, no benchmark."""
    docs, rows = odd
    assert toxicity.toxicity(docs, labels(spark).limit(0)).count() == len(rows)
    assert perplexity.cross_entropy_difference(docs, labels(spark).limit(0)).count() == len(rows)
    assert decontaminate.passages(docs, benchmark(spark).limit(0)).filter("contaminated").count() == 0


# the pipeline by hand ------------------------------------------------------------------------------------------------------------


def cosines_by_hand(rows, learned):
    """For each row the cosines with the languages learned from some rows; none for a text without letters."""
    a, b, c = language._vectors()

    def bundle(text):
        out = np.zeros(language.DIM)
        ids, before = [0], 0
        for ch in text.lower():
            x = ord(ch) % language.LETTERS + 1 if ch.isalpha() else 0
            if x or before:
                ids.append(x)
            before = x
        ids += [0] if ids[-1] else []
        for x, y, z in zip(ids, ids[1:], ids[2:], strict=False):
            out += a[x].astype(int) * b[y] * c[z]
        return out

    def unit(v):
        n = np.linalg.norm(v)
        return v / n if n else v

    bundles = {i: bundle(t or "") for i, t, *_ in rows}
    sums = defaultdict(lambda: np.zeros(language.DIM))
    for i, t, lang, _ in learned:
        if lang is not None and t is not None and np.any(bundles[i]):
            sums[lang] += unit(bundles[i])
    prototypes = np.stack([unit(v) for _, v in sorted(sums.items())])
    prototypes = np.stack([unit(v) for v in prototypes - prototypes.mean(axis=0)])
    return {i: dict(zip(sorted(sums), prototypes @ unit(v), strict=True)) if np.any(v) else {} for i, v in bundles.items()}


def languages_by_hand(rows):
    cosines = cosines_by_hand(rows, rows)
    return [r for r in rows if max(cosines[r[0]].values(), default=-1) >= corpus_pipeline.LEAST_COSINE]


def test_languages_by_hand(spark):
    """The query's predictions and scores, learned from the rows that aren't held out."""
    rng = np.random.default_rng(17)
    speak = {"en": "the thing other which weather there strong mother whole", "fr": "quelque jamais toujours beaucoup voix peuple oiseau", "de": "über straße nicht schön zwischen möchte"}
    rows = [(i, " ".join(rng.choice(speak[lang := ("en", "fr", "de")[i % 3]].split(), int(rng.integers(3, 30)))), lang if i % 7 else None, "a") for i in range(80)]
    rows += [(100, None, "en", "a"), (101, "12, 34!", "fr", "a"), (102, "", "de", None), (103, "Ünïcode THE thing", "en", "a"), (104, "the nicht voix", None, None)]
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in rows}
    cosines = cosines_by_hand(rows, [r for r in rows if not held[r[0]]])
    found = {r["doc_id"]: r for r in language.language_ids(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(4)).collect()}
    assert len(found) == len(rows) and 5 < sum(held.values()) < 40
    for i, own in cosines.items():
        best = max(own, key=own.get, default="und")
        assert found[i]["held_out"] == held[i] and found[i]["lang_pred"] == best
        assert abs(found[i]["score"] - min(1.0, max(0.0, own.get(best, 0.0)))) < 1e-4


def mixed_by_hand(rows):
    def number(text):
        return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)

    size = {r[0]: len((r[1] or "").split()) for r in rows}
    total = defaultdict(int)
    for r in rows:
        total[r[3]] += size[r[0]]
    aims, salts, out = targets_by_hand(total), 1 + len(rows) // mixing.SALT_ROWS, []
    for s in total:
        def place(r):
            n = size[r[0]]
            bits = n.bit_length()
            return (bits * 8 + n * 8 // (1 << (bits - 1)) - 8 if n else 0), number(str(r[0])) % salts, n, r[0]

        jitter = number(f"{mixing.SEED}|{s}|" if s is not None else f"{mixing.SEED}||null") / float(1 << 32)
        some = sorted((r for r in rows if r[3] == s), key=place)
        most = defaultdict(int)
        for r in some:
            most[place(r)[0]] = max(most[place(r)[0]], size[r[0]])
        had = done = 0
        for stratum in range(len(mixing.LARGE) + 1):
            own = [r for r in some if sum(most[place(r)[0]] <= x * aims[s] for x in mixing.LARGE) == stratum]
            rate = max(0.0, min(float(mixing.MOST), (aims[s] - had) / (total[s] - done))) if total[s] > done else 0.0
            for k, r in enumerate(own, 1):
                n = min(mixing.MOST, math.floor(jitter + k * rate) - math.floor(jitter + (k - 1) * rate))
                out += [r] * n
                had += n * size[r[0]]
            done += sum(size[r[0]] for r in own)
    return out


def test_pipeline_by_hand(spark, tmp_path):
    rng = np.random.default_rng(41)
    english, french = ([f"{p}{x}" for x in rng.integers(0, 900, 300)] for p in ("the", "que"))
    speak = {"en": ["thing", "other", "which", "weather", "there", "strong", "mother", "whole"], "fr": ["quelque", "jamais", "toujours", "beaucoup", "voix", "peuple", "oiseau", "chemin"]}

    def text(lang, n):
        extra = english if lang == "en" else french
        return " ".join(str(rng.choice(speak[lang])) if rng.random() < 0.5 else str(rng.choice(extra)) for _ in range(n))

    rows = [(i, text(("en", "fr")[i % 2], int(rng.integers(8, 90))), ("en", "fr")[i % 2], ("a", "b", "c", None)[i % 4]) for i in range(90)]
    rows += [(100 + i, rows[i][1], rows[i][2], "b") for i in range(8)]  # copies
    for i in range(8, 20):  # near copies
        w = rows[i][1].split()
        w[len(w) // 2] = "changed"
        rows.append((100 + i, " ".join(w), rows[i][2], "c"))
    items = [(k, text("en", 14)) for k in range(5)]
    rows += [(200 + k, text("en", 20) + " " + items[k % 5][1].upper() + ", " + text("en", 9), "en", "a") for k in range(9)]
    rows += [(300, None, "en", "a"), (301, "", None, "a"), (302, "12 34 -- 56", "en", "b")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = languages_by_hand(rows)
    assert {r[0] for r in rows} - {r[0] for r in kept} >= {300, 301, 302}
    least = {d for d, _, c in components_by_hand(in_order(kept)) if d == c}
    kept = [r for r in kept if r[0] in least]
    passages = [decontaminate.trimmed(decontaminate.symbols(t)) for _, t in items]
    kept = [r for r in kept if all(least_edits(decontaminate.symbols(r[1]), p) > decontaminate.budget(len(p)) for p in passages)]
    assert not {r[0] for r in kept} & set(range(200, 209)) and len(kept) < 100
    expected = mixed_by_hand(kept)
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["size"]) for r in found) == Counter((r[0], len((r[1] or "").encode()) + 1) for r in expected)
    cut_as_promised(found, sharding.SHARDS)
    texts = {r[0]: r[1] for r in rows}
    assert all(r["text"] == texts[r["doc_id"]] and r["source"] == {x[0]: x[3] for x in rows}[r["doc_id"]] for r in found)
    # the same, stage by stage over written tables
    docs, folder = common.table(spark, str(tmp_path), "documents"), str(tmp_path)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
    columns = ("doc_id", "size", "text_crc32", "shard", "slot", "text", "lang", "source", "n_chars")
    assert Counter(tuple(r[c] for c in columns) for r in docs.collect()) == Counter(tuple(r[c] for c in columns) for r in found)
    # shards as files: each holds its rows, in order, and readers of one shard read one folder
    docs.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(f"{folder}/shards")
    for k in {r["shard"] for r in found}:
        rows = spark.read.parquet(f"{folder}/shards/shard={k}").collect()
        assert sorted(r["slot"] for r in rows) == list(range(len(rows))) and Counter(r["text"] for r in rows) == Counter(r["text"] for r in found if r["shard"] == k)
